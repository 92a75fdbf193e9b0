"""Quality rules: base counts plus divergence from language references.

Only DataFrame expressions are used.  Every document gets two histograms, one of
character classes and one of its language's common words.  These are learned: the
``N_COMMON`` words of each language that most of its documents hold, counted in bands of
doubling rank, so that a short text's histogram is not all noise.  The histograms of
all documents that pass the base rules are summed by language into references, and a
document is refused when its Jensen-Shannon distance to its language's
reference is too large.  Short documents are guarded: below ``min_words`` words
a histogram says too little, so the distances are not consulted.

Defined results: a null or empty text has zero words and fails the base rules;
a null language is a group of its own, apart from any language that has a name, with common words of its own; a language
of few or of short documents has few common words or none; repeated
rows give repeated results; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.llm.common import BLANKS, column, cut

#: Common words of a language, in bands of 1, 2, 4, ... words by rank.
N_BANDS = 8
N_COMMON = 2**N_BANDS - 1
#: A language's common words are looked up by their hashes, in so many slots.
SLOTS = 512
#: Character classes that are counted; blanks follow from the words, and the rest (nearly all lower case) is "other".
CLASSES = {"upper": r"[^\p{Lu}]+", "symbol": r"[^#*$%&|<>]+", "mark": r"[^0-9.,;:!?'\"()-]+"}
#: All characters outside these classes; taken out first, so that the long pass is made once.
UNCOUNTED = r"[^\p{Lu}#*$%&|<>0-9.,;:!?'\"()-]+"
CHAR_COLS = [f"c_{k}" for k in CLASSES] + ["c_blank", "c_other"]
WORD_COLS = [f"w_{i}" for i in range(N_BANDS)] + ["w_other"]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(text, F.lit(r"[\x09-\x0D]"), F.lit(" ")), " "), "")


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def common_words(docs: DataFrame, *, min_words: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per language: (k, slots), its common words with their bands (a digit each) by slot.

    Common are the words that most of the language's documents of at least ``min_words`` words hold; ties go by the word.
    A document counts once for a word, so one that repeats a word moves nothing.  Counts are combined on the map side, and
    each task keeps its own ``N_COMMON`` best, so a hot language gathers no more in a task than any other.
    """
    d = docs.select(column(docs, lang_col).cast("string").alias("k"), _words(column(docs, text_col).cast("string")).alias("words"))
    d = d.select("k", F.when(F.size("words") >= min_words, F.array_distinct("words")).alias("words"))
    n = d.select("k", F.explode_outer("words").alias("word")).where("word is not null").groupBy("k", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "word"))
    best = n.withColumn("rank", rank).where(F.col("rank") <= N_COMMON)
    entry = F.struct(_slot(F.col("word")).alias("slot"), "word", (F.length(F.bin("rank")) - 1).cast("string").alias("band"))
    own = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.filter("known", lambda x: x["slot"] == i))
    return best.groupBy("k").agg(F.collect_list(entry).alias("known")).select("k", own.alias("slots"))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: DataFrame | None = None) -> DataFrame:
    """One row per document: id, lang, the base counts and both histograms (``common``: see ``common_words``).

    Words in repeated windows are found inside the row: the windows' 64-bit
    hashes are sorted, equal neighbours are repeated windows, and the gaps
    between their starts say how many words they cover.  Nothing is exploded, so
    nothing is shuffled.
    """
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    d = docs.select(column(docs, id_col).alias("doc_id"), column(docs, lang_col).cast("string").alias("lang"), text.alias("t"))
    d = d.withColumns({
        "words": _words(F.col("t")),
        "marks": F.regexp_replace("t", F.lit(UNCOUNTED), F.lit("")),
        "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(rf"[^{BLANKS}]")),
    })
    common = cut(common_words(docs, text_col=text_col, lang_col=lang_col)) if common is None else common  # written, so its size is known to the join
    d = d.join(common, F.col("lang").eqNullSafe(F.col("k")), "left")
    band = lambda w: F.get(F.filter(F.get("slots", _slot(w)), lambda x: x["word"] == w), F.lit(0))["band"]
    counts = {f"c_{k}": F.length(F.regexp_replace("marks", F.lit(p), F.lit(""))).cast("long") for k, p in CLASSES.items()}
    d = d.select(
        "doc_id", "lang", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length("t").cast("long").alias("n_all"),
        F.array_join(F.transform("words", band), "").alias("bands"),
        F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))).alias("h"),
        *[c.alias(k) for k, c in counts.items()],
    )
    d = d.withColumn("h", F.slice("h", 1, F.greatest(F.size("h") - 2, F.lit(0))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array("h")))
    d = d.withColumn("dups", F.array_distinct(F.filter("s", lambda x, i: x == F.get("s", i - 1))))
    # Few repeated windows: look each window up in their list.  Many: sort windows with their places.
    few = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains("dups", x), i)), lambda p: p.isNotNull())
    d = d.withColumns({
        "few": F.when(F.size("dups") <= 24, few),
        "placed": F.when(F.size("dups") > 24, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))),
    })
    many = F.filter("placed", lambda x, i: (x["h"] == F.get("placed", i - 1)["h"]) | (x["h"] == F.get("placed", i + 1)["h"]))
    d = d.withColumn("starts", F.coalesce("few", F.sort_array(F.transform(many, lambda x: x["p"]))))
    covered = F.aggregate(
        F.transform("starts", lambda p, i: F.coalesce(F.least(F.get("starts", i + 1) - p, F.lit(3)), F.lit(3))),
        F.lit(0), lambda a, x: a + x,
    )
    hist = {f"w_{i}": (F.length("bands") - F.length(F.replace("bands", F.lit(str(i)), F.lit("")))).cast("long") for i in range(N_BANDS)}
    return d.select(
        "doc_id", "lang", "n_words", "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        *counts, (F.col("n_all") - F.col("word_chars")).alias("c_blank"),
        (F.col("word_chars") - sum(F.col(k) for k in counts)).alias("c_other"),
        *[c.alias(k) for k, c in hist.items()], (F.col("n_words") - F.length("bands")).alias("w_other"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts; null if either sums to zero."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    share = lambda h: F.transform(h, lambda x: F.try_divide(x, total(h)))
    half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    gain = F.zip_with(share(p), share(q), lambda x, y: (half(x, y) + half(y, x)) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.aggregate(gain, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))


def with_distances(counts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Add ``js_chars`` and ``js_words``, the distances to references made of the ``chosen`` rows."""
    share = lambda c, cols: F.round(F.try_divide(1e6 * F.col(c), sum(F.col(x) for x in cols))).cast("long")
    refs = cut(chosen.groupBy(F.col("lang").alias("k")).agg(*[F.sum(share(c, cols)).alias("r_" + c) for cols in (CHAR_COLS, WORD_COLS) for c in cols]))  # written, so its size is known to the join
    return counts.join(refs, F.col("lang").eqNullSafe(F.col("k")), "left").select(*counts.columns, *[
        js_distance(*[F.array(*[F.col(p + c).cast("double") for c in cols]) for p in ("", "r_")]).alias(f"js_{k}")
        for k, cols in (("chars", CHAR_COLS), ("words", WORD_COLS))
    ])


def quality_rules(docs: DataFrame, *, min_words: int = 50, trim: float = 0.13, max_char_distance: float = 0.18, max_word_distance: float = 0.30,
                  id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, ``base_failed``, both distances and the verdict ``kept`` for each document.

    A reference is the sum of the documents' shares (in millionths, so sums are exact)
    over all documents that pass the base rules: one row a language, combined on
    the map side, so a hot language shuffles no more than any other.  It is made twice:
    documents farther than ``trim`` from the first reference are left out of the second,
    so that junk does not move what junk is held against.
    """
    common = cut(common_words(docs, min_words=min_words, text_col=text_col, lang_col=lang_col))
    counts = cut(base_counts(docs, id_col, text_col, lang_col, common))
    near = with_distances(counts, counts.where("not base_failed")).where("not base_failed").where(F.col("js_chars") <= trim)
    d = with_distances(counts, near)
    far = (F.col("n_words") >= min_words) & ((F.col("js_chars") > max_char_distance) | (F.col("js_words") > max_word_distance))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"),
        "js_chars", "js_words",
    )
