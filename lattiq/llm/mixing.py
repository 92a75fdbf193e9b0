"""Mixing sources to target weights, with DataFrame expressions only.

1. *Pack.*  Each source is one stream of tokens (words): its documents in a
   pseudorandom order, cut into blocks of ``block`` tokens (a source of under 128 such blocks is cut
   into 128 shorter ones).  A document's place in the
   stream is a prefix sum taken in two levels (hash bucket, then document), so
   no task ever sees a whole source.
2. *Draw.*  The mix has as many slots as the targets hold blocks, in output shards of
   ``shard_slots``.  Each slot draws its source by the targets, so a shard's source counts
   are one multinomial draw.  Prefix sums of these counts over shards number each source's slots:
   the first ``n_slots`` of a source exist.  What a source has drawn beyond that is void,
   and what it lacks is made up in closing shards; so each total is its target, whatever was drawn.
   (Whole passes over a source are counted exactly; the rest is rounded up to blocks, of which
   the last one is taken only as far as the target goes.)
3. *Map.*  Slot ``r`` of a source takes block ``perm(r mod blocks)`` under a pseudorandom
   permutation of that source's block indices, another one for each epoch ``r // blocks``.
4. *Join* slots and packed blocks by (source, block index).

Permutations are swap-or-not shuffles over exactly the indices there are: a fixed
number of rounds of integer arithmetic, the same in any SQL engine.

Texts take no part in the plan.  ``mixed_documents`` moves each text once, to its parts.

There is one row a source in some steps; more than ``MAX_SOURCES`` sources are an error.

Defined results: a null text has size 0 and takes no part; a null source is a source of its own,
last in order; repeated rows are separate documents, also if their ids are null; extra columns are ignored;
an empty table gives an empty mix; a very long text is packed into as many blocks as it needs.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.llm.common import BLANKS, column, cut

P31 = 2147483647
ROUNDS = 12
#: Slots are made in chunks of this many, so that one large source is made by many tasks.
CHUNK = 1 << 14
MAX_SOURCES = 100_000
#: Shards are numbered in spans of this many, so that prefix sums over shards are made by many tasks.
SPAN = 4096
#: A token with the blanks before it, and those at the text's end: the pieces of a text join to the text.
TOKEN = rf"([{BLANKS}]*[^{BLANKS}]+(?:[{BLANKS}]+$)?)"


def round_constants(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int, int]]:
    rng = random.Random(seed)
    return [tuple(rng.randrange(1 << 20, P31) for _ in range(4)) for _ in range(rounds)]


def mix31(x: Column, a: int | Column, b: int | Column) -> Column:
    """A pseudorandom number below 2**31 - 1 from an integer, in arithmetic that cannot overflow."""
    low, high = F.pmod(x, F.lit(P31)), F.pmod(F.floor(x / P31).cast("long"), F.lit(P31))
    return F.pmod(F.pmod(low * a + b, F.lit(P31)) + F.pmod(high * (b | 1 if isinstance(b, int) else b.bitwiseOR(1)), F.lit(P31)), F.lit(P31))


def turns(key: Column, n: Column, seed: int) -> Column:
    """The rounds of the permutation of 0..n-1 chosen by ``key``: what each turns about, and its constants."""
    rounds = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip("abce", x, strict=True)]) for x in round_constants(seed)])
    return F.transform(rounds, lambda k: F.struct(
        F.pmod(mix31(key, k["a"], k["b"]) * 65536 + mix31(key, k["c"], k["e"]), n).alias("turn"), k["e"].alias("e"), k["a"].alias("a")))


def permuted(x: Column, n: Column, key: Column, rounds: Column) -> Column:
    """The image of ``x`` under a swap-or-not shuffle: in each round x and its mirror image change places or not."""
    def step(acc, k):
        to = F.pmod(k["turn"] - acc, n)
        coin = F.floor(mix31(F.greatest(acc, to) + key * 7919, k["e"], k["a"]) / 65536) % 2
        return F.when(coin == 1, to).otherwise(acc)

    return F.aggregate(rounds, x, step)


@dataclass(frozen=True)
class Mix:
    sources: DataFrame  # source, src, source_size, target, width (tokens a block), n_blocks, n_slots, ...
    draw: DataFrame  # shard, src, n: the multinomial draws
    slots: DataFrame  # shard, slot, src, epoch, block, most (tokens of the block that the slot takes; null: all)
    rows: DataFrame  # a row for each piece of a document and each slot that takes it (null slot: not taken)
    texts: DataFrame  # the documents themselves, by the keys k1, k2 that ``rows`` have


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Each source's target: a common level times its weight, stopped at ``cap`` times its size.

    Raising the level until the targets add up to ``share`` of all sizes is what
    resharing the excess comes to.  There is one row a source here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    d = totals.withColumn("src", (F.row_number().over(order) - 1).cast("long"))
    d = d.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("src", F.lit(len(weights))).cast("int")))
    d = d.withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    by = Window.orderBy("ratio", "src")
    every, before = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, -1)
    full = F.sum(F.col("source_size")).over(every) * float(share)
    level = (full - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    d = d.withColumn("level", level).withColumn("rank", F.row_number().over(by))
    # The sources that stay below their cap are the last ones by ratio; their first one fixes the level.
    d = d.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("rank"))).over(every))
    return d.select("source", "src", "source_size", "weight", F.coalesce(F.least(F.col("most"), F.col("level") * F.col("weight")), F.col("most")).alias("target"))


def _pick(position: Column, firsts: list[int]) -> Column:
    """The number of the interval that holds ``position``, by binary search for its beginning."""
    held = F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>")  # folded to one literal
    steps = F.array(*[F.lit(1 << k) for k in range(len(firsts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.get(held, at + k) <= position, at + k).otherwise(at))


def _prefix(counts: DataFrame) -> DataFrame:
    """Adds to (shard, src, n) ``before``: the source's sum over earlier shards, in two levels."""
    spans = counts.withColumn("span", F.floor(F.col("shard") / SPAN))
    by = Window.partitionBy("src").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    base = spans.groupBy("src", "span").agg(F.sum("n").alias("s")).select("src", "span", F.coalesce(F.sum("s").over(by), F.lit(0)).alias("base"))
    within = Window.partitionBy("src", "span").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spans.join(base, ["src", "span"]).select("shard", "src", "n", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"))


def _slots(spark: SparkSession, sources: DataFrame, shard_slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The draws (shard, src, n), and the slots (shard, slot, src, epoch, block, most)."""
    known = sources.where("n_slots > 0").orderBy("src").select("src", "first", "n_slots").collect()
    n_all, tasks = sum(r["n_slots"] for r in known), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n_shards = -(-n_all // shard_slots)
    shards = spark.range(0, n_shards, 1, tasks).withColumnRenamed("id", "shard")
    each = shards.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(shard_slots), n_all - F.col("shard") * shard_slots) - 1)).alias("slot"))
    # 52 bits of a digest are one draw between 0 and 1.
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "shard", "slot").cast("binary")), 1, 13), 16, 10).cast("long") / float(1 << 52)
    src = F.get(F.array(*[F.lit(r["src"]) for r in known]) if len(known) < 100 else F.split(F.lit(",".join(str(r["src"]) for r in known)), ",").cast("array<bigint>"), _pick(F.floor(draw * float(n_all)), [r["first"] for r in known])) if known else F.lit(None)
    each = each.withColumn("src", src.cast("long")).withColumn("j", F.row_number().over(Window.partitionBy("shard", "src").orderBy("slot")) - 1)
    each = cut(each)
    counts = cut(each.groupBy("shard", "src").agg(F.count("*").alias("n")))
    few = sources.select("src", "n_blocks", "n_slots", "part", "most")
    drawn = each.join(_prefix(counts).drop("n").hint("merge"), ["shard", "src"]).select("shard", "slot", "src", (F.col("before") + F.col("j")).alias("r"))
    drawn = drawn.join(F.broadcast(few.select("src", "n_slots")), "src").where("r < n_slots").drop("n_slots")  # at most MAX_SOURCES rows

    # Closing shards hold what sources lack.
    lack = sources.join(counts.groupBy("src").agg(F.sum("n").alias("drawn")), "src", "left").select("src", "n_slots", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    lack = lack.withColumn("lack", F.greatest(F.col("n_slots") - F.col("drawn"), F.lit(0)))
    lack = lack.withColumn("ahead", F.coalesce(F.sum("lack").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("lack > 0")
    lack = lack.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("lack") - 1) / CHUNK))).alias("c")).repartition(tasks, "src", "c")
    lack = lack.select("*", F.explode(F.sequence(F.col("c") * CHUNK, F.least((F.col("c") + 1) * CHUNK, F.col("lack")) - 1)).alias("i"))
    place = F.col("ahead") + F.col("i")
    closing = lack.select((n_shards + F.floor(place / shard_slots)).alias("shard"), (place % shard_slots).alias("slot"), "src", (F.col("drawn") + F.col("i")).alias("r"))

    # Blocks under the permutation of their source and epoch, made in chunks.
    chunk = few.where("n_slots > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / F.col("n_blocks")))).alias("epoch"))
    chunk = chunk.withColumn("draws", F.least("n_blocks", F.col("n_slots") - F.col("epoch") * F.col("n_blocks")))
    chunk = chunk.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("draws") - 1) / CHUNK))).alias("c"))
    chunk = chunk.repartition(tasks, "src", "epoch", "c").withColumn("key", F.col("src") * 1009 + F.col("epoch") + 1)
    chunk = chunk.withColumn("turns", turns(F.col("key"), F.col("n_blocks"), seed + 1))
    blocks = chunk.select("*", F.explode(F.sequence(F.col("c") * CHUNK, F.least((F.col("c") + 1) * CHUNK, F.col("draws")) - 1)).alias("i"))
    r = F.col("epoch") * F.col("n_blocks") + F.col("i")
    blocks = blocks.select("src", r.alias("r"), "epoch", permuted(F.col("i"), F.col("n_blocks"), F.col("key"), F.col("turns")).alias("block"),
                           F.when((F.col("part") > 0) & (r == F.col("n_slots") - 1), F.col("most")).alias("most"))
    # The planner sees the few source rows behind the slots, not how many slots they make: never broadcast them.
    return counts, drawn.unionByName(closing).hint("merge").join(blocks.hint("merge"), ["src", "r"]).select("shard", "slot", "src", "epoch", "block", "most")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 64, shard_slots: int = 4096, buckets: int = 4096,
        seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> Mix:
    """Plan a mix of ``docs`` and join it to their pieces; see the module.

    ``carry`` names columns that ``mixed_documents`` hands on.
    """
    text, spark = column(docs, text_col).cast("string"), docs.sparkSession
    (a, b, *_), = round_constants(seed, 1)
    one_space = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(r"[\x09-\x0D]"), F.lit(" "))
    doc_id, source = column(docs, id_col).cast("long"), column(docs, source_col).cast("string")
    what = [c for x in (doc_id, source, text, *[column(docs, c) for c in carry]) for c in (x, x.isNull())]
    keys = [F.xxhash64(*what).alias("k1"), F.xxhash64(F.lit(1), *what).alias("k2")]  # 128 bits that name a row by its content
    # Rows without an id are spread by their texts.
    own = F.coalesce(doc_id, F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long"))
    sized = cut(docs.select(doc_id.alias("doc_id"), source.alias("source"), F.size(F.array_remove(F.split(one_space, " "), "")).cast("long").alias("size"), mix31(own, a, b).alias("h"), *keys))
    sized = sized.withColumn("bucket", F.floor(F.col("h") / (-(-P31 // buckets))))

    # One row for each source and bucket, then the streams' prefix sums over buckets.
    totals = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("n")))
    sources = totals.groupBy("source").agg(F.sum("n").alias("source_size"))
    if sources.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    size, target, width = F.col("source_size"), F.col("target"), F.col("width")
    sources = targets(sources, weights, share, cap).withColumn("width", F.least(F.lit(block), F.greatest(F.ceil(size / 128), F.lit(1)))).withColumns({
        "n_blocks": F.ceil(size / width), "whole": F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0))})
    sources = sources.withColumn("rest", F.round(target - F.col("whole") * size).cast("long")).withColumn("part", F.ceil(F.col("rest") / width))
    sources = sources.withColumns({"n_slots": F.col("whole") * F.col("n_blocks") + F.col("part"), "most": F.col("rest") - (F.col("part") - 1) * width}).drop("whole", "rest")
    sources = cut(sources.withColumn("first", F.coalesce(F.sum("n_slots").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.join(F.broadcast(sources.select("source", "src", "width")), totals["source"].eqNullSafe(sources["source"])).select(
        totals["source"], "src", "width", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))

    rows = sized.join(base, sized["source"].eqNullSafe(base["source"]) & (sized["bucket"] == base["bucket"])).select(
        "doc_id", "src", "width", "size", sized["bucket"], "base", "h", "k1", "k2")
    within = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "size", "k1", "k2")
    rows = rows.withColumns({
        "nth": F.row_number().over(within),
        "start": F.col("base") + F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    }).drop("base", "h")
    start, end = F.col("start"), F.col("start") + F.col("size")
    span = F.when(F.col("size") > 0, F.sequence(F.floor(start / width), F.floor((end - 1) / width)))
    pieces = rows.select("*", F.explode_outer(span).alias("block"))
    from_, to = F.greatest(F.col("block") * width, start), F.least((F.col("block") + 1) * width, end)
    pieces = pieces.withColumns({"at": from_ - start, "into": from_ - F.col("block") * width, "long": F.when(F.col("block").isNotNull(), to - from_)})
    draw, slots = _slots(spark, sources, shard_slots, seed)
    rows = pieces.join(slots, ["src", "block"], "left")
    # A slot that takes only the first tokens of its block takes that much of this piece.
    n_words = F.when(F.col("slot").isNotNull(), F.greatest(F.least("long", F.coalesce(F.col("most") - F.col("into"), F.col("long"))), F.lit(0)))
    rows = rows.withColumn("n_words", n_words).drop("into", "long", "most", "width")
    return Mix(sources, draw, slots, rows, docs.select(*keys, doc_id.alias("doc_id"), source.alias("source"), text.alias("text"), *[column(docs, c) for c in carry]))


def _texts(m: Mix) -> DataFrame:
    """Each distinct row of the documents once, by its keys: the one time that texts move."""
    return m.texts.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in m.texts.columns[2:]])


def _cutout(parts: str) -> Column:
    """The text of ``parts`` (at, n_words) of ``tokens``.  Its caller names the tokens once more, outside of the lambda,
    which keeps the planner from finding them anew for each part."""
    return F.array_join(F.transform(parts, lambda p: F.array_join(F.slice("tokens", p["at"].cast("int") + 1, p["n_words"].cast("int")), "")), "")


def packed(m: Mix) -> DataFrame:
    """The training blocks' pieces: (shard, slot, src, block, epoch, doc_id, start, n_words, text), to be read in order of shard, slot, start."""
    key = ["k1", "k2"]
    taken_ = m.rows.where("n_words > 0").select(*key, "shard", "slot", "src", "block", "epoch", (F.col("start") + F.col("at")).alias("start"), "n_words", F.array(F.struct("at", "n_words")).alias("parts"))
    d = taken_.join(_texts(m), key).withColumn("tokens", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1)))
    return d.select("shard", "slot", "src", "block", "epoch", "doc_id", "start", "n_words", F.when(F.size("tokens") > 0, _cutout("parts")).alias("text"))


def taken(m: Mix) -> DataFrame:
    """One row for each document: its size, its source's size and target, the words that the mix takes of it, and the first and last shard with some of them."""
    some = F.col("n_words") > 0
    d = m.rows.groupBy("doc_id", "src", "bucket", "nth", "size").agg(
        F.coalesce(F.sum("n_words"), F.lit(0)).cast("long").alias("taken"), F.min(F.when(some, F.col("shard"))).alias("first_shard"), F.max(F.when(some, F.col("shard"))).alias("last_shard"))
    few = F.broadcast(m.sources.select("src", "source_size", "target"))  # at most MAX_SOURCES rows
    return d.join(few, "src").select("doc_id", "size", "source_size", "target", "taken", "first_shard", "last_shard")


def mixed_documents(m: Mix) -> DataFrame:
    """The mix as documents: for each document and epoch, the text of its pieces that are taken, and the carried columns.

    Which pieces these are is worked out without the texts, which then move once, to their parts.
    A document that an epoch takes whole keeps its text as it is.
    """
    key = ["k1", "k2"]
    parts = m.rows.where("n_words > 0").groupBy(*key, "bucket", "nth", "size", "epoch").agg(F.sum("n_words").alias("n"), F.array_sort(F.collect_list(F.struct("at", "n_words"))).alias("parts"))
    parts = parts.select(*key, "nth", "size", "epoch", "n", F.when(F.col("n") < F.col("size"), F.col("parts")).alias("parts"))
    d = parts.hint("merge").join(_texts(m).hint("merge"), key).withColumn("tokens", F.when(F.col("parts").isNotNull(), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1))))
    text = F.when(F.size("tokens") > 0, _cutout("parts")).otherwise(F.col("text"))
    return d.select("doc_id", "source", "nth", "epoch", text.alias("text"), F.col("size").alias("n_tokens"), *m.texts.columns[5:])
