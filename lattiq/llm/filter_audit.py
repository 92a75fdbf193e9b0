"""Audit of how filters interact, by Walsh-Hadamard sums.

Every document has a mask, one bit a filter that it fails.  A part's table of masks is not gathered as such: for each of the 32
sets of filters, each document adds +1 or -1 (the parity of its failures within the set), and these 32 sums, by
part and label, are all that is shuffled.  The transform is its own inverse up to a factor of 32, so the sums
give the number of documents with each mask exactly (in integers).

What any order of the filters does follows from the cells: K[S] counts the documents that fail none of S, so a filter f after the
filters P removes K[P] - K[P + f].  A document with n failures is removed by each of its filters in 120 / n of
the 120 orders, which gives the Shapley counts without going through the orders.

Filters: A under ``min_words`` words; B fewer distinct words than ``distinct`` % of them; C more than ``upper`` % of the characters are A-Z;
D holds one of ``# $ % & * |``; E the same text has a smaller doc_id somewhere in the table.  Copies are told by SHA-256: the smallest
doc_id of each text is found with map-side combine, and a row that isn't it fails E.  That row is looked
up by text and doc_id together, so a text with very many copies spreads over all tasks.

Defined results: a null text is the empty text; a null source is the empty string, with the rows of a source so named; a row
without a doc_id is nobody's copy, makes nobody a copy and has no label; rows that repeat a doc_id each count; a document
is good (toxic) if any of its label rows says so; labels of unknown documents count nowhere; extra
columns are ignored; an empty table gives no parts.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import BLANKS, column, cut

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))


def text_failures(text: Column, *, min_words: int = 50, distinct: int = 65, upper: int = 5) -> list[tuple[str, Column]]:
    """The conditions A to D over a text, as conditions over the columns ``words``, ``n_upper`` and ``text``."""
    n = F.size("words")
    return [
        ("A", n < min_words),
        ("B", 100 * F.size(F.array_distinct("words")) < distinct * n),
        ("C", 100 * F.col("n_upper") > upper * F.length(text)),
        ("D", text.rlike(r"[#$%&*|]")),
    ]


def masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", **limits: int) -> DataFrame:
    """(doc_id, part, mask) for every row; bit i of ``mask`` is filter i of ``FILTERS``."""
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.coalesce(column(docs, part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    d = d.withColumns({
        "words": F.array_remove(F.split("t", f"[{BLANKS}]"), ""),
        "n_upper": F.length("t") - F.length(F.regexp_replace("t", F.lit("[A-Z]+"), F.lit(""))),
    })
    bits = [F.when(c, F.lit(1 << FILTERS.index(k))).otherwise(0) for k, c in text_failures(F.col("t"), **limits)]
    d = cut(d.select("doc_id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("text_id"), sum(bits[1:], bits[0]).alias("own")))
    # Rows whose text occurs twice at least, less those with the text's smallest id.
    firsts = d.groupBy("text_id").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    with_id = d.where("doc_id is not null").join(firsts, ["text_id", "doc_id"], "left")
    copies = with_id.select("doc_id", "part", (F.col("own") + F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))).alias("mask"))
    return copies.unionByName(d.where("doc_id is null").select("doc_id", "part", F.col("own").alias("mask")))


def labelled(rows: DataFrame, labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Add ``good`` and ``toxic`` (0 or 1)."""
    own = labels.select(column(labels, id_col).cast("long").alias("labelled_id"), (column(labels, "quality") == 1).alias("q"), (column(labels, "toxic") == 1).alias("x"))
    own = own.where("labelled_id is not null").groupBy("labelled_id").agg(F.max(F.coalesce("q", F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce("x", F.lit(False)).cast("int")).alias("toxic"))
    has = rows.where("doc_id is not null").join(own, F.col("doc_id") == F.col("labelled_id"), "left")
    both = has.select(*rows.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    return both.unionByName(rows.where("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def _over_sets(value: Callable[[Column], Column]) -> Column:
    """The array of ``value`` by set."""
    return F.transform(F.array(*map(F.lit, SETS)), value)


def _total(value: Callable[[Column], Column]) -> Column:
    """The sum of ``value`` over all sets."""
    return F.aggregate(F.array(*map(F.lit, SETS)), F.lit(0).cast("long"), lambda acc, s: acc + value(s))


def _sign(a: Column, b: Column) -> Column:
    return 1 - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def parity_sums(rows: DataFrame) -> DataFrame:
    """(part, good, toxic, sums): 32 signed sums for each part and label."""
    sums = rows.groupBy("part", "good", "toxic").agg(*[F.sum(_sign(F.col("mask"), F.lit(s))).cast("long").alias(f"s{s}") for s in SETS])
    return sums.select("part", "good", "toxic", F.array(*[f"s{s}" for s in SETS]).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """(part, all, good, toxic): for each part, arrays of the number of documents by mask."""
    n = _over_sets(lambda m: F.shiftright(_total(lambda s: F.get("sums", s) * _sign(m, s)), len(FILTERS)))  # exact: the total is a multiple of 32
    by = sums.select("part", F.struct("good", "toxic", n.alias("n")).alias("label")).groupBy("part").agg(F.collect_list("label").alias("labels"))  # four at most
    over = lambda weight: _over_sets(lambda m: F.aggregate("labels", F.lit(0).cast("long"), lambda acc, x: acc + F.get(x["n"], m) * weight(x)))
    return by.select("part", over(lambda x: F.lit(1)).alias("all"), over(lambda x: x["good"]).alias("good"), over(lambda x: x["toxic"]).alias("toxic"))


def orders() -> list[tuple[str, int, int, int, int]]:
    """(order, step, filter, the set of filters before it, the set with it), for all orders."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in order)
        out += [(name, i + 1, f, sum(1 << g for g in order[:i]), sum(1 << g for g in order[: i + 1])) for i, f in enumerate(order)]
    return out


def audit(docs: DataFrame, labels: DataFrame, **cols: str) -> DataFrame:
    """One row for each part, order and step, with counts; see the module's text."""
    found = cells(parity_sums(labelled(masks(docs, **cols), labels)))
    each = F.array(*[F.lit(1 << f) for f in range(len(FILTERS))])
    cell = lambda m, when, a="all": F.when(when, F.get(a, m)).otherwise(0)
    passing = lambda a: _over_sets(lambda s: _total(lambda m: cell(m, m.bitwiseAND(s) == 0, a)))
    shapley = F.transform(each, lambda f: _total(lambda m: cell(m, m.bitwiseAND(f) > 0) * (F.lit(math.factorial(len(FILTERS))) / F.greatest(F.bit_count(m), F.lit(1))).cast("int")))
    failing = F.transform(each, lambda f: _total(lambda m: cell(m, m.bitwiseAND(f) > 0)))
    alone = F.transform(each, lambda f: F.get("all", f))
    found = found.select("part", *[passing(k).alias(f"{k}_passing") for k in ("all", "good", "toxic")], shapley.alias("shapleys"), failing.alias("failing"), alone.alias("alone"))
    fields = ("filter_order", "step", "f", "before", "upto")
    table = F.lit(json.dumps([dict(zip(fields, o, strict=True)) for o in orders()]))
    d = found.select("*", F.inline(F.from_json(table, "array<struct<filter_order string, step int, f int, before int, upto int>>")))
    lost = lambda a: F.get(f"{a}_passing", "before") - F.get(f"{a}_passing", "upto")
    return d.select(
        "part", "filter_order", "step", F.get("all_passing", "upto").alias("kept"), lost("all").alias("removed"), (F.get("failing", "f") - lost("all")).alias("redundant"),
        F.get("alone", "f").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapleys", "f").alias("shapley"),
    )
