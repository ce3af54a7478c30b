r"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Every source sends its documents in a shuffled order, again from the beginning when it has none left, up to ``REPEATS`` times. The sources share a budget of words by
weight; what a source can't fill with that many repeats goes to the others, by weight, until none is above its limit (``targets``). A copy's virtual finish time is the number of words that its source has sent by its end, divided by the source's target: at
time 1 every source has sent its target and the budget is spent. The mix is all copies sorted by finish time over the whole table (``position``: the words before a copy), truncated where the budget is spent: a copy that
a source is sending at that moment is cut there, so every source meets its target to less than a word, whatever the sizes of its documents, and the whole mix is less than a word a source below the budget.

Movement: texts are only read, for their sizes. Rows of sizes are dealt by source and 4,096 buckets of the shuffle's hash, so a source with a third of all rows fills thousands of groups alike;
running words come from the groups' totals and a window within a group. Copies are dealt once by ranges of finish time. What is broadcast is one row a range. Rows of sizes and copies are written to the shared folder, so a lost executor repeats no sampling.

The shuffle is the order of md5 of ``seed`` and key, so reruns and other partitionings give the same mix. Sources by code point, null last, weigh 1, 2, 3, 1, ... unless weights are given.

Defined results: a null, empty or blank text has size 0 and is taken 0 times; a source of only such has target 0; a null source is a source of its own, apart from ''; a null key sorts as ''; repeated rows are documents
of their own, taken one after the other; rows of one key, source and size are interchangeable; documents with equal finish times follow their sources' order; an empty table gives an empty mix; other columns are left out, so none clashes.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

REPEATS = 3
CYCLE = (1, 2, 3)
#: Hexadecimal digits of the shuffle's hash that deal a source's documents into groups.
DIGITS = 3


def word_count(text: Column) -> Column:
    r"""The number of `[^\x20\x09-\x0D]+` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def in_order(df: DataFrame, by: list[str], amount: Column, name: str) -> DataFrame:
    """``df`` with the column ``name``: the sum of ``amount`` over all rows before, in the order of ``by``. Rows are dealt by ranges; ranges start at the totals of those before."""
    part, own = S.fresh(df, "part"), S.fresh(df, "own")
    dealt = S.materialize(df.withColumn(own, amount).repartitionByRange(*by).withColumn(part, F.spark_partition_id()))
    totals = dealt.groupBy(part).agg(F.sum(own).alias("total"))
    before = totals.select(part, F.coalesce(F.sum("total").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = F.coalesce(F.sum(own).over(Window.partitionBy(part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(before), part).withColumn(name, within + F.col("offset")).drop("offset", part, own)


def sizes(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """One row a document: key, source (and whether it has none), size, the shuffle's hash and its group."""
    turn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return df.select(F.col(key).alias("doc_id"), F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), word_count(F.col(text)).alias("size"), turn.alias("turn")).withColumn("deal", F.substring("turn", 1, DIGITS))


def targets(sources: DataFrame, budget: int | None = None) -> DataFrame:
    """``sources`` (no_source, source, source_size, weight) with ``target``: shares of the budget (all sizes, if None) by weight; where one is above ``REPEATS`` times its source's size, it stops there and the excess is shared anew.

    Each round asks which sources are above and what is left for the others: two numbers. Numbers are exact up to the last division."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    limit = exact("source_size") * F.lit(REPEATS)
    first = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    whole = int(first[0] or 0) if budget is None else budget
    left, weights = whole, int(first[1] or 0)
    while True:
        above = limit * F.lit(Decimal(weights)).cast("decimal(17,0)") <= exact("weight") * F.lit(Decimal(left)).cast("decimal(19,0)")
        held = sources.agg(F.sum(F.when(above, F.col("source_size") * REPEATS)), F.sum(F.when(~above, F.col("weight")))).first()
        now = (whole - int(held[0] or 0), int(held[1] or 0))
        if now == (left, weights) or not now[1]:
            break
        left, weights = now
    share = (exact("weight") * F.lit(Decimal(left)).cast("decimal(19,0)")).cast("double") / F.lit(float(weights or 1))
    return sources.withColumn("target", F.when(above, (F.col("source_size") * REPEATS).cast("double")).otherwise(share))


def cycled(sources: DataFrame) -> DataFrame:
    """``sources`` with the weights 1, 2, 3, repeating, in code point order, null last."""
    weight = F.get(F.array(*[F.lit(w) for w in CYCLE]), (F.col("number") % len(CYCLE)).cast("int"))
    return in_order(sources, ["no_source", "source"], F.lit(1), "number").withColumn("weight", weight.cast("long"))


def queued(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with its source's size and target, its number within its group and ``sent``: the words that its source sends before it, in the first pass."""
    group = ["no_source", "source", "deal"]
    groups = sized.groupBy(*group).agg(F.sum("size").alias("group_size"))
    before = F.coalesce(F.sum("group_size").over(Window.partitionBy("no_source", "source").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.withColumn("groups_before", before).join(sources.select("no_source", "source", "source_size", "target", "number"), ["no_source", "source"])
    w = Window.partitionBy(*group).orderBy("turn", "doc_id", "size")
    within = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.join(groups, group).select("doc_id", "size", "source_size", "target", "number", "deal", F.row_number().over(w).alias("at"), (F.col("groups_before") + within).alias("sent"))


def copies(queue: DataFrame) -> DataFrame:
    """The mix: a row for each copy with the words taken of it and its virtual finish time, ``position`` being the words before it; sort by ``position`` to read it."""
    turn = F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("copy")
    sent = F.col("copy") * F.col("source_size") + F.col("sent")
    words = F.least("size", F.greatest(F.floor("target") - sent, F.lit(0)))
    each = queue.where(F.col("sent") < F.floor("target")).select("*", turn).withColumn("words", words).where("words > 0").withColumn("finish", (sent + F.col("size")) / F.col("target"))
    return in_order(each, ["finish", "number"], F.col("words"), "position")


def prepare(df: DataFrame, weights: DataFrame | None = None, budget: int | None = None, **columns: str) -> DataFrame:
    """The written queue of ``df``'s documents. ``weights``: no_source, source and weight (whole numbers above 0) of every source."""
    sized = S.materialize(sizes(df, **columns))
    sources = sized.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = cycled(sources)
    else:
        sources = in_order(sources.join(weights, ["no_source", "source"]), ["no_source", "source"], F.lit(1), "number")
    return S.materialize(queued(sized, targets(S.materialize(sources), budget)))


def taken(queue: DataFrame) -> DataFrame:
    """One row a document: the words that the mix takes of it, repeats counted, when its first copy finishes and the words of the mix before that copy (null: not taken)."""
    row = ["doc_id", "size", "source_size", "target", "number", "deal", "at"]
    all_of = copies(queue).select(*row, "words", "finish", "position").unionByName(queue.select(*row, F.lit(0).cast("long").alias("words"), F.lit(None).cast("double").alias("finish"), F.lit(None).cast("long").alias("position")))
    return all_of.groupBy(*row).agg(F.sum("words").alias("taken"), F.min("finish").alias("finish"), F.min("position").alias("position")).drop("number", "deal", "at")
