"""Mixing sources to target weights (DataFrame functions only).

Plan: one pass reduces the documents to a word total per source; the targets are fitted on that small table; a second
pass joins the repetition rates back and emits each document ``floor(rate)`` times plus one hash-seeded Bernoulli copy
with the probability of the fraction. Texts are never shuffled while the table of sources stays within a checked bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, draw, fresh, named, word_count

#: Up to so many sources (some 100 bytes each) the rates are broadcast; beyond, they are joined by a salted shuffle.
BROADCAST_SOURCES = 20_000
SALTS = 32


def global_rank(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``__rank`` (from 0) in the total order, found without gathering the rows in one task."""
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition, so the ordered sum over them is bounded by the cluster, not by the data.
    offsets = parts.groupBy("__part").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(F.broadcast(offsets), "__part").withColumn("__rank", F.col("__before") + within - 1).drop("__part", "__before")


def source_rates(docs: DataFrame, size: Column, source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``(__source, __source_size, __target, __rate)``: what each source holds and should give.

    Sources in code-point order, null last, weigh as ``weights`` does, repeating. All sizes together are shared by
    weight; no target exceeds ``most`` times its source's size, and what is above that is reshared by weight among the
    rest until none is above. Sources without words have target and rate 0. No rows give no sources.
    """
    sums = docs.select(named(source).alias("__source"), size.alias("__size")).groupBy("__source").agg(F.sum("__size").alias("__source_size"))
    ranked = global_rank(sums, F.col("__source").isNull(), F.col("__source"))
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights)).cast("int"))
    src = cut(ranked.select("__source", "__source_size", weight.cast("long").alias("__w"), (F.col("__source_size") * most).alias("__cap")))
    level, seen = 0.0, None
    while True:
        above = F.col("__cap") < F.lit(level) * F.col("__w")
        row = src.agg(F.sum("__source_size").alias("total"), F.coalesce(F.sum(F.when(above, F.col("__cap"))), F.lit(0)).alias("capped"), F.count_if(above).alias("n"), F.sum(F.when(~above, F.col("__w"))).alias("free")).first()
        if not row.total or not row.free or (seen is not None and row.n == seen):
            break
        level, seen = (row.total - row.capped) / row.free, row.n
    target = F.least(F.col("__cap").cast("double"), F.lit(level) * F.col("__w"))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    return cut(src.withColumn("__target", target).withColumn("__rate", rate).select("__source", "__source_size", "__target", "__rate"))


#: Columns that ``with_copies`` adds.
ADDED = ("source", "source_size", "target", "rate", "copies", "salt", "copy", "other_salt")


def with_copies(docs: DataFrame, rates: DataFrame, added: list[str], source: str = "source", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """``docs`` with the columns ``added`` (see ADDED); every row is kept, null sources too.

    The draw of a row is made from its source and key. Rows without a key are told apart by their place in the table, so
    that many of them aren't all taken or all left.
    """
    own, size, target, rate, copies, salt, _, other = added
    rates = rates.select(F.col("__source").alias(own), F.col("__source_size").alias(size), F.col("__target").alias(target), F.col("__rate").alias(rate))
    on = named(source).eqNullSafe(F.col(own))
    if rates.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), on, "left")
    else:
        salted = docs.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        many = rates.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(many, on & (F.col(salt) == F.col(other)), "left").drop(salt, other)
    whole = F.floor(rate)
    place = F.when(named(key).isNull(), F.monotonically_increasing_id())
    extra = draw(F.lit(f"mix{seed}"), named(source), F.coalesce(named(key).cast("string"), place.cast("string"))) < F.col(rate) - whole
    return joined.withColumn(copies, whole + extra.cast("long"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as its source's rate says, with their columns.

    The size of a document is its number of words. Null and empty texts have size 0; they follow the rate of their
    source, and so do repeated rows (which share a draw) and rows without a key (each has a draw
    of its own place in the table). An empty table stays empty. Extra columns are carried along, whatever their names.
    """
    rates = source_rates(docs, word_count(named(text)), source, weights, most)
    added = fresh(docs.columns, *ADDED)
    again = F.explode(F.when(F.col(added[4]) > 0, F.sequence(F.lit(1), F.col(added[4]).cast("int"))))
    return with_copies(docs, rates, added, source, key, seed).select(*map(named, docs.columns), again.alias(added[6])).drop(added[6])


def mix_report(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 42, **how) -> DataFrame:
    """Per document: size, its source's size and target, and the words that the mix takes of it."""
    sized = cut(docs.select(named(key).alias("__key"), named(source).alias("__from"), word_count(named(text)).alias("__size")))
    added = fresh(sized.columns, *ADDED)
    out = with_copies(sized, source_rates(sized, F.col("__size"), "__from", **how), added, "__from", "__key", seed)
    return out.select(F.col("__key").alias(key), F.col("__size").alias("size"), F.col(added[1]).alias("source_size"), F.col(added[2]).alias("target"), (F.col("__size") * F.col(added[4])).alias("taken"))
