"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Draws are multiples of 2 ** -52.
DRAW_RANGE = float(1 << 52)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a small intermediate table that are written to one file.
ROWS_A_FILE = 50_000
#: A key with more than this share of all rows is hot; there are so many such keys at most.
HOT_SHARE = 1 / 256
SALTS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only a session that runs on one machine (a ``local`` master, as in tests) may name none; it gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder.

    Where a bound on its ``rows`` is known, a small table goes to few files (never fewer than 8).
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return (df if rows is None else df.coalesce(max(8, ceil(rows / ROWS_A_FILE)))).checkpoint(eager=True)


def salted_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner", broadcast_rows: int = 100_000) -> DataFrame:
    """``many`` joined with ``few`` (a row for each key) on the column ``key`` of both, whatever the shares of the keys.

    Up to ``broadcast_rows`` rows of ``few``, which must be narrow, are broadcast: then ``many`` isn't moved. Beyond, keys with over
    HOT_SHARE of all rows (a bounded number, so their list is broadcast) are dealt to SALTS tasks each.
    """
    if few.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return many.join(F.broadcast(few), key, how)
    total = many.count()
    hot = many.groupBy(key).count().where(F.col("count") > total * HOT_SHARE).select(key, F.lit(SALTS).alias("__salts"))
    hot = cut(hot, 256)
    salt = F.when(F.col("__salts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")
    left = many.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).drop("__salts")
    right = few.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores before them as it takes to clash with none of ``taken`` (whatever their case)."""
    own, edge = {c.lower() for c in taken}, "__"
    while any((edge + n).lower() in own for n in names):
        edge += "_"
    return [edge + n for n in names]


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null. Each word becomes one letter before counting, so no array of words is built."""
    # In Java's regular expressions \\S without flags is the complement of the same six characters, and fast.
    marks = F.translate(F.regexp_replace(text, r"\S+", "w"), WHITE_SPACE, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by name, whatever letters the names hold."""
    return [named(c) for c in df.columns]


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def draw(*parts: Column | str) -> Column:
    """A reproducible uniform number in [0, 1) from the given values (nulls allowed)."""
    said = [F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("\x00")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *said)), 1, 13), 16, 10).cast("long") / F.lit(DRAW_RANGE)


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: 0, as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))
