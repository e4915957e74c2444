"""Evaluation sets: one JSON object on a line, with empty lines and // comments left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

EXAMPLE = "id string, collection string, question string, expected_sources array<string>, expected_answer string"


class DatasetError(ValueError):
    """A line that isn't an example, or a set without examples."""


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples with their physical line number; an absent id is ``line-N``. Bad lines raise with ``path:line``.

    The file is read whole by one task to number its lines: it holds questions written by people, not data.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("at", "line"))
    said = X.strip(F.col("line"))
    used = lines.where((said != "") & ~said.startswith("//")).select((F.col("at") + 1).alias("line"), said.alias("said"))
    parsed = used.withColumn("e", F.from_json("said", EXAMPLE + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad = F.col("e").isNull() | F.col("e._bad").isNotNull() | F.col("e.question").isNull() | ~F.col("said").startswith("{")
    worst = parsed.where(bad).agg(F.min("line").alias("line"), F.count("*").alias("n")).first()
    if worst.n:
        raise DatasetError(f"{path}:{worst.line}: not an example")
    if parsed.isEmpty():
        raise DatasetError(f"{path}: no examples")
    return parsed.select("line", F.coalesce("e.id", F.concat(F.lit("line-"), F.col("line"))).alias("id"), "e.collection", "e.question", F.coalesce("e.expected_sources", F.array().cast("array<string>")).alias("expected_sources"), "e.expected_answer")


def with_expected(examples: DataFrame) -> DataFrame:
    """``examples`` with ``expected``: its sources as structs (document, page)."""
    return examples.withColumn("expected", F.transform("expected_sources", X.expected_source))
