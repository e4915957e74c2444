"""Files as DataFrames: scanning folders and parsing what is found, on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .formats import READERS, DocumentParseError, UnsupportedFileType, read_document

SECTION = "struct<text:string,page:int,heading:string>"
PARSED = f"name string, title string, pages int, sections array<{SECTION}>, error_kind string, error string"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of the files below a folder that have a reader; a single file is taken whatever it is.

    Only the base name is kept as ``name``. Rows come in no order; of one name the greatest path wins on ingest.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1))
    wanted = kind.isin(*READERS) | (F.col("path").endswith(path.rstrip("/")) & ~F.lit(path.endswith("/")))
    return files.where(wanted).select("path", X.base_name(F.col("path")).alias("name"), "content")


#: Up to so many files that another of their name replaces are broadcast.
BROADCAST_PATHS = 100_000


def last_of_name(files: DataFrame) -> DataFrame:
    """Of several files (name, content[, path]) of one name, the one with the greatest path.

    Names and paths alone are compared, so contents aren't shuffled (nor read for it) unless very many names repeat.
    Without paths any one of a name stays.
    """
    if "path" not in files.columns:
        return files.groupBy("name").agg(F.first("content").alias("content"))
    paths = files.select("name", "path")
    last = paths.groupBy("name").agg(F.max("path").alias("last"), F.count("*").alias("n")).where("n > 1")
    earlier = paths.join(last, "name").where("path != last").select("path")
    n = earlier.limit(BROADCAST_PATHS + 1).count()
    if not n:
        return files
    return files.join(F.broadcast(earlier) if n <= BROADCAST_PATHS else earlier, "path", "left_anti")


def parse(files: DataFrame, strict: bool = True) -> DataFrame:
    """(name, title, pages, sections, error_kind, error) of rows (name, content).

    Files that can't be parsed raise where ``strict``, else they give a row with the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["name"], batch["content"]):
                try:
                    got = read_document(name, bytes(data) if data is not None else b"")
                    rows.append((name, got.title, got.pages, [s._asdict() for s in got.sections], None, None))
                except (DocumentParseError, UnsupportedFileType) as e:
                    if strict:
                        raise
                    rows.append((name, None, None, [], type(e).__name__, str(e)))
            out = pd.DataFrame(rows, columns=["name", "title", "pages", "sections", "error_kind", "error"])
            yield out.astype({"pages": "Int32"})

    return files.select("name", "content").mapInPandas(run, PARSED)


def sections(parsed: DataFrame) -> DataFrame:
    """One row for each section of each document: name, title, sec_idx, text, page, heading."""
    return parsed.select("name", "title", F.posexplode("sections").alias("sec_idx", "s")).select("name", "title", "sec_idx", "s.text", "s.page", "s.heading")
