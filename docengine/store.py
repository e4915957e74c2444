"""A chunk store of Parquet deltas.

Each write adds a part to the collections it touches: a folder of new chunks, a folder of what it removes, or both. A
manifest names the parts of each collection in order; it appears under its number at once or not at all, so a reader sees
either the state before or the one after, and of two writers of the same number one fails. A chunk is there unless a later
part removes its document or its id. The number of writes is the collection's revision. A collection of many parts is
written anew as one. Files are reached through Hadoop's file systems, whatever they are.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = (
    "chunk_id string, collection string, doc_id string, doc_name string, idx int, text string, page int, heading string, metadata map<string,string>, embedding array<float>"
)


NAMES = [c.split(" ")[0] for c in CHUNKS.split(", ")]
GONE = "doc_id string, chunk_id string, part long"
#: A collection of more parts than this is written anew as one.
MOST_PARTS = 32


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a temporary one only on one machine without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("a folder that the driver and all executors share is needed: set spark.checkpoint.dir or the store's path")
    return tempfile.mkdtemp(prefix="docengine-")


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below the shared folder, and read from there."""
    folder = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class DimensionMismatch(ValueError):
    pass


class ConcurrentWrite(RuntimeError):
    """Another writer was faster; read again and repeat."""


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------------------------------------------------- manifests
    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def manifest(self) -> tuple[int, dict[str, dict]]:
        """Number and contents (collection: version, dimension, parts) of the current manifest."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/manifests/{numbers[-1]:012d}", wholetext=True).first().value
        return numbers[-1], json.loads(text)

    def _commit(self, before: int, contents: dict[str, dict]) -> None:
        name = self._path(f"{self.path}/manifests/{before + 1:012d}")
        draft = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(contents, sort_keys=True).encode()))
        out.close()
        self._fs.mkdirs(name.getParent())
        if self._fs.exists(name) or not self._fs.rename(draft, name):
            self._fs.delete(draft, False)
            raise ConcurrentWrite(f"manifest {before + 1} is there already")

    def revision(self, collection: str) -> str:
        return str(self.manifest()[1].get(collection, {}).get("version", 0))

    # ---------------------------------------------------------------------------------------------------------- reading
    def chunks(self, *collections: str) -> DataFrame:
        """Chunks of the given collections, or of all: only their folders are read."""
        held = self.manifest()[1]
        return self._live([p for c, v in sorted(held.items()) if not collections or c in collections for p in v["parts"]])

    def _live(self, parts: list[dict]) -> DataFrame:
        """The chunks of parts that no later part of their collection removes. Removals are keyed by collection and id."""
        folders = [f"{self.path}/{p['folder']}/chunks" for p in parts if p["chunks"]]
        if not folders:
            return self.spark.createDataFrame([], CHUNKS)
        found = self.spark.read.schema(f"{CHUNKS}, part long").parquet(*folders)
        removed = [f"{self.path}/{p['folder']}/gone" for p in parts if p["gone"]]
        if removed:
            gone = self.spark.read.schema(f"collection string, {GONE}").parquet(*removed)
            for key in ("doc_id", "chunk_id"):
                last = gone.where(F.col(key).isNotNull()).groupBy("collection", key).agg(F.max("part").alias("until"))
                found = found.join(last, ["collection", key], "left").where("until is null or part >= until").drop("until")
        return found.select(*NAMES)

    def iter_chunks(self, collection: str) -> DataFrame:
        return self.chunks(collection).orderBy("doc_name", "idx")

    def list_collections(self) -> DataFrame:
        """(name, documents, chunks) of each collection that has chunks, in order of name."""
        return collection_stats(self.chunks()).withColumnRenamed("collection", "name").orderBy("name")

    # ---------------------------------------------------------------------------------------------------------- writing
    def _write(self, touched: dict[str, tuple[DataFrame | None, DataFrame | None]], number: int, held: dict[str, dict]) -> None:
        """Adds a part (new chunks, removed ids) to each collection, then the manifest."""
        new = dict(held)
        for collection, (rows, gone) in touched.items():
            before = held.get(collection, {"version": 0, "dim": None, "parts": []})
            version = before["version"] + 1
            part = {"folder": f"data/{collection}/{version:012d}-{uuid.uuid4().hex[:8]}", "chunks": rows is not None, "gone": gone is not None}
            dim = before["dim"]
            if gone is not None:
                gone.select(F.lit(collection).alias("collection"), "doc_id", "chunk_id", F.lit(version).cast("long").alias("part")).write.parquet(f"{self.path}/{part['folder']}/gone")
            if rows is not None:
                at = f"{self.path}/{part['folder']}/chunks"
                rows.select(*NAMES, F.lit(version).cast("long").alias("part")).write.parquet(at)
                figures = self.spark.read.schema(CHUNKS).parquet(at).agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
                if figures.lo is not None and (figures.lo != figures.hi or dim not in (None, figures.lo)):
                    raise DimensionMismatch(f"{collection}: vectors of {figures.lo} to {figures.hi} numbers, {dim or 'none'} so far")
                dim = dim or figures.lo
            parts = [*before["parts"], part]
            if len(parts) > MOST_PARTS:
                whole = {"folder": f"data/{collection}/{version:012d}-{uuid.uuid4().hex[:8]}", "chunks": True, "gone": False}
                self._live(parts).withColumn("part", F.lit(version).cast("long")).write.parquet(f"{self.path}/{whole['folder']}/chunks")
                parts = [whole]
            new[collection] = {"version": version, "dim": dim, "parts": parts}
        self._commit(number, new)

    def replace(self, documents: DataFrame, chunks: DataFrame) -> None:
        """All chunks of ``documents`` (collection, doc_id) give way to ``chunks``, which are theirs, in one step.

        A document without new chunks is gone afterwards. Only these documents' rows are written.
        """
        number, held = self.manifest()
        gone = documents.select("collection", "doc_id").distinct()
        touched = {}
        for c in [r.collection for r in gone.select("collection").distinct().collect()]:  # a row for each collection
            own = gone.where(F.col("collection") == c).withColumn("chunk_id", F.lit(None).cast("string"))
            touched[c] = chunks.where(F.col("collection") == c), own if c in held else None
        if touched:
            self._write(touched, number, held)

    def add(self, chunks: DataFrame) -> None:
        """Chunks put in the place of those with the same id, or beside the others. Each needs an embedding."""
        if not chunks.where(F.col("embedding").isNull()).isEmpty():
            raise ValueError("chunks without embeddings")
        number, held = self.manifest()
        touched = {}
        for c in [r.collection for r in chunks.select("collection").distinct().collect()]:
            own = chunks.where(F.col("collection") == c)
            touched[c] = own, own.select(F.lit(None).cast("string").alias("doc_id"), "chunk_id") if c in held else None
        if touched:
            self._write(touched, number, held)

    def delete_document(self, collection: str, doc_id: str) -> int:
        """How many chunks went; the revision changes only if any did."""
        number, held = self.manifest()
        n = self.chunks(collection).where(F.col("doc_id") == doc_id).count() if collection in held else 0
        if n:
            self._write({collection: (None, self.spark.createDataFrame([(doc_id, None)], "doc_id string, chunk_id string"))}, number, held)
        return n

    def vacuum(self) -> int:
        """Folders that the current manifest doesn't name are removed; only for times without readers."""
        named = {f"{self.path}/{p['folder']}" for v in self.manifest()[1].values() for p in v["parts"]}
        root, n = self._path(f"{self.path}/data"), 0
        for c in self._fs.listStatus(root) if self._fs.exists(root) else ():
            for v in self._fs.listStatus(c.getPath()):
                if not any(v.getPath().toString().endswith(f) for f in named):
                    n += self._fs.delete(v.getPath(), True)
        return n

    def close(self) -> None:
        """Nothing is held open."""


def collection_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"))
