"""Keyword search, vector search, fusion and re-ranking, for all questions of a table at once.

Questions are rows (query_id, collection, question[, q_embedding]); results are rows ranked from 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..store import materialised

#: Up to so many questions of one batch are sent to the executors as one matrix.
QUERY_BLOCK = 4096
SCORE_UNITS = 1 << 40
#: Vectors of more numbers than this are compared by products of matrices.
FEW_NUMBERS = 32


def beside(queries: DataFrame, *derived: DataFrame) -> list[DataFrame]:
    """Tables with a bounded number of rows for each question, to be broadcast if there are few enough questions.

    The other side of their joins (postings, chunks) grows with the data and stays where it is then. Beyond
    QUERY_BLOCK questions the joins shuffle by their keys.
    """
    few = queries.select("query_id").limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK
    return [F.broadcast(x) if few else x for x in derived]


class KeywordIndex(NamedTuple):
    """Tables of a BM25 index; each is partitioned work of its own, none is held by a process."""

    postings: DataFrame  # collection, term, chunk_id, doc_name, idx, tf, dl
    terms: DataFrame  # collection, term, df
    collections: DataFrame  # collection, n, avgdl


def keyword_index(chunks: DataFrame, text: Column | None = None) -> KeywordIndex:
    """Postings, document frequencies and corpus figures of chunks (collection, chunk_id, doc_name, idx, ...).

    Chunks without tokens count as documents. A chunk's tokens stand in one row, so they are sorted and counted there and
    postings need no shuffle; the other figures are counted before they are shuffled.
    """
    said = X.search_text(F.col("heading"), F.col("text")) if text is None else text
    toks = chunks.select("collection", "chunk_id", "doc_name", "idx", F.sort_array(X.tokenize(said)).alias("tokens")).withColumn("dl", F.size("tokens"))
    runs = toks.select("collection", "chunk_id", "doc_name", "idx", "dl", each(run_lengths("tokens")).alias("run")).where("run is not null")
    postings = runs.select("collection", "chunk_id", "doc_name", "idx", "dl", "run.term", "run.tf")
    return of_postings(chunks, postings)


def of_postings(chunks: DataFrame, postings: DataFrame) -> KeywordIndex:
    terms = postings.groupBy("collection", "term").agg(F.count("*").alias("df"))
    sums = postings.groupBy("collection").agg(F.sum("tf").alias("all"))
    figures = chunks.groupBy("collection").agg(F.count("*").alias("n")).join(sums, "collection", "left").select("collection", "n", (F.coalesce("all", F.lit(0)) / F.col("n")).alias("avgdl"))
    return KeywordIndex(postings, terms, figures)


def kept_index(chunks: DataFrame, text: Column | None = None) -> KeywordIndex:
    """The same with its postings written once below the session's shared folder, for searches that read them again."""
    return of_postings(chunks, materialised(keyword_index(chunks, text).postings))


def run_lengths(tokens: str) -> Column:
    """The different elements of a sorted array with how often each stands there, as structs (term, tf)."""
    t = F.col(tokens)
    starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
    counted = X.let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(t, i - 1).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(t) + 1) - i).cast("long").alias("tf"))))
    return F.when(F.size(t) > 0, counted)


def each(array: str | Column) -> Column:
    """The elements of an array, null for an empty one.

    Unlike ``explode`` it has Spark infer no filter on the array's size, for which the array would be computed twice.
    """
    return F.explode_outer(array)


def idf(n: Column, df: Column) -> Column:
    """Always positive: ln(1 + (N - n + 0.5) / (n + 0.5))."""
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def keyword_search(queries: DataFrame, index: KeywordIndex, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k best chunks of each question with a positive score.

    A token said twice counts twice. Ties go by document name and place in it. Contributions are added as whole multiples
    of 2 ** -40, so scores don't depend on the order of rows and are summed before they are shuffled.
    """
    asked = queries.select("query_id", "collection", F.explode(X.tokenize(F.col("question"))).alias("term")).groupBy("query_id", "collection", "term").agg(F.count("*").alias("times"))
    (asked,) = beside(queries, asked)
    weighed = index.terms.join(asked, ["collection", "term"]).join(index.collections, "collection")
    (weighed,) = beside(queries, weighed)
    met = index.postings.join(weighed, ["collection", "term"])
    tf = F.col("tf")
    part = idf(F.col("n"), F.col("df")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    units = F.sum(F.round(part * F.col("times") * SCORE_UNITS).cast("long"))
    scored = met.groupBy("query_id", "chunk_id", "doc_name", "idx").agg((units / F.lit(float(SCORE_UNITS))).alias("score")).where("score > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_name", "idx", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    """Length of a vector; a zero vector counts as having length one."""
    return X.let(F.sqrt(dot(a, a)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def check_dimension(embedding: Column, query: Column) -> Column:
    """The embedding, or an error where its dimension isn't the question's."""
    return F.when(F.size(embedding) == F.size(query), embedding).otherwise(F.raise_error(F.concat(F.lit("dimension mismatch: "), F.size(embedding), F.lit(" and "), F.size(query))))


def vector_search(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k nearest chunks of each question, exactly; ties go by chunk id.

    There is no least similarity. Questions are broadcast to the chunks, and Spark cuts each task's rows to k for each
    question before it shuffles them. More questions than QUERY_BLOCK, and long vectors, go by blocks.
    """
    q = queries.select("query_id", "collection", "q_embedding")
    figures = q.limit(QUERY_BLOCK + 1).agg(F.count("*").alias("n"), F.max(F.size("q_embedding")).alias("dim")).first()
    if figures.n > QUERY_BLOCK or (figures.dim or 0) > FEW_NUMBERS:
        return vector_search_blocks(queries, chunks, k)
    # Lengths are computed before the vectors meet, once for each.
    asked = q.withColumn("_q_norm", norm(F.col("q_embedding")))
    met = chunks.select("collection", "chunk_id", "embedding", norm(F.col("embedding")).alias("_norm")).join(F.broadcast(asked), "collection")
    score = dot(check_dimension(F.col("embedding"), F.col("q_embedding")), F.col("q_embedding")) / (F.col("_norm") * F.col("_q_norm"))
    scored = met.select("query_id", "chunk_id", score.alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def vector_search_blocks(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The same for many questions: each batch of chunks meets a block of questions in one matrix product.

    Questions are taken in blocks of QUERY_BLOCK, so what is sent out is bounded; each batch gives k rows for each
    question at most.
    """
    rows = queries.select("query_id", "collection", "q_embedding").orderBy("query_id").toLocalIterator()
    results, block = [], []

    def search(some: list) -> DataFrame:
        by: dict[str, list] = {}
        for r in some:
            by.setdefault(r.collection, []).append(r)
        query_type, chunk_type = queries.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType
        shared = chunks.sparkSession.sparkContext.broadcast({c: ([r.query_id for r in rs], _units(np.array([r.q_embedding for r in rs], float))) for c, rs in by.items()})
        schema = T.StructType([T.StructField("query_id", query_type), T.StructField("chunk_id", chunk_type), T.StructField("score", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = np.array(batch.column(0).to_pylist(), object)
                for name in set(names) & set(shared.value):
                    own = np.flatnonzero(names == name)
                    ids, q = shared.value[name]
                    vectors = batch.column(2).take(pa.array(own))
                    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
                    if len(flat) != len(own) * q.shape[1]:
                        raise ValueError(f"dimension mismatch: {len(flat) / len(own):g} and {q.shape[1]}")
                    chunk_ids = np.array(batch.column(1).take(pa.array(own)).to_pylist(), object)
                    score = q @ _units(flat.reshape(len(own), -1)).T
                    rows, places = [], []
                    for i, s in enumerate(score):
                        least = np.partition(s, -k)[-k] if len(s) > k else -np.inf  # whatever ties with the k-th stays in
                        some = np.flatnonzero(s >= least)
                        top = some[np.lexsort((chunk_ids[some], -s[some]))[:k]]
                        rows.append(np.full(len(top), i))
                        places.append(top)
                    row, place = np.concatenate(rows), np.concatenate(places)
                    kinds = batch.schema.field(1).type
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in row]), pa.array(chunk_ids[place], kinds), pa.array(score[row, place])], names=schema.names)

        return chunks.where(F.col("collection").isin(*by)).select("collection", "chunk_id", "embedding").mapInArrow(run, schema)

    for r in rows:
        block.append(r)
        if len(block) == QUERY_BLOCK:
            results.append(search(block))
            block = []
    if block or not results:
        results.append(search(block))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _units(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1.0, length)


def vector_search_lsh(queries: DataFrame, chunks: DataFrame, k: int, dim: int, planes: int = 8, tables: int = 12, seed: int = 1, probes: int = 24) -> DataFrame:
    """Approximate vector search: only chunks in cells of random hyperplanes near the question are scored.

    Each table cuts space by ``planes`` hyperplanes. A chunk lies in one cell of each table; a question looks into the
    ``probes`` cells of each table that are nearest to it, by the squared distances from the planes between. More tables
    and probes find more, more planes compare less. A question for which no table's cells hold k chunks looks into all
    cells of the first table, and so meets every chunk.
    """
    normals = np.random.default_rng(seed).normal(size=(tables, planes, dim))
    bits = np.arange(1 << planes) >> np.arange(planes)[:, None] & 1
    first = np.arange(tables)[:, None] << planes

    def sides(vectors: pd.Series) -> np.ndarray:
        m = np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, dim))
        return np.einsum("nd,tpd->ntp", m, normals / np.linalg.norm(normals, axis=2, keepdims=True))

    @F.pandas_udf("array<bigint>")
    def cells(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(((sides(vectors) > 0) << np.arange(planes)).sum(2) + first[:, 0]))

    @F.pandas_udf("array<bigint>")
    def near(vectors: pd.Series) -> pd.Series:
        away = (np.where(s > 0, -s * s, s * s) @ bits for s in sides(vectors))  # less a constant for each table
        return pd.Series([(np.argsort(a, axis=1, kind="stable")[:, :probes] + first).ravel() for a in away], dtype=object)

    q = queries.select("query_id", "collection", F.explode(near("q_embedding")).alias("cell"))
    c = chunks.select("collection", "chunk_id", "embedding", norm(F.col("embedding")).alias("_norm"), F.explode(cells("embedding")).alias("cell"))
    sizes = c.groupBy("collection", "cell").agg(F.count("*").alias("n"))  # a row for each cell
    held = q.join(sizes, ["collection", "cell"]).groupBy("query_id", F.shiftright("cell", planes).alias("table")).agg(F.sum("n").alias("n"))
    enough = held.where(F.col("n") >= k).select("query_id").distinct()
    every = queries.join(enough, "query_id", "left_anti").select("query_id", "collection", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << planes) - 1).cast("long"))).alias("cell"))
    asked = q.join(enough, "query_id", "left_semi").unionByName(every).groupBy("collection", "cell").agg(F.collect_list("query_id").alias("ids"))
    asked, vectors = beside(queries, asked, queries.select("query_id", "q_embedding", norm(F.col("q_embedding")).alias("_q_norm")))
    met = c.join(asked, ["collection", "cell"]).select("chunk_id", "embedding", "_norm", F.explode("ids").alias("query_id")).join(vectors, "query_id")
    score = dot(F.col("embedding"), F.col("q_embedding")) / (F.col("_norm") * F.col("_q_norm"))
    scored = met.select("query_id", "chunk_id", score.alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    # Chunks met in several tables have equal rows, of one dense rank.
    return scored.withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= k).distinct()


def fuse(lists: list[DataFrame], k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: (query_id, chunk_id, score, vector_rank, keyword_rank, rank) of lists of ranked rows.

    The score is the sum over the lists of weight / (k + rank), in the order of the lists; a list without the chunk
    adds nothing. Ranks in the first two lists are kept. Ties go by chunk id as a string.
    """
    weights = weights or [1.0] * len(lists)
    tagged = [x.select("query_id", "chunk_id", F.col("rank").alias("_rank"), F.lit(i).alias("_list")) for i, x in enumerate(lists)]
    union = tagged[0]
    for x in tagged[1:]:
        union = union.unionByName(x)
    ranks = [F.max(F.when(F.col("_list") == i, F.col("_rank"))).alias(f"_r{i}") for i in range(len(lists))]
    merged = union.groupBy("query_id", "chunk_id").agg(*ranks)
    score = sum((F.coalesce(F.lit(float(w)) / (k + F.col(f"_r{i}")), F.lit(0.0)) for i, w in enumerate(weights)), F.lit(0.0))
    none = F.lit(None).cast("int")
    out = merged.select("query_id", "chunk_id", score.alias("score"), F.col("_r0").alias("vector_rank"), (F.col("_r1") if len(lists) > 1 else none).alias("keyword_rank"))
    return ranked(out)


def ranked(results: DataFrame, *then: str) -> DataFrame:
    """``results`` with ``rank`` by score, then by the given columns, then by chunk id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *then, F.col("chunk_id").cast("string"))
    return results.withColumn("rank", F.row_number().over(order))


Reranker = Callable[[DataFrame], DataFrame]


def no_rerank(candidates: DataFrame) -> DataFrame:
    return candidates


def overlap_rerank(weight: float = 0.5) -> Reranker:
    """Blends the score, scaled by the question's best one, with the share of the question's tokens that a chunk holds.

    Questions without tokens keep their order and scores. Candidates are rows with question, heading and text.
    """

    def run(candidates: DataFrame) -> DataFrame:
        asked = F.array_distinct(X.tokenize(F.col("question")))
        held = X.tokenize(X.search_text(F.col("heading"), F.col("text")))
        best = F.max("score").over(Window.partitionBy("query_id"))
        top = F.when(best == 0, F.lit(1.0)).otherwise(best)
        prepared = candidates.withColumn("_q", asked).withColumn("_n", F.size("_q")).withColumn("_cover", F.size(F.array_intersect("_q", held)) / F.nullif("_n", F.lit(0))).withColumn("_top", top)
        blended = (1 - weight) * (F.col("score") / F.col("_top")) + weight * F.col("_cover")
        scored = prepared.withColumn("score", F.when(F.col("_n") > 0, blended).otherwise(F.col("score"))).withColumnRenamed("rank", "_before")
        again = F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(F.col("_n") > 0, -F.col("score")), "_before"))
        return scored.withColumn("rank", again).drop("_q", "_n", "_cover", "_top", "_before")

    return run


def group_rerank(score: Callable[[str, list[str]], list[float]]) -> Reranker:
    """A re-ranker from a Python function (question, texts) -> scores, run for each question's candidates."""

    def run(candidates: DataFrame) -> DataFrame:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("rank")
            pdf["score"] = score(pdf.question.iloc[0], pdf.text.tolist())
            pdf = pdf.sort_values("score", ascending=False, kind="stable")
            return pdf.assign(rank=range(1, len(pdf) + 1))

        return candidates.groupBy("query_id").applyInPandas(one, candidates.schema)

    return run


RERANKERS: dict[str, Callable[[], Reranker]] = {"none": lambda: no_rerank, "overlap": overlap_rerank}


def reranker(name: str) -> Reranker:
    if name not in RERANKERS:
        raise ValueError(f"no re-ranker {name}; there are {', '.join(RERANKERS)}")
    return RERANKERS[name]()


def hybrid_search(queries: DataFrame, chunks: DataFrame, index: KeywordIndex | None, top_k: int = 5, candidate_k: int = 20, rrf_k: int = 60, mode: str = "hybrid", rerank: Reranker = no_rerank) -> DataFrame:
    """The top_k chunks of each question, with their columns: vector and keyword candidates, fused, then re-ranked."""
    if mode not in ("hybrid", "vector", "keyword"):
        raise ValueError("mode must be hybrid, vector or keyword")
    n = max(candidate_k, top_k)
    none = queries.select("query_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0).alias("rank")).where("false")
    vector = vector_search(queries, chunks, n) if mode != "keyword" else none
    keyword = keyword_search(queries, index, n) if mode != "vector" and index is not None else none
    fused = fuse([vector, keyword], rrf_k)
    asked, fused = beside(queries, queries.select("query_id", "question"), fused)
    full = chunks.drop("embedding").join(fused, "chunk_id").join(asked, "query_id")
    return rerank(full).where(F.col("rank") <= top_k)
