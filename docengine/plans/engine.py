"""The whole way: files to stored chunks, questions to cited answers, examples to measures."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import providers
from ..config import Settings
from ..functions import text as X
from ..operators import access, answer, metrics
from ..operators import search as S
from ..operators.chunk import ChunkingOptions, chunk_documents
from ..operators.embed import embed
from ..sources import dataset, files
from ..store import ChunkStore, shared_folder


class UploadTooLarge(ValueError):
    """More bytes than are taken at once (HTTP 413)."""


class BadQuestion(ValueError):
    """Not a question that can be asked (HTTP 422)."""


@dataclass
class Engine:
    """Settings, a store and, where settings name them, model providers."""

    spark: SparkSession
    settings: Settings = Settings()
    store: ChunkStore | None = None
    embedder: providers.EmbeddingProvider | None = None
    llm: providers.LLMProvider | None = None
    rerank: S.Reranker | None = None

    def __post_init__(self) -> None:
        s = self.settings
        self.store = self.store or ChunkStore(self.spark, s.store_path or f"{shared_folder(self.spark)}/store-{uuid.uuid4().hex}")
        self.embedder = self.embedder or providers.embeddings(s)
        self.llm = self.llm or providers.llm(s)
        self.rerank = self.rerank or S.reranker(s.reranker)
        self._indexes: dict[str, tuple[str, S.KeywordIndex]] = {}

    # ------------------------------------------------------------------------------------------------------------ ingest
    def ingest_files(self, collection: str, found: DataFrame, chunking: ChunkingOptions | None = None, strict: bool = True) -> DataFrame:
        """Rows (name, content[, path]) parsed, chunked, embedded and stored; returns a report, which is kept in the store, of a row for each document.

        Documents replace those of the same name. Of several rows of one name the one with the greatest path counts.
        """
        access.check_collection_name(collection)
        s = self.settings
        options = chunking or ChunkingOptions(s.chunk_size, s.chunk_overlap, s.heading_aware)
        parsed = files.parse(files.last_of_name(found.withColumn("name", X.base_name(F.col("name")))), strict).withColumn("collection", F.lit(collection)).persist()
        try:
            good = parsed.where("error is null")
            chunks = chunk_documents(good, options)
            vectors = embed(chunks, X.search_text(F.col("heading"), F.col("text")), self.embedder, s.embedding_batch_size, s.embedding_dim)
            ids = good.select("collection", X.doc_id(F.col("collection"), F.col("name")).alias("doc_id"))
            self.store.replace(ids, vectors)
            counts = self.store.chunks(collection).groupBy("doc_id").agg(F.count("*").alias("chunks"))
            report = parsed.select(F.col("name").alias("document"), X.doc_id(F.col("collection"), F.col("name")).alias("doc_id"), "pages", "error_kind", "error").join(counts, "doc_id", "left")
            rows = report.select("document", "doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), "pages", "error_kind", "error")
            folder = f"{self.store.path}/reports/{uuid.uuid4().hex}"
            rows.write.parquet(folder)
            return self.spark.read.schema(rows.schema).parquet(folder).orderBy("document")
        finally:
            parsed.unpersist()

    def ingest_path(self, collection: str, path: str, chunking: ChunkingOptions | None = None, strict: bool = True) -> DataFrame:
        return self.ingest_files(collection, files.scan(self.spark, path), chunking, strict)

    def ingest_bytes(self, collection: str, name: str, data: bytes, chunking: ChunkingOptions | None = None) -> DataFrame:
        if len(data) > self.settings.max_upload_mb << 20:
            raise UploadTooLarge(f"{name}: more than {self.settings.max_upload_mb} MB")
        return self.ingest_files(collection, self.spark.createDataFrame([(name, bytearray(data))], "name string, content binary"), chunking)

    # ------------------------------------------------------------------------------------------------------------- query
    def index(self, collection: str) -> S.KeywordIndex:
        """The collection's keyword index, built once for each revision."""
        revision = self.store.revision(collection)
        known = self._indexes.get(collection)
        if known is None or known[0] != revision:
            if known is not None:
                for t in known[1]:
                    t.unpersist()
            built = S.KeywordIndex(*[t.persist() for t in S.keyword_index(self.store.chunks(collection))])
            known = self._indexes[collection] = (revision, built)
        return known[1]

    def questions(self, collection: str, *asked: str) -> DataFrame:
        access.check_collection_name(collection)
        for q in asked:
            if not 1 <= len(q) <= 4000:
                raise BadQuestion("a question has 1 to 4000 characters")
        return self.spark.createDataFrame([(str(i), collection, q) for i, q in enumerate(asked)], "query_id string, collection string, question string")

    def retrieve(self, queries: DataFrame, top_k: int | None = None, mode: str = "hybrid", rerank: bool = True) -> DataFrame:
        """The best chunks of each row (query_id, collection, question)."""
        s = self.settings
        k = top_k or s.top_k
        if not 1 <= k <= 50:
            raise BadQuestion("top_k must be from 1 to 50")
        collections = [r.collection for r in queries.select("collection").distinct().collect()]
        chunks = self.store.chunks(*collections)
        indexes = [self.index(c) for c in collections]
        index = None
        for own in indexes:
            index = own if index is None else S.KeywordIndex(*[a.unionByName(b) for a, b in zip(index, own)])
        embedded = embed(queries, F.col("question"), self.embedder, s.embedding_batch_size, s.embedding_dim).withColumnRenamed("embedding", "q_embedding")
        return S.hybrid_search(embedded, chunks, index, k, s.candidate_k, s.rrf_k, mode, self.rerank if rerank else S.no_rerank)

    def answer(self, queries: DataFrame, top_k: int | None = None, mode: str = "hybrid", rerank: bool = True) -> DataFrame:
        """Each question with answer, citations and retrieved results."""
        asked = answer.contexts(queries, self.retrieve(queries, top_k, mode, rerank))
        return answer.with_answers(asked, self.llm, self.settings.llm_temperature, self.settings.llm_max_tokens)

    def collections(self, principal: access.Principal | None = None) -> DataFrame:
        found = self.store.list_collections()
        if principal is None or principal.is_admin:
            return found
        return found.where(F.col("name").isin(*principal.collections))

    def health(self) -> dict[str, str]:
        return {"status": "ok", "store": "parquet", "llm": self.settings.llm_provider, "embeddings": self.settings.embedding_provider}

    # -------------------------------------------------------------------------------------------------------- evaluation
    def evaluate(self, examples: DataFrame, collection: str | None = None, k: int = 5, mode: str = "hybrid", judge: providers.LLMProvider | None = None) -> DataFrame:
        """Examples (see sources.dataset) with answers and measures, all in one plan."""
        asked = dataset.with_expected(examples).withColumn("collection", F.coalesce("collection", F.lit(collection))).withColumn("query_id", F.col("id"))
        lost = asked.where("collection is null").select("id").head(1)
        if lost:
            raise ValueError(f"example {lost[0].id}: no collection given")
        queries = asked.select("query_id", "collection", "question")
        results = self.retrieve(queries, k, mode)
        full = answer.with_answers(answer.contexts(asked, results), self.llm, self.settings.llm_temperature, self.settings.llm_max_tokens)
        if judge is not None:
            full = answer.judge(full, judge)
        return metrics.with_metrics(full, k)
