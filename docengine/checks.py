"""More queries with their SQL: files of every kind, chunks, stores, whole retrieval, answers and their measures.

Files are written from the documents' whole texts, so what a reader must find in them is known from how they were made.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions import text as X
from .operators import access, answer, metrics
from .operators import search as S
from .operators.embed import embed
from .plans.engine import Engine
from .queries import _BM25, _COSINE, _EXPECTED, _TOP5, ORACLES, QUERIES, _chunks, _measured, _questions, _results, _sentences, _tokens, query, table
from .sources import files, samples
from .store import ChunkStore, shared_folder

_KW = _BM25.rstrip().rstrip(",")


# ------------------------------------------------------------------------------------------------------------------ files
#: Letters, digits and single blanks of a text, so that nothing in it means anything to a reader.
_FLAT = "trim(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def _flat(c):
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9 ]", " "), " +", " "))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, name, content): each document as a file of one of five kinds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", _flat(F.col("text")).alias("flat"))
    d = F.col("doc_id").cast("string")

    @F.pandas_udf("binary")
    def packed(kind: pd.Series, flat: pd.Series, lang: pd.Series, source: pd.Series, no: pd.Series) -> pd.Series:
        def of(k, f, la, so, n) -> bytes:
            if k == 3:
                return samples.docx([("Title", la), (None, f), ("Heading1", so), (None, f"end of {n}")], [["number", n], ["", ""]])
            return samples.pdf([f, f"end of {n}."], f"T{n}") if k == 4 else b""

        return pd.Series([of(*row) for row in zip(kind, flat, lang, source, no)], dtype=object)

    kind = (F.col("doc_id") % 5).cast("int")
    md = F.concat(F.lit("# "), "lang", F.lit("\n\n"), "flat", F.lit("\n\n## "), "source", F.lit(" ##\n~~~\n# no heading\n~~~\nend of "), d, F.lit("\n"))
    page = F.concat(
        F.lit("<html><head><title>T"), d, F.lit("</title><script>if (a < b) {}</script></head><body><nav>menu</nav><h1>"), "lang", F.lit("</h1>\n<p>"), "flat",
        F.lit("<h3>"), "source", F.lit("</h3><ul><li>one</ul><table><tr><td>number</td><td>"), d, F.lit("</td></tr></table><footer>end</footer></body></html>"),
    )
    plain = F.encode(F.when(kind == 0, md).otherwise(page), "UTF-8")
    content = F.when(kind < 2, plain).when(kind == 2, F.encode("flat", "UTF-16")).otherwise(packed(kind, "flat", "lang", "source", d))
    suffix = F.element_at(F.array(*map(F.lit, (".md", ".HTML", ".txt", ".docx", ".pdf"))), kind + 1)
    return docs.select("doc_id", F.concat(d, suffix).alias("name"), content.alias("content"))


@query(f"""WITH d AS (SELECT doc_id, lang, source, doc_id % 5 AS k, {_FLAT.format('text')} AS flat FROM documents),
parts AS (SELECT doc_id, k, 0 AS no, CASE WHEN k = 4 THEN 1 ELSE 0 END AS page, CASE WHEN k IN (0, 1, 3) THEN lang ELSE '' END AS heading, flat AS text, lang FROM d
 UNION ALL SELECT doc_id, k, 1, CASE WHEN k = 4 THEN 2 ELSE 0 END, CASE WHEN k = 4 THEN '' ELSE lang || ' > ' || source END,
  CASE k WHEN 0 THEN '~~~' || chr(10) || '# no heading' || chr(10) || '~~~' || chr(10) || 'end of ' || doc_id WHEN 1 THEN '- one' || chr(10) || chr(10) || 'number | ' || doc_id
  WHEN 3 THEN 'end of ' || doc_id || chr(10) || chr(10) || 'number | ' || doc_id ELSE 'end of ' || doc_id || '.' END, lang FROM d WHERE k <> 2)
SELECT doc_id, CASE WHEN k IN (0, 3) THEN lang WHEN k = 2 THEN '' ELSE 'T' || doc_id END AS title, CASE WHEN k = 4 THEN 2 ELSE 0 END::INT AS pages, (row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1)::INT AS sec_idx, page::INT AS page, heading, text
FROM parts WHERE text <> ''""")
def parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reader: Markdown, HTML, text in UTF-16, DOCX and PDF."""
    parsed = files.parse(_files(spark, sf_dir))
    found = parsed.select("name", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("pages", F.lit(0)).alias("pages"), F.posexplode("sections").alias("sec_idx", "s"))
    return found.select(F.regexp_extract("name", "^[0-9]+", 0).cast("long").alias("doc_id"), "title", "pages", "sec_idx", F.coalesce("s.page", F.lit(0)).alias("page"), F.coalesce("s.heading", F.lit("")).alias("heading"), "s.text")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'UnsupportedFileType' ELSE 'DocumentParseError' END AS error_kind FROM documents")
def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.concat(d.cast("string"), F.when(d % 3 == 0, ".txt").when(d % 3 == 1, ".xyz").otherwise(".pdf"))
    given = table(spark, sf_dir, "documents").select(name.alias("name"), F.encode("text", "UTF-8").alias("content"))
    return files.parse(given, strict=False).select(F.regexp_extract("name", "^[0-9]+", 0).cast("long").alias("doc_id"), F.coalesce("error_kind", F.lit("")).alias("error_kind"))


# ----------------------------------------------------------------------------------------------------------------- chunks
def _chunk_sql(size: int, overlap: int) -> str:
    """Chunks by arithmetic on positions: the parts of a text lie on one line; a chunk is an interval of it."""
    last = "string_split(a, chr(1))[-1]"
    pieces = f"array_to_string(list_transform(range(0, (length(w) - 1) // {size} * {size} + 1, {size}), lambda i: substr(w, (i + 1)::INT, {size})), chr(1))"
    lines = (
        f"string_split(list_reduce(string_split(s, ' '), lambda a, w: CASE WHEN length(w) > {size} THEN a || CASE WHEN {last} = '' THEN '' ELSE chr(1) END || {pieces} "
        f"WHEN {last} <> '' AND length({last}) + 1 + length(w) > {size} THEN a || chr(1) || w WHEN {last} <> '' THEN a || ' ' || w ELSE a || w END, ''), chr(1))"
    )
    return f"""
WITH RECURSIVE d AS (SELECT lang AS collection, source || '-' || doc_id AS doc_name, text FROM documents),
paras AS (SELECT doc_name, unnest(range(len(ps))) AS pn, trim(regexp_replace(unnest(ps), '^\\s+|\\s+$', '', 'g')) AS p FROM (SELECT doc_name, string_split_regex(text, '\\n\\s*\\n') AS ps FROM d)),
sents AS (SELECT doc_name, pn, unnest(range(len(ss))) AS sn, unnest(ss) AS s FROM (SELECT doc_name, pn, CASE WHEN length(p) <= {size} THEN [p] ELSE {_sentences('p')} END AS ss FROM paras WHERE p <> '')),
units AS (SELECT doc_name, pn, sn, unnest(range(len(us))) AS un, unnest(us) AS u FROM (SELECT doc_name, pn, sn, CASE WHEN length(s) <= {size} THEN [s] ELSE {lines} END AS us FROM sents)),
gaps AS (SELECT *, CASE WHEN lag(pn) OVER w IS NULL THEN '' WHEN lag(pn) OVER w = pn THEN ' ' ELSE chr(10) || chr(10) END AS gap FROM units WINDOW w AS (PARTITION BY doc_name ORDER BY pn, sn, un)),
places AS (SELECT *, sum(length(gap) + length(u)) OVER (PARTITION BY doc_name ORDER BY pn, sn, un) AS e FROM gaps),
line AS (SELECT doc_name, string_agg(gap || u, '' ORDER BY pn, sn, un) AS whole, list(e::BIGINT ORDER BY pn, sn, un) AS ends, list((e - length(u))::BIGINT ORDER BY pn, sn, un) AS starts, count(*) AS n FROM places GROUP BY doc_name),
c AS (SELECT doc_name, 0 AS idx, 1::BIGINT AS a, list_max(list_filter(range(1, n + 1), lambda i: ends[i] - starts[1] <= {size}))::BIGINT AS b FROM line
 UNION ALL SELECT doc_name, idx + 1, a2, list_max(list_filter(range(a2, n + 1), lambda i: ends[i] - starts[a2] <= {size}))::BIGINT
 FROM (SELECT *, CASE WHEN again IS NOT NULL AND ends[b + 1] - starts[again] <= {size} THEN again ELSE b + 1 END AS a2
  FROM (SELECT c.doc_name, idx, b, n, ends, starts, list_min(list_filter(range(a, b + 1), lambda i: ends[b] - starts[i] <= {overlap}))::BIGINT AS again FROM c JOIN line USING (doc_name) WHERE b < n)))
SELECT left(sha256(collection || '/' || doc_name), 16) || ':' || idx AS chunk_id, collection, left(sha256(collection || '/' || doc_name), 16) AS doc_id, doc_name, idx::INT AS idx, substr(whole, (starts[a] + 1)::INT, (ends[b] - starts[a])::INT) AS text
FROM c JOIN line USING (doc_name) JOIN d USING (doc_name)"""


ORACLES["chunk_texts"] = _chunk_sql(500, 80)


# ----------------------------------------------------------------------------------------------------------------- stores
def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a chunk with a short vector; documents of a store are sources."""
    docs = table(spark, sf_dir, "documents")
    none = F.lit(None)
    return docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("collection"), F.col("source").alias("doc_id"), F.col("source").alias("doc_name"), F.col("doc_id").cast("int").alias("idx"),
                       "text", none.cast("int").alias("page"), none.cast("string").alias("heading"), F.create_map(F.lit("n"), F.col("n_chars").cast("string")).alias("metadata"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))


@query("""WITH one AS (SELECT doc_id AS no, lang, source, text FROM documents WHERE lang IN ('en', 'de', 'fr')),
two AS (SELECT no, lang, source, CASE WHEN no % 10 = 0 THEN text || '!' ELSE text END AS text FROM one UNION ALL SELECT doc_id, lang, source, text FROM documents WHERE lang = 'es'),
three AS (SELECT no, lang, source, text FROM two WHERE NOT (source = 'src3' AND lang IN ('en', 'es')) UNION ALL SELECT no, lang, source, 'x' || text FROM two WHERE source = 'src3' AND lang = 'en' AND no % 2 = 0),
four AS (SELECT * FROM three WHERE NOT (source = 'src5' AND lang = 'en'))
SELECT lang AS collection, source AS doc_id, no::VARCHAR AS chunk_id, text, CASE lang WHEN 'en' THEN CASE WHEN (SELECT count(*) FROM three WHERE source = 'src5' AND lang = 'en') > 0 THEN '4' ELSE '3' END WHEN 'es' THEN '2' ELSE '2' END AS revision FROM four""")
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks added, put in place of others, documents replaced and deleted; what is left with its collection's revision."""
    chunks = _stored(spark, sf_dir)
    store = ChunkStore(spark, f"{shared_folder(spark)}/checks-{uuid.uuid4().hex}")
    store.add(chunks.where("collection in ('en', 'de', 'fr')"))
    tenth = chunks.where("collection in ('en', 'de', 'fr') and idx % 10 = 0").withColumn("text", F.concat("text", F.lit("!")))
    store.add(tenth.unionByName(chunks.where("collection = 'es'")))
    gone = spark.createDataFrame([("en", "src3"), ("es", "src3")], "collection string, doc_id string")
    store.replace(gone, store.chunks("en").where("doc_id = 'src3' and idx % 2 = 0").withColumn("text", F.concat(F.lit("x"), "text")))
    store.delete_document("en", "src5")
    store.delete_document("en", "no such document")
    revisions = F.create_map(*[F.lit(x) for c in ("en", "de", "fr", "es") for x in (c, store.revision(c))])
    return store.chunks().select("collection", "doc_id", "chunk_id", "text", revisions[F.col("collection")].alias("revision"))


@query("SELECT (row_number() OVER (ORDER BY source, doc_id) - 1)::BIGINT AS place, source AS doc_name, doc_id::INT AS idx, n_chars::VARCHAR AS n FROM documents WHERE lang = 'de'")
def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection in the order of its documents, with its chunks' metadata."""
    store = ChunkStore(spark, f"{shared_folder(spark)}/checks-{uuid.uuid4().hex}")
    store.add(_stored(spark, sf_dir))
    found = store.iter_chunks("de").select("doc_name", "idx", F.col("metadata")["n"].alias("n"))
    place = F.row_number().over(S.Window.orderBy("doc_name", "idx")) - 1  # one collection of this check, in one order
    return found.select(place.cast("long").alias("place"), "doc_name", "idx", "n")


@query("SELECT lang AS name, count(DISTINCT source) AS documents, count(*) AS chunks, (row_number() OVER (ORDER BY lang))::INT AS place FROM documents GROUP BY lang")
def store_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ChunkStore(spark, f"{shared_folder(spark)}/checks-{uuid.uuid4().hex}")
    store.add(_stored(spark, sf_dir))
    rows = store.list_collections().collect()  # a row for each collection
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], "name string, documents long, chunks long, place int")


# -------------------------------------------------------------------------------------------------------------- retrieval
_HYBRID = f"""{_BM25} vecs AS (SELECT e.vec_id AS doc_id, e.embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
near AS (SELECT q.item_id, e.doc_id, {_COSINE} AS s FROM (SELECT item_id, v.embedding FROM benchmark JOIN vecs v ON v.doc_id = item_id) q CROSS JOIN vecs e),
vr AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM near) WHERE rank <= 20),
fused AS (SELECT item_id, doc_id, coalesce(1.0::DOUBLE / (60 + vr.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + kw.rank), 0.0) AS raw, vr.rank AS vector_rank, kw.rank AS keyword_rank FROM vr FULL OUTER JOIN kw USING (item_id, doc_id)),
was AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(raw, 12) DESC, doc_id::VARCHAR) AS was FROM fused),
blend AS (SELECT w.*, 0.5 * (raw / max(raw) OVER (PARTITION BY w.item_id)) + 0.5 * (len(list_intersect(q, t)) / len(q)) AS score FROM was w
 JOIN (SELECT item_id, list_distinct({_tokens('text')}) AS q FROM benchmark) USING (item_id) JOIN (SELECT doc_id, {_tokens('text')} AS t FROM documents) USING (doc_id))
SELECT item_id AS query_id, doc_id::VARCHAR AS chunk_id, round(score, 6) AS score, coalesce(vector_rank, 0)::INT AS vector_rank, coalesce(keyword_rank, 0)::INT AS keyword_rank, (row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, was))::INT AS rank FROM blend"""


@query(f"SELECT * FROM ({_HYBRID}) WHERE rank <= 5")
def hybrid_given_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both searches, fusion and re-ranking, with the vectors of the table of embeddings."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("no"), "embedding")
    plain = _chunks(spark, sf_dir)
    index = S.kept_index(plain.withColumn("chunk_id", F.lpad(F.col("chunk_id").cast("string"), 12, "0")))
    asked = _questions(spark, sf_dir).join(vectors.withColumnsRenamed({"no": "query_id", "embedding": "q_embedding"}), "query_id", "left")
    chunks = plain.join(vectors, plain.chunk_id == vectors.no, "left").drop("no").withColumn("chunk_id", F.lpad(F.col("chunk_id").cast("string"), 12, "0"))
    n = 20
    known = S.vector_search(asked.where("q_embedding is not null"), chunks.where("embedding is not null"), n)
    names = lambda df: df.withColumn("chunk_id", F.col("chunk_id").cast("long").cast("string"))
    fused = S.fuse([names(known), names(S.keyword_search(asked, index, n))])
    full = names(chunks.drop("embedding")).join(fused, "chunk_id").join(asked.select("query_id", "question"), "query_id")
    found = S.reranker("overlap")(full).where("rank <= 5")
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"), F.coalesce("keyword_rank", F.lit(0)).alias("keyword_rank"), "rank")


@query("SELECT count(*) AS questions, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the approximate index finds nine tenths of the ten nearest neighbours that brute force finds."""
    found, true = (QUERIES[n](spark, sf_dir).select("query_id", "chunk_id") for n in ("cosine_topk_lsh", "cosine_topk"))
    both = true.join(found.withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("questions"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query(f"""{_TOP5}, lens AS (SELECT item_id, doc_id, length(text) AS n, rank AS was FROM top5)
SELECT item_id AS query_id, doc_id::VARCHAR AS chunk_id, (row_number() OVER (PARTITION BY item_id ORDER BY n DESC, was))::INT AS rank FROM lens""")
def rerank_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A re-ranker from a plain function: longer texts first, ties as before."""
    candidates = _results(spark, sf_dir).join(_questions(spark, sf_dir).select("query_id", "question"), "query_id").select("query_id", "chunk_id", "question", "text", F.col("score").cast("double").alias("score"), "rank")
    return S.group_rerank(lambda question, texts: [float(len(t)) for t in texts])(candidates).select("query_id", "chunk_id", "rank")


class _Lengths:
    """A provider of vectors (length, number of the text in its batch)."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        if len(texts) > 7:
            raise ValueError("more texts than a batch holds")
        return [[float(len(t)), 1.0] for t in texts]


@query("SELECT doc_id, length(text)::DOUBLE AS first, 2 AS dim FROM documents")
def provider_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of a provider, asked for seven texts at a time."""
    docs = embed(table(spark, sf_dir, "documents"), F.col("text"), _Lengths(), batch_size=7)
    return docs.select("doc_id", F.col("embedding")[0].cast("double").alias("first"), F.size("embedding").alias("dim"))


#: Chunks of the engine are whole texts here; a document is named by its source and number.
_ENGINE_KW = _BM25.replace("toks AS (SELECT doc_id, source,", "toks AS (SELECT doc_id, source || '-' || doc_id || '.txt' AS source,")


@query(f"SELECT item_id AS query_id, source AS doc_name, round(1.0::DOUBLE / (60 + rank), 9) AS score, rank::INT AS rank FROM ({_ENGINE_KW.rstrip().rstrip(',')} SELECT * FROM kw) WHERE rank <= 5")
def engine_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: files ingested into a store, its index built, questions asked."""
    engine = Engine(spark, Settings(chunk_size=10_000_000, chunk_overlap=0, embedding_dim=8))
    d = table(spark, sf_dir, "documents")
    engine.ingest_files("all", d.select(F.concat_ws("-", "source", F.concat("doc_id", F.lit(".txt"))).alias("name"), F.encode("text", "UTF-8").alias("content")))
    found = engine.retrieve(_questions(spark, sf_dir), 5, "keyword")
    return found.select("query_id", "doc_name", F.round("score", 9).alias("score"), "rank")


# ---------------------------------------------------------------------------------------------------------------- answers
_ANSWERS = f"ans AS ({ORACLES['extractive_answer']})"
_REFS_OF = r"list_transform(regexp_extract_all({0}, '\[(\d+)\]', 1), lambda y: y::INT)"


ORACLES["cited_answers"] = rf"""{_TOP5}, {_ANSWERS},
refs AS (SELECT query_id, unnest(list_distinct_in_order) AS ref, unnest(range(len(list_distinct_in_order))) AS place FROM (SELECT query_id, list_filter(r, lambda y, i: list_position(r, y) = i AND y BETWEEN 1 AND n) AS list_distinct_in_order
 FROM (SELECT query_id, {_REFS_OF.format('answer')} AS r, (SELECT count(*) FROM top5 WHERE item_id = query_id) AS n FROM ans)))
SELECT query_id, place::INT AS "at", ref, source AS document, doc_id::VARCHAR AS chunk_id, page, round(score, 6) AS score, CASE WHEN length(text) > 300 THEN rtrim(left(text, 300), chr(9) || chr(10) || chr(13) || ' ') || '...' ELSE text END AS snippet
FROM refs JOIN top5 ON item_id = query_id AND rank = ref"""

_MOVED = r"regexp_replace(answer, '([.!?])\s*((?:\[\d+(?:\s*,\s*\d+)*\]\s*)*\[\d+(?:\s*,\s*\d+)*\])\s*', ' \2\1 ', 'g')"
_PLAIN = r"trim(regexp_replace(regexp_replace({0}, '\[(\d+(?:\s*,\s*\d+)*)\]', '', 'g'), '\s{{2,}}', ' ', 'g'))"

ORACLES["answer_metrics"] = rf"""{_TOP5}, {_EXPECTED}, {_ANSWERS},
held AS (SELECT item_id, rank, {_tokens('text')} AS t FROM top5),
said AS (SELECT query_id, unnest(range(len(ss))) AS no, unnest(ss) AS s FROM (SELECT query_id, {_sentences(_MOVED)} AS ss FROM ans WHERE answer <> 'I could not find the answer in the provided documents.')),
judged AS (SELECT query_id, no, list_distinct({_tokens(_PLAIN.format('s'))}) AS t, list_distinct(list_filter({_REFS_OF.format('s')}, lambda y: y BETWEEN 1 AND 5)) AS r FROM said),
cited AS (SELECT query_id, no, flatten(list(h.t)) AS ct FROM judged JOIN held h ON h.item_id = query_id AND list_contains(r, h.rank::INT) GROUP BY query_id, no),
ground AS (SELECT query_id, avg(CASE WHEN ct IS NOT NULL AND len(list_intersect(t, ct)) / len(t) >= 0.6::DOUBLE THEN 1.0 ELSE 0.0 END) AS groundedness, avg(CASE WHEN ct IS NOT NULL THEN 1.0 ELSE 0.0 END) AS citation_coverage
 FROM judged LEFT JOIN cited USING (query_id, no) WHERE len(t) > 0 GROUP BY query_id),
refs AS (SELECT DISTINCT query_id, unnest({_REFS_OF.format('answer')}) AS ref FROM ans),
firsts AS (SELECT query_id, ref, list_position({_REFS_OF.format('answer')}, ref) AS place FROM refs JOIN ans USING (query_id)),
cites AS (SELECT f.query_id, place, source || CASE WHEN page <> 0 THEN '#p' || page ELSE '' END AS label, EXISTS (SELECT 1 FROM ex WHERE ex.item_id = f.query_id AND ex.document = source AND (ex.page IS NULL OR ex.page = top5.page)) AS good FROM firsts f JOIN top5 ON top5.item_id = f.query_id AND rank = ref),
prec AS (SELECT query_id, avg(CASE WHEN good THEN 1.0 ELSE 0.0 END) AS citation_precision, string_agg(label, ',' ORDER BY place) AS cited FROM cites GROUP BY query_id),
got AS (SELECT item_id AS query_id, string_agg(source || CASE WHEN page <> 0 THEN '#p' || page ELSE '' END, ',' ORDER BY rank) AS retrieved FROM top5 GROUP BY item_id),
pair AS (SELECT query_id, {_tokens(_PLAIN.format('answer'))} AS p, {_tokens('b.text')} AS r FROM ans JOIN benchmark b ON b.item_id = query_id),
same AS (SELECT query_id, list_sum(list_transform(list_distinct(list_intersect(p, r)), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(r, lambda x: x = t))))) AS s FROM pair)
SELECT query_id, round(groundedness, 9) AS groundedness, round(citation_coverage, 9) AS citation_coverage, round(citation_precision, 9) AS citation_precision,
 round(CASE WHEN coalesce(s, 0) > 0 THEN 2 * (s / len(p)) * (s / len(r)) / (s / len(p) + s / len(r)) ELSE 0.0 END, 9) AS answer_f1, round(CASE WHEN len(r) > 0 THEN len(list_filter(r, lambda t: list_contains(p, t))) / len(r) ELSE 0.0 END, 9) AS answer_recall,
 answer <> 'I could not find the answer in the provided documents.' AS answered, coalesce(retrieved, '') AS retrieved, coalesce(cited, '') AS cited
FROM ans JOIN pair USING (query_id) JOIN same USING (query_id) LEFT JOIN ground USING (query_id) LEFT JOIN prec USING (query_id) LEFT JOIN got USING (query_id)"""


@query(f"""{_TOP5}, src AS (SELECT item_id, count(*) AS n, sum(length('[' || rank || '] source: ' || source || ' | page ' || page)) AS heads, sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS chars FROM top5 GROUP BY item_id)
SELECT b.item_id AS query_id, trim(b.text) AS question, coalesce(n, 0) AS sources, coalesce(heads, 0)::BIGINT AS heads, coalesce(chars, 0)::BIGINT AS chars FROM benchmark b LEFT JOIN src USING (item_id)""")
def prompt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts read back by the parser for models that are plain functions: what stands in them, by sums of lengths."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for no, message in zip(batch["query_id"], batch["prompt"]):
                question, found = answer.parse_prompt(message)
                rows.append((no, question, len(found), sum(len(f"[{ref}] source: {head}") for ref, head, _ in found), sum(len(text) for _, _, text in found)))
            yield pd.DataFrame(rows, columns=["query_id", "question", "sources", "heads", "chars"])

    return QUERIES["prompt_build"](spark, sf_dir).mapInPandas(read, "query_id long, question string, sources long, heads long, chars long")


class _Judge:
    """A model that grades by the length of what it is sent, and can't be read for every fifth message."""

    def chat(self, messages: list[dict[str, str]], temperature: float = 0.0, max_tokens: int = 512) -> str:
        n = len(messages[-1]["content"])
        return "no idea" if n % 5 == 0 else f'I say {{"score": {n % 13 / 10}, "reason": "n"}}'


@query(f"""{_TOP5}, {_ANSWERS}, src AS (SELECT item_id, string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS p FROM top5 GROUP BY item_id),
n AS (SELECT query_id, answer, length('SOURCES:' || chr(10) || coalesce(p, '') || chr(10) || chr(10) || 'QUESTION: ' || b.text || chr(10) || chr(10) || 'ANSWER: ' || answer) AS n FROM ans JOIN benchmark b ON b.item_id = query_id LEFT JOIN src ON src.item_id = query_id)
SELECT query_id, CASE WHEN answer = 'I could not find the answer in the provided documents.' OR n % 5 = 0 THEN -1.0 ELSE least(1.0, (n % 13) / 10.0) END::DOUBLE AS llm_judge FROM n""")
def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = answer.with_answers(answer.contexts(_questions(spark, sf_dir), _results(spark, sf_dir)))
    return answer.judge(answered, _Judge()).select("query_id", F.coalesce("llm_judge", F.lit(-1.0)).alias("llm_judge"))


class _Model:
    """A model that cites the source whose number the length of its message gives, or refuses."""

    def chat(self, messages: list[dict[str, str]], temperature: float = 0.0, max_tokens: int = 512) -> str:
        n = len(messages[-1]["content"])
        return X.NO_ANSWER if n % 4 == 0 else f"It is so [{n % 7}]."


@query(f"""WITH p AS ({ORACLES['prompt_build']}), t AS ({_TOP5} SELECT item_id, count(*) AS n FROM top5 GROUP BY item_id)
SELECT query_id, CASE WHEN coalesce(n, 0) = 0 OR length(prompt) % 4 = 0 THEN 'I could not find the answer in the provided documents.' ELSE 'It is so [' || (length(prompt) % 7) || '].' END AS answer,
 CASE WHEN coalesce(n, 0) = 0 OR length(prompt) % 4 = 0 THEN 0 WHEN length(prompt) % 7 BETWEEN 1 AND n THEN length(prompt) % 7 ELSE 0 END::INT AS cited FROM p LEFT JOIN t ON item_id = query_id""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model; numbers of sources that there aren't are no citations."""
    answered = answer.with_answers(answer.contexts(_questions(spark, sf_dir), _results(spark, sf_dir)), _Model())
    return answered.select("query_id", "answer", F.coalesce(F.get("citations", F.lit(0))["ref"], F.lit(0)).alias("cited"))


# --------------------------------------------------------------------------------------------------------------- measures
@query(f"{_TOP5}, {_EXPECTED} SELECT query_id FROM rows_ WHERE hit = 0")
def missed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.misses(_measured(spark, sf_dir)).select("query_id")


@query(f"{_TOP5}, {_EXPECTED}, f AS (SELECT round(avg(hit), 4) AS hit, round(avg(reciprocal_rank), 4) AS mrr FROM rows_) SELECT 'hit@3' AS gate FROM f WHERE hit < 0.5 UNION ALL SELECT 'mrr' FROM f WHERE mrr < 2.0 UNION ALL SELECT 'none such'")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = metrics.summary(_measured(spark, sf_dir), 3).first().asDict()
    failed = metrics.failed_gates(figures, {"hit@3": 0.5, "mrr": 2.0, "recall@3": None, "none such": 0.1})
    return spark.createDataFrame([(f.split(" is ")[0],) for f in failed], "gate string")


# -------------------------------------------------------------------------------------------------------- names and access
@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ' > ' || source || chr(10) || text ELSE text END AS said FROM documents")
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.when(F.col("doc_id") % 4 == 0, F.concat_ws(" > ", "lang", "source")).when(F.col("doc_id") % 4 == 2, F.concat_ws(" > ", "lang", "source")).when(F.col("doc_id") % 4 == 1, F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", X.search_text(heading, F.col("text")).alias("said"))


_NAMES_SQL = "CASE doc_id % 6 WHEN 0 THEN source WHEN 1 THEN lang || '_' || source WHEN 2 THEN '-' || lang WHEN 3 THEN lang || ' ' || source WHEN 4 THEN '' ELSE repeat('x', (doc_id % 130)::INT) END"


@query(f"SELECT doc_id, regexp_full_match({_NAMES_SQL}, '[A-Za-z0-9][A-Za-z0-9_-]{{0,63}}') AS valid FROM documents")
def collection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.when(d % 6 == 0, F.col("source")).when(d % 6 == 1, F.concat_ws("_", "lang", "source")).when(d % 6 == 2, F.concat(F.lit("-"), "lang")).when(d % 6 == 3, F.concat_ws(" ", "lang", "source")).when(d % 6 == 4, F.lit("")).otherwise(F.expr("repeat('x', cast(doc_id % 130 as int))"))
    return table(spark, sf_dir, "documents").select("doc_id", X.valid_collection(name).alias("valid"))


@query("SELECT doc_id, source || CASE WHEN doc_id % 3 > 0 THEN '#p' || (doc_id % 3) ELSE '' END AS label FROM documents")
def result_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.result_label(F.col("source"), F.when(F.col("doc_id") % 6 > 0, F.col("doc_id") % 3)).alias("label"))


@query("SELECT lang, key, key IN ('key-one', 'key-all') AND (key = 'key-all' OR lang IN ('en', 'de')) AS allowed FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (VALUES ('key-one'), ('key-all'), ('key-none'), ('')) k(key)")
def key_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who may see what, by the key that is presented."""
    keys = {"key-one": ["en", "de"], "key-all": ["*"]}

    def allowed(key: str, collection: str) -> bool:
        try:
            access.require(access.resolve_principal(keys, key), collection)
            return True
        except (access.Unauthorised, access.Forbidden):
            return False

    langs = [r.lang for r in table(spark, sf_dir, "documents").select("lang").distinct().collect()]  # a row for each collection
    return spark.createDataFrame([(c, k, allowed(k, c)) for c in langs for k in ("key-one", "key-all", "key-none", "")], "lang string, key string, allowed boolean")

