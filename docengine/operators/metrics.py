"""Measures of retrieval and answers, as columns over one row for each question.

``retrieved`` and ``citations`` are arrays of citations, ``expected`` is an array of structs (document, page). The
arrays are bounded by top_k and by what an example lists, so array functions do without any shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def matches(c: Column, e: Column) -> Column:
    """Whether a result is an expected source: the same document, and the page where one is expected."""
    return F.coalesce((c["document"] == e["document"]) & (e["page"].isNull() | e["page"].eqNullSafe(c["page"])), F.lit(False))


def relevant(c: Column, expected: Column) -> Column:
    return F.exists(expected, lambda e: matches(c, e))


def first_relevant_rank(retrieved: Column, expected: Column) -> Column:
    ranks = F.transform(retrieved, lambda c, i: F.when(relevant(c, expected), i + 1))
    return F.array_min(ranks)


def hit_at_k(retrieved: Column, expected: Column, k: int) -> Column:
    return F.when(first_relevant_rank(retrieved, expected) <= k, 1.0).otherwise(0.0)


def reciprocal_rank(retrieved: Column, expected: Column) -> Column:
    return F.coalesce(F.lit(1.0) / first_relevant_rank(retrieved, expected), F.lit(0.0))


def source_recall_at_k(retrieved: Column, expected: Column, k: int) -> Column:
    """Share of the expected sources, repeats counted, among the first k results."""
    top = F.slice(retrieved, 1, k)
    found = F.filter(expected, lambda e: F.exists(top, lambda c: matches(c, e)))
    return F.when(F.size(expected) > 0, F.size(found) / F.size(expected)).otherwise(0.0)


def citation_precision(citations: Column, expected: Column) -> Column:
    good = F.filter(citations, lambda c: relevant(c, expected))
    return F.when(F.size(citations) > 0, F.size(good) / F.size(citations))


def groundedness(answer: Column, texts: Column, threshold: float = 0.6) -> Column:
    """struct(groundedness, citation_coverage) of an answer over its numbered source texts (the first is number 1).

    A sentence is supported if at least ``threshold`` of its tokens are in the sources it cites. Sentences without
    tokens don't count; refusals and empty answers give nulls.
    """
    held = F.transform(texts, lambda t: F.array_distinct(X.tokenize(t)))

    def judged(sources: Column) -> Column:
        def sentence(s: Column) -> Column:
            def scored(tokens: Column) -> Column:
                refs = F.filter(X.citation_refs(s), lambda r: r.between(1, F.size(sources)))
                cited = F.flatten(F.transform(refs, lambda r: F.get(sources, r - 1)))
                share = F.size(F.array_intersect(tokens, cited)) / F.nullif(F.size(tokens), F.lit(0))
                return F.struct(F.size(tokens).alias("n"), (F.size(refs) > 0).alias("cited"), ((F.size(refs) > 0) & (share >= threshold)).alias("supported"))

            return X.let(F.array_distinct(X.tokenize(X.strip_citations(s))), scored)

        def shares(rows: Column) -> Column:
            n = F.nullif(F.size(rows), F.lit(0))
            return F.struct((F.size(F.filter(rows, lambda r: r["supported"])) / n).alias("groundedness"), (F.size(F.filter(rows, lambda r: r["cited"])) / n).alias("citation_coverage"))

        return X.let(F.filter(F.transform(X.split_cited_sentences(answer), sentence), lambda r: r["n"] > 0), shares)

    nothing = X.is_refusal(answer) | (X.strip(answer) == "")
    none = F.lit(None).cast("struct<groundedness:double,citation_coverage:double>")
    return F.when(~nothing, X.let(held, judged)).otherwise(none)


def token_f1(prediction: Column, reference: Column) -> Column:
    """Harmonic mean of token precision and recall; repeats count as often as both have them."""

    def of(pair: Column) -> Column:
        p, r = pair["p"], pair["r"]
        times = lambda a, t: F.size(F.filter(a, lambda x: x == t))
        same = F.aggregate(F.array_intersect(p, r), F.lit(0), lambda acc, t: acc + F.least(times(p, t), times(r, t)))

        def mean(s: Column) -> Column:
            precision, recall = s / F.size(p), s / F.size(r)
            return F.when(s > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)

        return X.let(same, mean)

    return X.let(F.struct(X.tokenize(X.strip_citations(prediction)).alias("p"), X.tokenize(reference).alias("r")), of)


def token_recall(prediction: Column, reference: Column) -> Column:
    """Share of the reference's tokens, repeats counted, that the prediction has."""

    def of(pair: Column) -> Column:
        found = F.filter(pair["r"], lambda t: F.array_contains(pair["p"], t))
        return F.when(F.size(pair["r"]) > 0, F.size(found) / F.size(pair["r"])).otherwise(0.0)

    return X.let(F.struct(X.tokenize(X.strip_citations(prediction)).alias("p"), X.tokenize(reference).alias("r")), of)


def with_metrics(answered: DataFrame, k: int) -> DataFrame:
    """Rows with question, expected, expected_answer, retrieved, sources, answer and citations, measured."""
    r, e, c, a = (F.col(x) for x in ("retrieved", "expected", "citations", "answer"))
    some, answer_given = F.size(e) > 0, F.length("expected_answer") > 0
    ground = groundedness(a, F.transform("sources", lambda s: s["text"]))
    labels = lambda xs: F.transform(xs, lambda x: X.result_label(x["document"], x["page"]))
    return (
        answered.withColumn("_g", ground)
        .withColumn("hit", F.when(some, hit_at_k(r, e, k)))
        .withColumn("reciprocal_rank", F.when(some, reciprocal_rank(r, e)))
        .withColumn("recall", F.when(some, source_recall_at_k(r, e, k)))
        .withColumn("first_relevant_rank", F.when(some, first_relevant_rank(r, e)))
        .withColumn("groundedness", F.col("_g.groundedness"))
        .withColumn("citation_coverage", F.col("_g.citation_coverage"))
        .withColumn("citation_precision", F.when(some, citation_precision(c, e)))
        .withColumn("answer_f1", F.when(answer_given, token_f1(a, F.col("expected_answer"))))
        .withColumn("answer_recall", F.when(answer_given, token_recall(a, F.col("expected_answer"))))
        .withColumn("answered", ~X.is_refusal(a))
        .withColumn("retrieved_labels", labels(r))
        .withColumn("cited_labels", labels(c))
        .drop("_g")
    )


def summary(measured: DataFrame, k: int) -> DataFrame:
    """One row: the mean of each measure over the rows that have it, to four digits."""
    named = {f"hit@{k}": "hit", "mrr": "reciprocal_rank", f"recall@{k}": "recall"} | {x: x for x in ("groundedness", "citation_coverage", "citation_precision", "answer_f1", "answer_recall")}
    if "llm_judge" in measured.columns:
        named["llm_judge"] = "llm_judge"
    rate = F.round(F.avg(F.col("answered").cast("double")), 4).alias("answer_rate")
    return measured.agg(*[F.round(F.avg(c), 4).alias(n) for n, c in named.items()], rate, F.count("*").alias("examples"))


def misses(measured: DataFrame) -> DataFrame:
    return measured.where(F.col("hit") == 0.0)


def failed_gates(figures: dict[str, float | None], gates: dict[str, float | None]) -> list[str]:
    """What falls short of its least value; a figure that there isn't falls short too."""
    asked = {n: least for n, least in gates.items() if least is not None}
    return reduce(lambda out, n: out if figures.get(n) is not None and figures[n] >= asked[n] else [*out, f"{n} is {figures.get(n)}, below {asked[n]}"], asked, [])
