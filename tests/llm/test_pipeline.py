"""The stages against plain versions of them, one after the other."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from docengine.llm import line_rules

from .test_operators import DOCS, plain_components, plain_mark, plain_near, waterfill


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["documents"] = docs.toPandas()
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.toPandas()
    return out


def test_quality_rules(steps):
    got = steps["quality_rules"].set_index("doc_id").text.to_dict()
    want = {r.doc_id: j[8] for r in steps["documents"].itertuples() if (j := line_rules.judge(r.text))[6]}
    assert got == want


def test_near_dedup(steps):
    fp = {r.doc_id: plain_mark(r.text) for r in steps["quality_rules"].itertuples()}
    pairs = [(a, b) for a in fp for b in fp if a < b and plain_near(fp[a], fp[b])]
    assert set(steps["simhash_near_dedup"].doc_id) == set(plain_components(pairs, fp).values())


def test_private_data(steps):
    before, after = (steps[n].set_index("doc_id").text for n in ("simhash_near_dedup", "pii"))
    assert set(before.index) == set(after.index)
    assert not after.str.contains(r"@mail\d+\.example\.com|\+1 \(\d{3}\) 555-\d{4} ").any()
    clean = ~before.str.contains(r"[0-9@]")
    assert (before[clean] == after[clean]).all()


def test_mix(steps):
    docs, mixed = steps["pii"], steps["source_mix"]
    sizes = docs.text.map(lambda t: len(t.split())).groupby(docs.source).sum().to_dict()
    targets = waterfill(sizes)
    times = mixed.groupby("doc_id").size()
    for r in docs.itertuples():
        rate = targets[r.source] / sizes[r.source]
        assert times.get(r.doc_id, 0) in (int(rate), int(rate) + 1)
    assert set(mixed.columns) == set(P.COLUMNS)


def test_packing(steps):
    got = steps["pattern_packing"]
    assert len(got[got.piece == 0]) == len(steps["source_mix"])
    assert got.groupby("sequence_id").length.sum().max() <= 1024


def test_run_gives_the_last_stage(spark, sf, steps):
    assert P.run(spark, sf).count() == len(steps["pattern_packing"])
    assert [n for n, _ in P.STAGES] == ["quality_rules", "simhash_near_dedup", "pii", "source_mix", "pattern_packing"]


def test_stages_take_nulls_empties_and_extra_columns(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "A sentence of quite a few words that is long enough to be kept.", "en", "a", 1), (3, "A sentence of quite a few words that is long enough to be kept.", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("__size", F.lit(1)).withColumn("piece", F.lit("x")).withColumn("__kept", F.lit("x"))
    for _, stage in P.STAGES:
        for df in (docs, docs.where("false")):
            assert stage(spark, df, sf).count() >= 0
