"""Text columns against the cases that define them and, over whole documents, against plain Python."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docengine.functions import kernels
from docengine.functions import text as X
from docengine.sources.formats import unwrap


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def plain_tokens(text):
    out = []
    for t in re.findall(r"[a-z0-9]+(?:'[a-z]+)?", text.lower()):
        if t in X.STOPWORDS:
            continue
        if len(t) > 4 and t[-3:] == "ies":
            out.append(t[:-3] + "y")
            continue
        if t[-4:] == "sses":
            t = t[:-2]
        elif len(t) > 3 and t[-1] == "s" and t[-2:] not in ("ss", "us", "is"):
            t = t[:-1]
        out.append(t[:-3] if len(t) > 5 and t[-3:] == "ing" else t[:-2] if len(t) > 4 and t[-2:] == "ed" else t)
    return out


def test_t3_stems(spark):
    words = "policies ties passes logs barking used dog's it's status calibrated calibrating glass bus ring bed".split()
    assert column(spark, words, X.stem) == "policy tie pass log bark used dog' it' status calibrat calibrat glass bus ring bed".split()
    assert len(X.STOPWORDS) == 92


def test_t1_t2_tokens(spark):
    said = ["The Dogs' élève isn't it's THE 12b", "", None, "about the of"]
    assert column(spark, said, X.tokenize) == [["dog", "l", "ve", "isn't", "it'", "12b"], [], None, []]
    assert column(spark, ["The dogs"], lambda x: X.tokenize(x, False, False)) == [["the", "dogs"]]


def test_t1_to_t4_over_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", X.tokenize(F.col("text")).alias("t"), X.split_sentences(F.col("text")).alias("s")).collect()
    for r in docs:
        assert r.t == plain_tokens(r.text) and r.s == kernels.sentences(r.text)


def test_t4_sentences(spark):
    assert column(spark, ['One. "Two?" (Three)\u00a0went.\n\n4 is. five. É no.', "  ", ""], X.split_sentences) == [['One.', '"Two?" (Three) went.', "4 is. five. É no."], [], []]


def test_t4_sentences_keep_digits(spark):
    """Digits at the ends of sentences stay, also where they are the sentence's number."""
    said = ["0 one 0", "10.1.1.1 two +1 (252) 555-8631", "2", "33 four 33"]
    assert column(spark, [". ".join(said), "One.\n" + "12 two.\t" * 12], X.split_sentences) == [["0 one 0.", "10.1.1.1 two +1 (252) 555-8631.", "2.", "33 four 33"], ["One."] + ["12 two."] * 12]


def test_t5_t6_t7_citations(spark):
    assert column(spark, ["a [2] b [1, 3] c [2]", "none", ""], X.citation_refs) == [[2, 1, 3], [], []]
    assert column(spark, ["a [2]  b [1, 3]. ", "x"], X.strip_citations) == ["a b .", "x"]
    assert column(spark, ["Claim one. [1] Claim two [2]. Three! [1] [2, 3] Four."], X.split_cited_sentences) == [["Claim one [1].", "Claim two [2].", "Three [1] [2, 3]!", "Four."]]


def test_t8_t11_p2_p3(spark):
    df = spark.createDataFrame([("a.md", 2, "G > S", "text"), ("b", None, None, "x" * 298 + "  yz"), ("c", 0, "", "t")], "d string, p int, h string, t string")
    got = df.select(X.source_header(F.lit(1), F.col("d"), F.col("p"), F.col("h")), X.result_label(F.col("d"), F.col("p")), X.search_text(F.col("h"), F.col("t")), X.snippet(F.col("t"))).collect()
    assert [r[0] for r in got] == ["[1] source: a.md | page 2 | section: G > S", "[1] source: b", "[1] source: c | page 0"]
    assert [r[1] for r in got] == ["a.md#p2", "b", "c"]
    assert [r[2] for r in got] == ["G > S\ntext", "x" * 298 + "  yz", "t"]
    assert [r[3] for r in got] == ["text", "x" * 298 + "...", "t"]


def test_p10_refusal(spark):
    assert column(spark, [X.NO_ANSWER, f"\n {X.NO_ANSWER.upper()}.. ", "No.", ""], X.is_refusal) == [True, True, False, False]


def test_p4_names(spark):
    assert column(spark, ["ab", "ab\n", "-a", "a" * 64, "a" * 65, "a_b-1", ""], X.valid_collection) == [True, False, False, True, False, True, False]


def test_c9_ids_and_names(spark):
    assert column(spark, ["a b.pdf"], lambda x: X.doc_id(F.lit("demo"), x)) == [hashlib.sha256(b"demo/a b.pdf").hexdigest()[:16]]
    assert column(spark, ["/a/b.md", "c:\\d\\e.txt", "", "/", "x"], X.base_name) == ["b.md", "e.txt", "document", "document", "x"]


def test_s12_expected_sources(spark):
    got = column(spark, ["b.pdf#p2", "b.pdf#P12", "b#px", "a#p1#p3", "c.md"], X.expected_source)
    assert [(r.document, r.page) for r in got] == [("b.pdf", 2), ("b.pdf", 12), ("b#px", None), ("a#p1", 3), ("c.md", None)]


def test_s9_unwrap(spark):
    said = ["Title\nline one\nline two.\nNext para:\nitem  \n\nlast", "a\n\n\nb", " x \n y", "one.\ntwo"]
    want = ["Title line one line two.\n\nNext para:\n\nitem\n\n\nlast", "a\n\n\n\nb", "x  y", "one.\n\ntwo"]
    assert column(spark, said, X.unwrap_pdf_lines) == want == [unwrap(s) for s in said]


def test_g6_judge_scores(spark):
    said = ['{"score": 0.8, "reason": "x"}', 'ok {"score": 7}', "no json", "0.25", '{"score": "a"}', '{"s": 1}', "-3"]
    assert column(spark, said, X.judge_score) == [0.8, 1.0, None, 0.25, None, None, 0.0]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \nAB!x", max_size=400), st.integers(10, 60), st.integers(0, 40))
def test_c2_to_c5_chunks(text, size, overlap):
    overlap = min(overlap, size - 1)
    parts = kernels.units(text, size)
    joined = lambda us: "".join(("" if i == 0 else " " if us[i - 1][0] == n else "\n\n") + p for i, (n, p) in enumerate(us))
    want, current = [], []
    for part in parts:
        if current and len(joined(current + [part])) > size:
            want.append(joined(current))
            carry = []
            while len(carry) < len(current) and len(joined(current[-len(carry) - 1 :])) <= overlap:
                carry = current[-len(carry) - 1 :]
            current = carry if len(joined(carry + [part])) <= size else []
        current = current + [part]
    if current:
        want.append(joined(current))
    got = kernels.chunk_text(text, size, overlap)
    assert got == want and all(0 < len(c) <= size for c in got)


def test_c2_long_words_and_overlap():
    assert [len(c) for c in kernels.chunk_text("x" * 1000, 100, 10)] == [100] * 10
    text = " ".join(f"Sentence number {i} of many." for i in range(60))
    chunks = kernels.chunk_text(text, 200, 60)
    assert len(chunks) > 5 and all(a.split(". ")[-1] in b for a, b in zip(chunks, chunks[1:]))
    assert " ".join(kernels.chunk_text(text, 200, 0)) == text
    assert kernels.chunk_text("One.\n\nTwo.\nstill two.", 100, 0) == ["One.\n\nTwo.\nstill two."] and kernels.chunk_text(" \n ", 50, 0) == []


def test_c1_markdown():
    got = kernels.markdown_sections("intro\n# Guide #\na\n## Setup\nb\n### Linux\nc\n## Usage\nd\n#no\n####### seven\n")
    assert got == [("intro", None), ("a", "Guide"), ("b", "Guide > Setup"), ("c", "Guide > Setup > Linux"), ("d\n#no\n####### seven", "Guide > Usage")]
    assert kernels.markdown_sections("~~~\n# x\n```\n# y") == [("~~~\n# x\n```", None)]
    assert kernels.markdown_sections("```\n# x\n```\n# h") == [("```\n# x\n```", None)]


def test_s4_decoding():
    assert kernels.decode("\ufeffé".encode()) == "é" and kernels.decode("hé".encode("utf-16")) == "hé" and kernels.decode(b"\xe9t\xe9") == "été"
    assert kernels.decode("été ok".encode("latin-1")) == "été ok".encode("latin-1").decode("utf-16")


def test_e2_hash_embedding():
    a, b = kernels.hash_embedding(["dog", "bark"], 384), kernels.hash_embedding(["dog", "bark"], 384)
    assert (a == b).all() and float(a @ a) == pytest.approx(1, abs=1e-6) and not kernels.hash_embedding([], 8).any()
    assert float(a @ kernels.hash_embedding(["dog", "run"], 384)) > float(a @ kernels.hash_embedding(["cat", "run"], 384))


def test_e2_hash_embedding_adds_its_features():
    import numpy as np
    from hashlib import blake2b

    tokens = ["dog", "bark", "dog", "bark", "a", "dog", "été"]
    features = [(f"w:{t}", 1.0) for t in tokens] + [(f"b:{a}_{b}", 0.5) for a, b in zip(tokens, tokens[1:])]
    features += [(f"c:{e[i : i + 3]}", 0.25) for e in (f"#{t}#" for t in tokens) for i in range(len(e) - 2)]
    want = np.zeros(48)
    for feature, weight in features:
        value = int.from_bytes(blake2b(feature.encode(), digest_size=8).digest(), "little")
        want[value % 48] += weight if value >> 63 else -weight
    assert (kernels.hash_embedding(tokens, 48) == (want / np.sqrt(want @ want)).astype(np.float32)).all()
    assert kernels.hash_embedding(["x"], 8).shape == (8,)
