"""Each operator against a plain version of it, and on nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from docengine.llm import components, language, line_rules, mixing, packing, pii, pivots, quality_fm, simhash, tokens, url_filter
from docengine.llm.common import draw, fold_of, fresh, salted_join, table, word_count
from docengine.llm.queries import ORACLES, QUERIES, definition

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows."""
    long_text = "the quick brown fox jumps over it. " * 60_000
    return make(spark, [
        (1, "A plain text with some words in it.", "en", "a", 35), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n", "de", "b", 3),
        (5, long_text, "en", "b", len(long_text)), (6, "x" * 200_000, "en", "c", 200_000), (1, "A plain text with some words in it.", "en", "a", 35),
        (None, "A text without an id.", "en", "a", None), (7, "A plain text with some words in it.", "fr", None, 35),
    ])


def empty(spark):
    return make(spark, [])


def clashing(df):
    """Columns of the names that operators add, or use inside."""
    plain = "size taken target piece fp kept component_id score n_words rank count text_ root key row lang_ found new copies rate source_size copy salt other_salt cleaned chosen own lettered chars start length host path trust"
    inner = "key kept row root own size source source_size target rate copies copy salt other_salt found new pii count lang score text lettered chars n n_words word_chars cleaned fp"
    return df.select("*", *[F.lit("theirs").alias(c) for c in [*plain.split(), *(f"__{c}" for c in inner.split())]])


# ----------------------------------------------------------------------------------------------------------------- mixing
def waterfill(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > most * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in free}
        for s in above:
            out[s] = most * sizes[s]
            rest -= out[s]
        free -= above
    return out


def test_op1_targets_and_rows(spark, sf):
    docs = table(spark, sf, "documents")
    got = mixing.mix_report(docs).toPandas()
    rows = docs.select("doc_id", "source", "text").toPandas().set_index("doc_id")
    size = {d: len(WORD.findall(t or "")) for d, t in rows.text.items()}
    sums = defaultdict(int)
    for d, s in rows.source.items():
        sums[s] += size[d]
    want = waterfill(dict(sums))
    assert len(got) == len(rows) and want.keys() == set(rows.source)
    for r in got.itertuples():
        source = rows.source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sums[source] and r.target == pytest.approx(want[source], rel=1e-12)
        assert r.taken in (r.size * int(r.target / r.source_size), r.size * (int(r.target / r.source_size) + 1)) and r.taken <= 3 * r.size


def test_op1_caps_and_reruns(spark):
    docs = make(spark, [(i, "w " * (1 + i % 7), "en", s, 0) for i, s in enumerate(["a"] * 400 + ["b"] * 3 + ["c"] * 3 + [None] * 30)])
    one, two = (mixing.mix_report(docs).orderBy("doc_id").toPandas() for _ in range(2))
    assert one.equals(two)
    assert (one.taken <= 3 * one["size"]).all()
    assert one[one.doc_id.between(400, 405)].eval("target == 3 * source_size").all()
    big = one[one.doc_id < 400]
    assert abs(big.taken.sum() / big.target.iloc[0] - 1) < 0.15


def test_op1_edges(spark, edge):
    got = mixing.mix_report(edge).toPandas()
    assert len(got) == 9 and (got[got.doc_id.isin([2, 3, 4])]["size"] == 0).all()
    assert got[got.doc_id == 1].taken.nunique() == 1
    assert mixing.mix_report(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    extra = clashing(edge)
    mixed = mixing.mix(extra)
    assert mixed.columns == extra.columns
    per = {r.doc_id: r["count"] for r in mixing.mix(edge).where("doc_id in (5, 6)").groupBy("doc_id").count().collect()}
    assert all(per.get(r.doc_id, 0) * r["size"] == r.taken for _, r in got[got.doc_id.isin([5, 6])].iterrows())


def test_op1_salted_join_gives_the_same(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    one = mixing.mix_report(docs).orderBy("doc_id").toPandas()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert mixing.mix_report(docs).orderBy("doc_id").toPandas().equals(one)


def test_word_count_matches_the_definition(spark):
    texts = ["", " ", "a", " a\tb\n\nc ", "é\x85ü x", "a\x0bb\x0cc\rd", "w " * 1000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).toPandas().n.tolist()
    assert got == [len(WORD.findall(t)) for t in texts]


# -------------------------------------------------------------------------------------------------------------------- pii
def luhn(s: str) -> bool:
    digits = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def replaced(spark, texts, **how):
    how = {"key": "test"} | how
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return [r.text for r in pii.pseudonymised(df, **how).orderBy("doc_id").collect()]


def test_op2_formats_validity_and_links(spark):
    texts = ["4845168114407329", "4845-1681-1440-7329", "9807915762804490", "64.147.79.24", "999.1.1.1", "+1 (017) 555-7713", "2001-02-28", "31.12.1999", "2001-13-01", "ann.34@mail7.example.com", "908038b7daaf91aa908038b7daaf91aa908038b7", "DE89370400440532013000", "DE89370400440532013001", "123-45-6789", "000-12-3456", "4845168114407329 4845168114407329", "tel +1 (826) 555-4081 190.137.223.204 x"]
    got = replaced(spark, texts)
    assert luhn(got[0]) and len(got[0]) == 16 and got[0] != texts[0]
    assert got[1].replace("-", "") == got[0] and re.fullmatch(r"\d{4}(-\d{4}){3}", got[1])
    for i in (2, 4, 8, 12, 14):
        assert got[i] == texts[i]
    assert all(int(x) < 256 for x in got[3].split(".")) and got[3] != texts[3]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[5]) and got[5] != texts[5]
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", got[6]) and re.fullmatch(r"\d\d\.\d\d\.\d{4}", got[7])
    assert got[9].endswith("@example.invalid") and re.fullmatch("[0-9a-f]{40}", got[10]) and got[10] != texts[10]
    iban = got[11][4:] + got[11][:4]
    assert int("".join(str(int(c, 36)) for c in iban)) % 97 == 1
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", got[13])
    assert got[15] == f"{got[0]} {got[0]}"
    assert "555-4081" not in got[16] and "190.137.223.204" not in got[16]
    assert replaced(spark, texts[:1], key="other") != got[:1]
    assert replaced(spark, texts[:1], key=None) != replaced(spark, texts[:1], key=None)  # no setting: a key that nobody keeps


def test_op2_numbers_beside_other_numbers(spark):
    card, iban = "4845168114407329", "ES9121000418450200051332"
    grouped = " ".join(card[i : i + 4] for i in range(0, 16, 4))
    spaced = " ".join(iban[i : i + 4] for i in range(0, 24, 4))
    texts = [f"{card} 12 left", f"12 {card}", f"7 {grouped} 3", f"{grouped} 345 more", f"{grouped} 2021", f"{card}-12", f"{iban} NOTE", f"{spaced} SEE NOTE", f"{spaced} 20"]
    got = replaced(spark, texts)
    new = replaced(spark, [card, grouped, iban, spaced])
    assert not {card, grouped, iban, spaced} & set(new)
    assert got == [f"{new[0]} 12 left", f"12 {new[0]}", f"7 {new[1]} 3", f"{new[1]} 345 more", f"{new[1]} 2021", f"{new[0]}-12", f"{new[2]} NOTE", f"{new[3]} SEE NOTE", f"{new[3]} 20"]


def test_op2_is_a_permutation(spark):
    days = spark.range(73049).select(F.col("id").alias("doc_id"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    got = pii.pseudonymised(days, key="test").agg(F.countDistinct("text").alias("n"), F.min("text").alias("lo"), F.max("text").alias("hi")).first()
    assert (got.n, got.lo, got.hi) == (73049, "1900-01-01", "2099-12-31")
    codes = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("+49 30 "), F.lpad(F.col("id").cast("string"), 5, "0")).alias("text"))
    assert pii.pseudonymised(codes).select("text").distinct().count() == 20000


def test_op2_leaves_clean_text_and_edges(spark, edge, sf):
    clean = ["Version 4.0 of 12 files, 3.5 % more.", "Room 1234, page 56-78", "", None, "x" * 100_000, "1" * 50_000, "a@" * 20_000]
    assert replaced(spark, clean) == clean
    extra = clashing(edge)
    got = pii.pseudonymised(extra)
    assert got.columns == extra.columns and got.count() == 9 and got.where("__found != 'theirs' or __new != 'theirs' or __pii != 'theirs'").count() == 0
    assert pii.pseudonymised(extra, count="replaced").columns == [*extra.columns, "replaced"]
    assert pii.pseudonymised(empty(spark)).count() == 0
    plan = pii.pseudonymised(table(spark, sf, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --------------------------------------------------------------------------------------------------------------- language
def plain_ppm(train: dict[str, list[bytes]], text: bytes) -> list[float]:
    """Code lengths by walking the context trees one byte at a time."""
    out = []
    for own in train.values():
        seen = [defaultdict(Counter) for _ in range(4)]
        for t in own:
            s = language.START + t.lower()
            for i in range(3, len(s)):
                for k in range(4):
                    seen[k][s[i - k : i]][s[i]] += 1
        bits, s = 0.0, language.START + text.lower()
        for i in range(3, len(s)):
            for k in (3, 2, 1, 0, -1):
                if k < 0:
                    bits += 8
                    break
                counts = seen[k].get(s[i - k : i])
                if counts is None:
                    continue
                total, different = sum(counts.values()), len(counts)
                if counts[s[i]]:
                    bits -= np.log2(counts[s[i]] / (total + different))
                    break
                bits -= np.log2(different / (total + different))
        out.append(bits)
    return out


@pytest.mark.parametrize("whole", [1 << 22, 0])
def test_op3_code_lengths_are_exact(spark, sf, monkeypatch, whole):
    monkeypatch.setattr(language, "WHOLE", whole)
    docs = table(spark, sf, "documents").toPandas()
    train = {lang: [t.encode() for t in docs.text[docs.lang == lang][:5]] for lang in ("de", "en", "fr")}
    scorer = language.Scorer(language.train(train))
    texts = [t.encode()[:300] for t in docs.text[60:70]] + [b"", b"a", "漢字 \x00".encode()]
    got = scorer.bits(texts)
    for t, bits in zip(texts, got):
        assert bits == pytest.approx(plain_ppm(train, t), rel=1e-5)


def test_op3_blocks_do_not_matter(monkeypatch):
    model = language.train({"x": [b"abc abc abd"], "y": [b"xyz xyz"]})
    text = b"abc xyz " * 5000
    whole = language.Scorer(model).bits([text, b"q"])
    scorer = language.Scorer(model)
    scorer.block = 7
    assert scorer.bits([text, b"q"]) == pytest.approx(whole)


def test_op3_scripts_and_a_hundred_languages():
    rng = random.Random(8)
    letters = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщ", "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمن", "cjk": "".join(map(chr, range(0x4E00, 0x4E1A)))}

    def tongue(script, seed):
        own = random.Random(seed)
        words = ["".join(own.choice(letters[script]) for _ in range(own.randrange(2, 6))) for _ in range(150)]
        return lambda n: " ".join(rng.choice(words) for _ in range(n)).encode()

    tongues = {f"{script}{i}": tongue(script, f"{script}{i}") for script in letters for i in range(25)}
    model = language.train({name: [say(200) for _ in range(4)] for name, say in tongues.items()})
    assert len(model.languages) == 100 and model.nbytes < 100 << 20
    names, score = language.Scorer(model).predict([say(12) for say in tongues.values()])
    assert np.mean([a == b for a, b in zip(names, tongues)]) > 0.97 and ((score >= 0) & (score <= 1)).all()


def test_op3_learns_from_long_texts_and_bounds_the_sample(spark):
    docs = make(spark, [(i, "hello there my friend " * 30_000, "en", "a", 1) for i in range(2)] + [(9, "bonjour mon ami " * 3, "fr", "a", 1)] * 500)
    got = language.sample(docs, F.lit(True), "text", "lang", 400, 1000, 1 << 20, 8)
    assert set(got) <= {"en", "fr"} and all(len(t) <= 1000 for own in got.values() for t in own) and all(len(own) <= 2 for own in got.values())
    assert len(language.sample(docs, F.lit(True), "text", "lang", 10**6, 1000, 1 << 30, 1)) == 1


def test_op3_held_out_accuracy_and_edges(spark, edge):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = QUERIES["op3_ppm_language"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    model = language.train({"en": [b"the text"], "fr": [b"le texte"]})
    out = {r.doc_id: r for r in language.predictions(clashing(edge), model).collect()}
    assert out[2]["___lang"] == out[3]["___lang"] == out[4]["___lang"] == "und" and out[5]["___lang"] in ("en", "fr")  # the table has __lang
    assert language.identify(empty(spark), F.lit(True)).count() == 0
    assert {r["__lang"] for r in language.identify(edge, F.lit(False)).collect()} == {"und"}


# ---------------------------------------------------------------------------------------------------------------- quality
def test_op4_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.FEATURES), rng.normal(size=(quality_fm.FEATURES, quality_fm.FACTORS)))
    i, x = quality_fm.features("Some words, some! | more words", 12)
    pairs = sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
    assert m.raw_scores(i, x, np.array([0]))[0] == pytest.approx(0.3 + m.w[i] @ x + pairs)


def test_op4_held_out_and_edges(spark, edge):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op4_fm_quality"](spark, d)
    assert got.count() == table(spark, d, "documents").count()
    held = got.join(table(spark, d, "labels"), "doc_id").where("held_out and quality is not null").toPandas()
    good, bad = held.score[held.quality == 1], held.score[held.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert held.score.between(0, 1).all() and ((held.score >= 0.3).astype(int) == held.predicted).all()
    labels = make(spark, [(1, 1, 0), (3, 0, 0), (5, 1, 0), (None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    machine = quality_fm.train(edge, labels, F.lit(True))
    scored = quality_fm.scored(clashing(edge), machine)
    assert scored.count() == 9 and scored.where("___score is null or ___score < 0 or ___score > 1").count() == 0
    assert quality_fm.train(empty(spark), labels, F.lit(True)) is None and quality_fm.scored(empty(spark), None).count() == 0
    assert quality_fm.scored(edge.drop("n_chars"), machine).count() == 9


# ------------------------------------------------------------------------------------------------------------- line rules
def plain_base(t: str) -> tuple:
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, marked = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            marked.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def test_op5_base_against_brute_force(spark, sf):
    rng = random.Random(2)
    texts = [r.text for r in table(spark, sf, "documents").collect()] + ["".join(rng.choice("ab \n\t|\x0b") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert line_rules.judge(t)[:5] == plain_base(t)


def test_op5_rules(spark, edge):
    good = "This is a clean line of more than twelve words that says what it has to say."
    passes = lambda x: line_rules.line_passes(x, line_rules.LineRules())
    assert passes(good) and passes("A heading")
    assert not passes("Home | News | Sport | Contact") and not passes("Accept all cookies to go on.") and not passes("what### a&&& line*** of%%% signs$$$")
    assert not passes("SHOUTING ALL THE WAY TO THE END!!") and not passes("word " * 13)
    nav = "Home | News | Sport | Contact\n"
    kept = line_rules.judge(good + "\n" + nav)
    assert kept[6] and kept[8] == good
    assert not line_rules.judge(good + "\n" + nav * 4)[6] and not line_rules.judge("Too short.")[6] and not line_rules.judge(None)[6]
    out = line_rules.judged(clashing(edge))
    assert out.count() == 9 and out.where("doc_id = 2").first()["___n_words"] == 0 and out.where("doc_id = 5").first()["___base_failed"]
    assert line_rules.judged(empty(spark)).count() == 0


def test_op5_scripts_without_case():
    passes = lambda x: line_rules.line_passes(x, line_rules.LineRules())
    lines = {
        "Arabic": "هذه جملة عربية واضحة تماما. ذهب الولد إلى المدرسة.", "Hebrew": "זה משפט ברור בעברית עם כמה מילים.", "Hindi": "यह हिन्दी में एक साफ वाक्य है और इसे सब लोग पढ़ सकते हैं।",
        "Korean": "이것은 한국어로 쓴 깨끗한 문장이고 여러 낱말이 있습니다.", "Thai": "นี่คือประโยคภาษาไทย ที่อ่านง่าย และสะอาด", "Chinese": "这是一个干净的中文句子 里面有很多汉字 没有任何问题。",
    }
    for name, line in lines.items():
        assert passes(line), name
    for mark in "।۔؟":
        assert passes("शब्द " * 13 + mark), mark
    assert passes("ประโยค " * 13) and not passes("शब्द " * 13)
    assert not passes("SHOUTING ALL THE WAY TO THE END") and not passes("КРИЧИМ ДО САМОГО КОНЦА СТРОКИ")
    assert line_rules.judge("\n".join(lines.values()))[6]


def test_op5_sql_on_all_scripts(spark):
    """The SQL and the operator agree line by line, also where words are parted by other white space than ASCII's."""
    import duckdb

    words = ["शब्द", "ประโยค", "كلمة", "слово", "СЛОВО", "WORDS", "word", "낱말", "a\u00a0b\u2003c", "x\x1cy", "No.", "है।", "؟", "句子。", "||", "#"]
    rng = random.Random(8)
    lines = [" ".join(rng.choices(rng.sample(words, 3), k=rng.choice((2, 7, 12, 13, 14)))) for _ in range(600)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 5))), "en", "a", 1) for i in range(600)] + [(600, None, None, None, None), (601, "", "en", "a", 0)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    want = con.sql(ORACLES["op5_line_rules"]).df().set_index("doc_id")
    for i, text, *_ in rows:
        n, chars, symbols, duplicates, again, failed, kept, kept_words, _ = line_rules.judge(text)
        r = want.loc[i]
        assert (n, chars, symbols, duplicates, again, failed, kept, kept_words) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_kept_words), repr(text)


# ---------------------------------------------------------------------------------------------------------------- simhash
def plain_words(t: str | None) -> list[str]:
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(t or "")]


def plain_fingerprint(t: str | None, k: int = 3) -> int:
    w = plain_words(t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_mark(t: str | None) -> tuple[int, ...]:
    """Of the words under two hashes, with weights, and of the five-word shingles."""
    w, out = plain_words(t), []
    weight = {x: round(16 * (1 + math.log(w.count(x)))) for x in set(w)}
    for seed in (0, 1):
        h = {x: xxhash.xxh64_intdigest(x.encode(), seed) for x in weight}
        out.append(sum(1 << b for b in range(64) if sum(n for x, n in weight.items() if h[x] >> b & 1) * 2 > sum(weight.values())))
    return *out, plain_fingerprint(t, 5)


def plain_near(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    return (a[2] ^ b[2]).bit_count() <= 12 and any((x ^ y).bit_count() <= 2 for x, y in zip(a[:2], b[:2]))


def plain_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_op6_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    assert all(int(got[d].fingerprint, 16) == f for d, f in fp.items())
    pairs = [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2]
    assert {d: r.component_id for d, r in got.items()} == plain_components(pairs, fp)


@pytest.mark.parametrize("hot", [64, 8, 1])
def test_op6_links_lose_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps):
        fps.update(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(4))
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << i) for i in range(40)} | {0, (1 << 64) - 1, 1 << 63}
    fps |= {base & ((1 << 26) - 1) | rng.getrandbits(38) << 26 for _ in range(90)}  # a hot key of strangers
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    roots = {r.node: r.root for r in got.collect()}
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    assert {f: roots.get(f, f) for f in signed} == plain_components(pairs, signed)


def test_op6_edges_and_keep_one(spark, edge):
    got = simhash.near_duplicates(clashing(edge)).toPandas()
    assert len(got) == 9
    assert set(got[got.doc_id.isin([2, 3, 4])].component_id) == {2} and set(got[got.doc_id.isin([2, 3, 4])].fingerprint) == {"0" * 16}
    assert set(got[got.doc_id.isin([1, 7])].component_id) == {1}
    kept = simhash.keep_one(clashing(edge))
    assert kept.columns == clashing(edge).columns
    assert sorted(kept.toPandas().doc_id.fillna(-1)) == [-1, 1, 2, 5, 6]
    nameless = make(spark, [(None, "one text here today", "en", "a", 1)] * 2 + [(None, "another thing entirely different", "en", "a", 1)])
    assert simhash.keep_one(nameless).count() == 2
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [64, 1])
def test_keep_one_finds_changed_copies(spark, monkeypatch, hot):
    """A key with few and with many nodes, in blocks of 16, against all pairs."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "GROUP", 16)
    rng = random.Random(5)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randint(3, 8))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(20)]
    for _ in range(60):  # one group of 60 near copies, of which up to 6 of 300 words were changed
        near = texts[0].split()
        for at in rng.sample(range(300), rng.randint(1, 6)):
            near[at] = rng.choice(words)
        texts.append(" ".join(near))
    texts += [texts[1], " ".join(sorted(texts[2].split())), " ".join(texts[3].split()[:60]), "", " "]
    marks = dict(enumerate(map(plain_mark, texts)))
    want = plain_components([(a, b) for a in marks for b in marks if a < b and plain_near(marks[a], marks[b])], marks)
    kept = {r.doc_id for r in simhash.keep_one(make(spark, [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)])).collect()}
    assert kept == set(want.values())
    assert len(kept & set(range(20, 80))) <= 6  # nearly all changed copies go
    assert {*range(20), 81, 82, 83} <= kept and not {80, 84} & kept  # other orders and parts of texts stay


def test_salted_join(spark):
    many = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id")).alias("k"), "id")
    few = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    for how in ("inner", "left"):
        want = sorted(map(str, many.join(few, "k", how).collect()))
        for bound in (0, 10**6):
            assert sorted(map(str, salted_join(many, few, "k", how, bound).collect())) == want


def test_fresh_names():
    assert fresh(["a", "__B"], "b", "c") == ["___b", "___c"] and fresh([], "b") == ["__b"]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1100)}}


# -------------------------------------------------------------------------------------------------------------------- url
def test_op7_parts_and_rules(spark):
    urls = ["http://A.Example.COM/en/7?x#y", "https://b.net/de/8", "https://q.example.net/de/8/9", "ftp://org/es/", "x.org/es/1", None, "http://c.org?q=/es/", "http://notcom/en/", "http://com/en/1", "a://b://c/d#e", "HTTP://É.COM/en/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.verdicts(pages).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == [
        ("a.example.com", "/en/7", "example.com/en/7"), ("b.net", "/de/8", "net/de/"), ("q.example.net", "/de/8/9", "example.net/de/8"), ("org", "/es/", "org/es/"), ("", "", None), ("", "", None),
        ("c.org", "", None), ("notcom", "/en/", None), ("com", "/en/1", "com/en/"), ("b:", "//c/d", None), ("É.com", "/en/", "com/en/"),
    ]
    assert [got[i].verdict for i in (0, 1, 2, 3, 8)] == ["allow", "allow", "block", "block", "block"] and got[5].verdict == "allow"


def plain_rank(edges, seeds, damping=0.85, rounds=300):
    """Power iteration, with what hosts without edges hold going back to the seeds."""
    total = sum(seeds.values())
    start = {h: w / total for h, w in seeds.items()}
    out, rank = defaultdict(dict), dict(start)
    for (a, b), n in edges.items():
        out[a][b] = n
    for _ in range(rounds):
        moved = defaultdict(float)
        for h, r in rank.items():
            for to, n in out[h].items():
                moved[to] += damping * r * n / sum(out[h].values())
        back = 1 - sum(moved.values())
        rank = {h: start.get(h, 0) * back + moved.get(h, 0) for h in start.keys() | moved.keys()}
    return rank


def test_op7_propagation(spark):
    a = '<a href="{}">x</a>'
    rows = [
        (1, "http://good.example.com/en/7", a.format("http://friend.test/") + a.format("//other.test/x")), (2, "http://bad.com/en/1", a.format("http://bad2.test/")), (3, "http://linker.test/a", a.format("http://bad.com/") * 2 + a.format("/local")),
        (4, "http://friend.test/1", None), (5, "http://nobody.test/", ""), (6, "http://m.blog.good.org/1", ""), (7, "http://blog.good.org/es/2", ""),
    ]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in url_filter.verdicts(pages).collect()}
    edges = {("good.example.com", "friend.test"): 1, ("good.example.com", "other.test"): 1, ("bad.com", "bad2.test"): 1, ("linker.test", "bad.com"): 2, ("m.blog.good.org", "blog.good.org"): 1, ("blog.good.org", "m.blog.good.org"): 1}
    trust = plain_rank(edges, {"good.example.com": 1})
    distrust = plain_rank({(b, x): n for (x, b), n in edges.items()}, {"bad.com": 1, "blog.good.org": 1})
    for r in got.values():
        assert r.trust == pytest.approx(trust.get(r.host, 0), rel=0.05) and r.distrust == pytest.approx(distrust.get(r.host, 0), rel=0.05)
    assert [got[i].verdict for i in (3, 4, 5, 6)] == ["block", "allow", "allow", "block"]
    none = url_filter.verdicts(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.count() == 0


def test_op7_reaches_hosts_far_away_with_tiny_ranks(spark):
    """A rule's host, 14 hosts in a row, the last steps shared with very many others: what is reached is judged, however small."""
    a = '<a class="' + "x" * 5000 + '" href="http://{}/">x</a>'
    rows = [(0, "http://bad.com/en/1", a.format("h0.test"))] + [(i + 1, f"http://h{i}.test/", a.format(f"h{i + 1}.test") + "".join(a.format(f"side{i}x{k}.test") for k in range(3))) for i in range(14)]
    rows += [(100, "http://good.example.com/en/7", a.format("friend.test"))] + [(200 + i, f"http://q{i}.test/", a.format(f"h{i}.test")) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = url_filter.host_edges(pages.select(url_filter.host_of(F.col("url")).alias("__host"), F.col("html").alias("__html")), "__html")
    seeds = spark.createDataFrame([("trust", "bad.com", 1), ("trust", "other.test", 10**11)], "kind string, host string, weight long")
    rank = {r.host: r["rank"] for r in url_filter.propagated(edges.withColumn("kind", F.lit("trust")), seeds).collect()}
    assert 0 < rank["h14.test"] < 1e-15 and rank["h14.test"] == pytest.approx(rank["h0.test"] * (0.85 / 4) ** 14, rel=0.02)


def test_op7_a_hot_host(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "http://hot.com/en/" if i % 3 else f"http://h{i}.com/x", '<a href="http://h3.com/">') for i in range(3000)], "page_id long, url string, html string")
    one = sorted(map(str, url_filter.verdicts(pages).collect()))
    monkeypatch.setattr(url_filter, "salted_join", lambda *a: salted_join(*a, broadcast_rows=0))
    assert sorted(map(str, url_filter.verdicts(pages).collect())) == one


# ---------------------------------------------------------------------------------------------------------------- packing
@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition())


ALPHABET = [*"abé ñ  \n\n\t'stre 12.,!?|#  漢字\x1c\x85😀-- ===ªⅷ²", "<|endoftext|>", "'re", "'ll", " the", " 's", "tion", "ing", " .", " Don't"]


def odd_texts(n=3000):
    rng = random.Random(9)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_op8_ids_are_the_tokenizers(tokenizer):
    encode = packing.Encoder(definition())
    for t in odd_texts():
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("make_text", [
    lambda n: "a" + " " * n + "b", lambda n: "a" + "\n" * n + "<|endoftext|> " + " \n" * 3000 + "b", lambda n: "x" + "\t" * n, lambda n: " " * n,
    lambda n: "".join(random.Random(1).choices("abcdefghij", k=n)), lambda n: "".join(map(chr, random.Random(2).choices(range(0x4E00, 0x6000), k=n))),
], ids=["spaces", "newlines", "tabs", "only", "letters", "cjk"])
def test_op8_op10_texts_without_a_break(tokenizer, make_text):
    text = make_text(1_000_001)
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Encoder(definition())(text), "<u4").tolist() == ids
    assert tokens.Counter(definition())(text) == len(ids)


def test_op8_equal_rows_are_dealt_out(spark):
    same = make(spark, [(None, None, None, None, None)] * 5000).repartition(4)
    got = packing.pack(same, definition()).toPandas()
    assert len(got) == 5000 and not got.duplicated(["sequence_id", "offset"]).any() and got.sequence_id.nunique() == 5
    ranked = packing.ranked(packing.pieces(same, definition()).select("*").checkpoint(), "doc_id", {1: 5000})
    assert sorted(r["__rank"] for r in ranked.select("__rank").collect()) == list(range(5000))


def test_op8_pieces_and_sequences(spark, sf, tokenizer):
    docs = table(spark, sf, "documents")
    got = packing.pack(docs, definition(), ids=True).toPandas()
    ids = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [2] for r in docs.collect()}
    for d, own in got.sort_values("piece").groupby("doc_id"):
        assert [x for part in own["ids"] for x in part] == ids[d]
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == [0, *own.length.cumsum()[:-1]]
        assert (own.length.iloc[1:] == 1024).all() and (len(own) == 1 or len(ids[d]) > 1024)
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(own["ids"], own.ids_crc32))
    at = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all((own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 1024 for _, own in at)
    assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 1024) + 1


def test_op8_plan_uses_everything():
    rng = random.Random(1)
    for histogram in ({1024: 3, 1: 5}, {700: 10}, {i: rng.randrange(200) for i in range(1, 1025)}, {600: 5, 424: 7, 300: 2, 100: 1}, {}):
        used = Counter()
        for p, r in packing.plan({k: v for k, v in histogram.items() if v}):
            assert sum(p) <= 1024 and r > 0
            for n in p:
                used[n] += r
        assert used == Counter({k: v for k, v in histogram.items() if v})


def test_op8_edges(spark, edge):
    got = packing.pack(clashing(edge), definition()).toPandas()
    assert got[got.doc_id.isin([2, 3])].length.tolist() == [1, 1] and len(got[got.doc_id == 1]) == 2
    assert not got.duplicated(["sequence_id", "offset"]).any()
    assert packing.pack(empty(spark), definition()).count() == 0


# ----------------------------------------------------------------------------------------------------------------- pivots
def brute_links(v: np.ndarray) -> np.ndarray:
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = u @ u.T >= 0.9
    np.fill_diagonal(hits, False)
    return hits


def test_op9_recall_at_the_threshold(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    v = np.concatenate([x, 0.901 * x + np.sqrt(1 - 0.901**2) * y])
    got = pivots.near_duplicates(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<double>")).orderBy("vec_id").toPandas()
    degree = brute_links(v).sum(1)
    assert (got.n_links <= degree).all() and got.n_links.sum() >= 0.98 * degree.sum()


@pytest.mark.parametrize("pivot_count", [44, 316, 1000, 2048])
def test_op9_recall_by_number_of_pivots(pivot_count):
    """The candidate rule alone, for pairs at cosine 0.901 among random vectors and pivots."""
    rng = np.random.default_rng(pivot_count)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x, y, p = (unit(rng.normal(size=(n, 64))) for n in (3000, 3000, pivot_count))
    y = unit(y - (y * x).sum(1, keepdims=True) * x)
    y = 0.901 * x + np.sqrt(1 - 0.901**2) * y
    near = [np.argsort(-(v @ p.T), axis=1)[:, : pivots.nearest_for(pivot_count)] for v in (x, y)]
    shared = (near[0][:, :, None] == near[1][:, None, :]).sum(axis=(1, 2))
    print(pivot_count, (shared >= pivots.SHARED).mean())
    assert (shared >= pivots.SHARED).mean() >= 0.98


def test_op9_multiplies_only_pairs_that_share_two(monkeypatch):
    rng = np.random.default_rng(4)
    units = rng.normal(size=(600, 32))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    near = np.sort(np.array([rng.permutation(200)[:8] for _ in range(600)]), axis=1).astype(np.int16)
    pivot = int(near[0, 0])
    own = (near == pivot).any(axis=1)
    u, n = units[own], near[own]
    hits = pivots._products(u, n, u, n, pivot, -2.0, 2)  # every product counts as a hit
    later = ((n[:, None, :, None] == n[None, :, None, :]) & (n > pivot)[:, None, :, None]).any(axis=(2, 3))
    assert (hits == later).all() and hits.sum() < 0.5 * hits.size


@pytest.mark.parametrize("block", [2048, 16])
def test_op9_groups_copies_and_edges(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    v = np.concatenate([centre[i % 6] + 0.05 * rng.normal(size=16) * (i > 30) for i in range(120)]).reshape(-1, 16)
    rows = [(i, row.tolist()) for i, row in enumerate(v)]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, [float("inf")] * 16), (906, [1.0, 2.0])]
    df = clashing(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"))
    got = pivots.near_duplicates(df).orderBy("vec_id").toPandas()
    hits = brute_links(v)
    want = plain_components([(a, b) for a, b in zip(*np.nonzero(hits))], range(len(v)))
    assert got.n_links.tolist() == hits.sum(1).tolist() + [0] * 7
    assert got.component_id.tolist() == [want[i] for i in range(len(v))] + [b[0] for b in bad]
    assert got.kept.tolist() == (got.vec_id == got.component_id).tolist()
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_op9_recall_inside_a_large_group(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x[0].copy()
    noise = x[:10_000] - (x[:10_000] @ centre)[:, None] * centre
    noise[0] = rng.normal(size=64)
    x[:10_000] = np.sqrt(0.95) * centre + np.sqrt(0.05) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    got = pivots.near_duplicates(spark.createDataFrame(pd.DataFrame({"vec_id": range(30_000), "embedding": x.tolist()}))).orderBy("vec_id").toPandas()
    u = x[:10_000] / np.linalg.norm(x[:10_000], axis=1, keepdims=True)
    degree = np.array([(u[i : i + 1000] @ u.T >= 0.9).sum(axis=1) - 1 for i in range(0, 10_000, 1000)]).ravel()
    assert (got.n_links[:10_000] <= degree).all() and got.n_links[:10_000].sum() >= 0.995 * degree.sum()
    assert (got.component_id[:10_000] == 0).all()


def test_op9_a_length_with_one_pivot(spark):
    rows = [(10 * d + i, [1.0 + 0.01 * i] + [1.0] * (d - 1)) for d in (3, 4) for i in range(5)]
    got = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pivots=1).toPandas()
    assert (got.n_links == 4).all() and set(got.component_id) == {30, 40}


# ----------------------------------------------------------------------------------------------------------------- tokens
def test_op10_counts_are_the_tokenizers(tokenizer):
    count = tokens.Counter(definition())
    for t in odd_texts():
        assert count(t) == len(tokenizer.encode(t, add_special_tokens=False).ids), repr(t)


def test_op10_chunk_maps_compose(monkeypatch):
    count = tokens.Counter(definition())
    texts = odd_texts(400) + ["a" * 3000, "<|endoftext|>" * 9, "(" * 90 + "a" * 300 + "'s'sx" * 20]
    whole = [count(t) for t in texts]
    for size in (1, 5, 13):
        monkeypatch.setattr(tokens, "CHUNK", size)
        assert [count(t) for t in texts] == whole


def test_op10_scan_keeps_the_order():
    for n in range(1, 40):
        assert tokens.reduced(map(str, range(n)), str.__add__) == "".join(map(str, range(n)))
    assert tokens.reduced([], str.__add__) is None


def test_op10_maps_take_any_entry_state(monkeypatch):
    """A chunk inside a pretoken gives what the machine gives from every state in which it may be entered."""
    machine = tokens.Machine(definition())
    rng = random.Random(6)
    for letters in ("ab", "aaaaaaab", "thequickbrown"):
        word = "".join(rng.choice(letters) for _ in range(3000)).encode()
        chunk = tokens.inside(machine, word[1000:2000], word[936:1000], False)
        for start in range(900, 1000, 7):
            entry = machine.run(word[start:1000])[0]
            assert chunk.after(entry) == machine.run(word[1000:2000], entry)
    monkeypatch.setattr(tokens, "MOST_STATES", 30)
    state, n = machine.run(word)
    monkeypatch.setattr(tokens, "MOST_STATES", 1 << 16)
    assert (state, n) == machine.run(word)


def test_op10_machine_forgets_and_goes_on(monkeypatch):
    count = tokens.Counter(definition())
    words = [w for t in odd_texts(200) for w in count.pretokens.findall(t)]
    want = [count.machine.count(w.encode()) for w in words]
    monkeypatch.setattr(tokens, "MOST_STATES", 20)
    assert [count.machine.count(w.encode()) for w in words] == want


def test_op10_table_and_edges(spark, edge, sf, tokenizer):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r for r in tokens.token_counts(docs, definition()).collect()}
    for r in docs.collect():
        n = len(tokenizer.encode(r.text, add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len(r.text.encode()), n > 512)
    odd = tokens.token_counts(clashing(edge), definition()).toPandas()
    assert len(odd) == 9 and odd[odd.doc_id.isin([2, 3])].n_tokens.tolist() == [0, 0]
    assert tokens.token_counts(empty(spark), definition()).count() == 0


# ----------------------------------------------------------------------------------------------------------------- common
def test_folds_and_draws(spark):
    df = spark.range(500).select("id", fold_of(F.col("id")).alias("fold"), draw("s", F.col("id")).alias("u")).toPandas()
    assert [zlib.crc32(str(i).encode()) % 5 for i in df.id] == df.fold.tolist()
    assert df.u.between(0, 1).all() and 0.4 < df.u.mean() < 0.6
    assert json.loads(definition())["model"]["type"] == "BPE"
