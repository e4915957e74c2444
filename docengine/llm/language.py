"""Language identification by prediction by partial matching.

For each language a byte context tree of variable order (up to three bytes of context) holds how often each byte
followed each context in a bounded sample of that language. The code length of a byte is exact under these frozen
statistics: ``-log2(n / (T + D))`` where the longest context known to the language has seen it n times (T bytes in all,
D different ones), and otherwise the escape ``-log2(D / (T + D))`` plus its code length in the next shorter context,
down to a uniform code of 8 bits. A text is in the language that codes it shortest.

All 256 byte values count (ASCII capitals are folded). Contexts of up to one byte are tables of all strings; longer ones
are kept as what they change of the shorter context's code, for the strings and languages that have them, so the model
grows with the sample and not with languages times strings. Whole batches are scored by array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import draw, fresh, named

#: Context before the first byte of a text.
START = b"\n\n\n"
#: Numbers (positions times languages) that are looked up at a time, and numbers up to which a sparse table is laid out whole.
BLOCK, WHOLE = 1 << 22, 1 << 22
UNKNOWN = "und"


@dataclass
class Sparse:
    """Numbers by string and language, 0 where there is none: sorted strings, where each one's entries begin, the entries."""

    codes: np.ndarray
    first: np.ndarray
    language: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(found: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        """From (strings, numbers) of each language."""
        code = np.concatenate([c for c, _ in found]).astype(np.uint32)
        language = np.repeat(np.arange(len(found), dtype=np.int16), [len(c) for c, _ in found])
        order = np.argsort(code, kind="stable")
        codes, times = np.unique(code, return_counts=True)
        return Sparse(codes, np.concatenate([[0], np.cumsum(times)]), language[order], np.concatenate([v for _, v in found])[order].astype(np.float32))

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.codes, self.first, self.language, self.value))

    def whole(self, languages: int) -> np.ndarray | None:
        """A row for no string and one for each string, or None where that takes over WHOLE numbers."""
        if (len(self.codes) + 1) * languages > WHOLE:
            return None
        out = np.zeros((len(self.codes) + 1, languages), np.float32)
        out[np.repeat(np.arange(1, len(self.codes) + 1), np.diff(self.first)), self.language] = self.value
        return out

    def add(self, place: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        """Adds the entries of the strings at ``place`` (from 1; 0 for none) to their owners' rows of ``out``."""
        known = place > 0
        at, owner = place[known] - 1, owner[known]
        times = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - np.cumsum(times) + times, times) + np.arange(times.sum())
        flat = np.repeat(owner.astype(np.int64), times) * out.shape[1] + self.language[entry]
        out += np.bincount(flat, self.value[entry], out.size).reshape(out.shape)


@dataclass
class Model:
    """``pair``: code lengths of the second byte of two under contexts of one byte at most; ``escape``: of leaving a context of two;
    ``third``, ``leave`` and ``fourth``: what strings of three, contexts of three and strings of four bytes change.
    """

    languages: list[str]
    pair: np.ndarray
    escape: np.ndarray
    third: Sparse
    leave: Sparse
    fourth: Sparse
    name: str = field(default_factory=lambda: uuid4().hex)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.pair, self.escape, self.third, self.leave, self.fourth))


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings, their code lengths where their context has seen them, contexts, and the code lengths of leaving those."""
    code, n = np.unique(codes, return_counts=True)
    context, at = np.unique(code >> 8, return_inverse=True)
    total, different = np.bincount(at, n), np.bincount(at)
    return code, -np.log2(n / (total + different)[at]), context, -np.log2(different / (total + different))


def train(texts: dict[str, list[bytes]]) -> Model:
    """Frozen statistics of each language's texts."""
    pairs, escapes, third, leave, fourth = [], [], [], [], []
    for own in texts.values():
        raw = np.frombuffer(b"".join(START + t.lower() for t in own), np.uint8).astype(np.int64)
        ends = np.cumsum([len(t) + 3 for t in own])
        inside = np.ones(len(raw), bool)
        for k in range(3):
            inside[ends - [len(t) + 3 for t in own] + k] = False
        at = np.flatnonzero(inside)
        strings = [raw[at]]
        for back in (1, 2, 3):
            strings.append(raw[at - back] << 8 * back | strings[-1])
        code, bits, _, out = _counted(strings[0])
        single = np.full(256, 8.0 + (out[0] if len(out) else 0.0))
        single[code] = bits
        code, bits, context, out = _counted(strings[1])
        left = np.zeros(256)
        left[context] = out
        pair = (left[:, None] + single[None, :]).reshape(-1)
        pair[code] = bits
        code, bits, context, out = _counted(strings[2])
        escape = np.zeros(65536)
        escape[context] = out
        change = bits - pair[code & 0xFFFF] - escape[code >> 8]
        long, long_bits, context, out = _counted(strings[3])
        shorter = bits[np.searchsorted(code, long & 0xFFFFFF)]  # the end of a string that was seen was seen
        pairs.append(pair)
        escapes.append(escape)
        third.append((code, change))
        leave.append((context, out))
        fourth.append((long, long_bits - shorter - out[np.searchsorted(context, long >> 8)]))
    return Model(list(texts), np.stack(pairs, 1).astype(np.float32), np.stack(escapes, 1).astype(np.float32), Sparse.of(third), Sparse.of(leave), Sparse.of(fourth))


class Scorer:
    """Code lengths of texts under a model."""

    def __init__(self, model: Model):
        self.model = model
        n = len(model.languages)
        self.block = max(1 << 14, BLOCK // n)
        self.tables = [(t, t.whole(n)) for t in (model.third, model.leave, model.fourth)]
        self.places = []
        for t in (model.third, model.leave):
            place = np.zeros(1 << 24, np.int32)
            place[t.codes] = np.arange(1, len(t.codes) + 1)
            self.places.append(place)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths, a row for each text and a column for each language."""
        out = np.zeros((len(texts), len(self.model.languages)))
        held, owners, size = [], [], 0
        for i, text in enumerate(texts):
            text = text.lower()
            for at in range(0, len(text), self.block):
                before = (START + text[:at])[-3:] if at < 3 else text[at - 3 : at]
                held.append(before + text[at : at + self.block])
                owners.append(i)
                size += len(held[-1])
                if size >= self.block:
                    self._add(held, owners, out)
                    held, owners, size = [], [], 0
        if held:
            self._add(held, owners, out)
        return out

    def _add(self, parts: list[bytes], owners: list[int], out: np.ndarray) -> None:
        m = self.model
        raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
        string = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        context = string >> np.uint32(8)
        last = np.searchsorted(m.fourth.codes, string)
        last[last == len(m.fourth.codes)] = 0
        found = (self.places[0][string & np.uint32(0xFFFFFF)], self.places[1][context], np.where(m.fourth.codes[last] == string, last + 1, 0))
        bits = m.pair[string & np.uint32(0xFFFF)]
        bits += m.escape[context & np.uint32(0xFFFF)]
        lengths = np.array([len(p) for p in parts])
        starts = np.cumsum(lengths) - lengths
        sparse = []
        for (table, whole), place in zip(self.tables, found):
            if whole is not None:
                bits += whole[place]
            else:
                sparse.append((table, place))
        # Sums over [start, start + length - 3): what lies between two texts falls to the odd places.
        cuts = np.stack([starts, starts + lengths - 3], 1).reshape(-1)
        if cuts[-1] >= len(bits):
            cuts = cuts[:-1]
        sums = np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)[::2]
        if sparse:
            owner = np.repeat(np.arange(len(parts)), lengths)[:-3]
            inside = np.arange(len(owner)) - np.repeat(starts, lengths)[:-3] < np.repeat(lengths, lengths)[:-3] - 3
            for table, place in sparse:
                table.add(place[inside], owner[inside], sums)
        np.add.at(out, owners, sums)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language with the shortest code and its share of the probability of the text, ties to the first."""
        bits = self.bits(texts)
        best = bits.argmin(1) if len(texts) else np.zeros(0, int)
        share = 1.0 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000.0)).sum(1) if len(texts) else np.zeros(0)
        return [self.model.languages[i] for i in best], share


def sample(docs: DataFrame, learn: Column, text: str, lang: str, per_language: int, most_bytes: int, total_bytes: int, most_languages: int) -> dict[str, list[bytes]]:
    """About ``per_language`` different texts of each of the ``most_languages`` most frequent languages, by hash of the text.

    Of a longer text some ``most_bytes`` bytes are taken, from a place given by its hash. Languages share ``total_bytes``
    evenly. This is the one bounded sample; it comes to the driver. Equal texts count once, and statistics are
    pre-aggregated, so a third of all rows in one language, key or text changes nothing.
    """
    t = named(text)
    width = F.greatest(F.lit(1), F.floor(F.length(t).cast("double") * most_bytes / F.octet_length(t))).cast("int")
    begin = (F.pmod(F.xxhash64(t), F.greatest(F.lit(1), F.length(t) - width)) + 1).cast("int")
    part = F.when(F.octet_length(t) <= most_bytes, t).otherwise(F.substring(t, begin, width))
    rows = docs.where(learn & named(lang).isNotNull() & (F.octet_length(t) > 0)).select(part.alias("t"), named(lang).alias("l"))
    figures = rows.groupBy("l").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("size")).orderBy(F.desc("n"), "l").limit(most_languages).collect()
    if not figures:
        return {}
    share = F.create_map(*[x for r in figures for x in (F.lit(r.l), F.lit(min(1.0, per_language / r.n, total_bytes / len(figures) / r.size)))])
    chosen = rows.where(draw(F.lit("language"), F.xxhash64("t")) < F.coalesce(share[F.col("l")], F.lit(0.0))).distinct().orderBy("l", "t").collect()
    out: dict[str, list[bytes]] = {}
    for r in chosen:
        out.setdefault(r.l, []).append(r.t.encode("utf-8"))
    return out


_SCORERS: dict[str, Scorer] = {}


def predictions(docs: DataFrame, model: Model | None, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` of ``docs`` (all if None) with ``__lang`` and ``__score``.

    Null texts and texts without a letter are ``und`` with score 0, and so are all without a model. Repeated rows give
    a row each; an empty table gives none. Added names begin with two underscores, and with more where the table has such
    a name itself (``common.fresh``).
    """
    keep = docs.columns if columns is None else columns
    lang_name, score_name, text_name, lettered_name = fresh(keep, "lang", "score", "text", "lettered")
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    lettered = F.coalesce(named(text).rlike(r"\p{L}"), F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model is not None and model.name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[model.name] = Scorer(model)
        for batch in batches:
            texts, own = batch.column(len(keep)), np.flatnonzero(batch.column(len(keep) + 1).to_numpy(zero_copy_only=False))
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if model is not None and len(own):
                lang[own], score[own] = _SCORERS[model.name].predict([texts[int(i)].as_py().encode("utf-8") for i in own])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score)], names=schema.names)

    return docs.select(*map(named, keep), named(text).alias(text_name), lettered.alias(lettered_name)).mapInArrow(run, schema)


def identify(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", per_language: int = 400, most_bytes: int = 32_768, total_bytes: int = 16 << 20, most_languages: int = 512, columns: list[str] | None = None) -> DataFrame:
    """Trains on the rows where ``learn`` holds and predicts every row."""
    texts = sample(docs, learn, text, lang, per_language, most_bytes, total_bytes, most_languages)
    return predictions(docs, train(texts) if texts else None, text, columns)
