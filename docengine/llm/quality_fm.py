"""Quality scores from a factorisation machine.

Features of a text are its hashed words (weighted by the root of their share), binned structure statistics and the
binned length that the table's metadata gives. The machine scores

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

in time linear in the features: the second part is the sum over all pairs <v_i, v_j> x_i x_j by the sum-of-squares
identity. It is fitted by full-batch Adam on a bounded sample of labelled rows; every row of the table is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import draw, fresh, named

WORD_BITS = 14
WORDS = 1 << WORD_BITS
BINS = 12
FACTORS = 4
BLOCK_WORDS = 1 << 20


def structure(text: str, raw: bytes, counts: Counter, n_chars: int | None) -> list[int]:
    """Bins (0 to BINS - 1) of the structure statistics and of the metadata."""
    n, size = sum(counts.values()), max(1, len(text))
    log = lambda x: min(BINS - 1, int(x).bit_length())
    share = lambda part, whole: min(BINS - 1, int((BINS - 1) * part / whole + 0.999)) if whole else 0
    symbols = sum(map(text.count, "#*$%&|<>"))
    marks = sum(map(text.count, ".!?"))
    capitals = sum(map(raw.count, (b"%c" % c for c in range(65, 91))))
    digits = sum(map(raw.count, (b"%c" % c for c in range(48, 58))))
    lines = text.split("\n")
    return [
        log(n),
        share(len(counts), n),
        share(max(counts.values(), default=0), n),
        share(symbols, n),
        share(text.count("!"), n),
        share(text.count("|"), n),
        share(capitals, size),
        share(10 * digits, size),
        log(size // max(1, n)),
        log(size // len(lines)),
        share(marks, n),
        share(len(lines) - len(set(lines)), len(lines)),
        log(text.count("�")),
        log(n_chars) if n_chars is not None and n_chars >= 0 else 0,
        0 if n_chars is None else 1 + (n_chars == len(text)),
    ]


N_STATISTICS = 15
FEATURES = WORDS + N_STATISTICS * BINS


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8")
    counts = Counter(raw.split())
    mask = WORDS - 1
    words = np.fromiter((crc32(w) & mask for w in counts), np.int32, len(counts))
    times = np.fromiter(counts.values(), np.float64, len(counts))
    bins = np.array(structure(text, raw, counts, n_chars), np.int32) + WORDS + BINS * np.arange(N_STATISTICS, dtype=np.int32)
    values = np.sqrt(times / max(1.0, times.sum()))
    return np.concatenate([words, bins]), np.concatenate([values, np.full(N_STATISTICS, 0.5)])


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw_scores(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of rows laid end to end; each has features, so no row is empty."""
        linear = np.add.reduceat(self.w[index] * value, starts)
        vx = self.v[index] * value[:, None]
        squares = np.add.reduceat(vx, starts) ** 2 - np.add.reduceat(vx * vx, starts)
        return self.w0 + linear + 0.5 * squares.sum(1)

    def scores(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw_scores(index, value, starts), -35, 35)))


def fit(index: np.ndarray, value: np.ndarray, starts: np.ndarray, label: np.ndarray, rounds: int = 60, rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss, full-batch Adam. One class alone gives its smoothed share for every text."""
    p = (label.sum() + 1.0) / (len(label) + 2.0)
    rng = np.random.default_rng(seed)
    m = Machine(float(np.log(p / (1 - p))), np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, FACTORS)))
    if len(set(label.tolist())) < 2:
        m.v[:] = 0
        return m
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(index))))
    mean, var = np.zeros((FEATURES, FACTORS + 1)), np.zeros((FEATURES, FACTORS + 1))
    for t in range(1, rounds + 1):
        error = (m.scores(index, value, starts) - label)[row] / len(label)
        vx = m.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts)[row]
        ev = error * value
        grad = np.empty((FEATURES, FACTORS + 1))
        grad[:, 0] = np.bincount(index, ev, FEATURES)
        for f in range(FACTORS):
            grad[:, f + 1] = np.bincount(index, ev * (sums[:, f] - vx[:, f]), FEATURES)
        grad[:, 0] += decay * m.w
        grad[:, 1:] += decay * m.v
        mean = 0.9 * mean + 0.1 * grad
        var = 0.99 * var + 0.01 * grad * grad
        step = rate * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-9)
        m.w -= step[:, 0]
        m.v -= step[:, 1:] * 0.5
        m.w0 -= rate * 0.5 * error.sum() / max(1, np.mean(np.diff(np.append(starts, len(index)))))
    return m


def _laid_out(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(i) for i, _ in found])
    return np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found]), np.cumsum(sizes) - sizes


def train(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "quality", chars: str = "n_chars", most_rows: int = 4000, most_bytes: int = 65_536) -> Machine | None:
    """A machine fitted on about ``most_rows`` labelled documents of up to ``most_bytes`` for which ``learn`` holds.

    The labels are thinned by hash before they meet the documents, and of rows that share a key one is learnt from, so the
    joined side and what comes to the driver are bounded by the two parameters. Rows with null labels or keys aren't
    learnt from.
    """
    usable = labels.select(named(key), named(label).alias("__y")).where(learn & named(key).isNotNull() & F.col("__y").isNotNull()).groupBy(named(key).alias("__key")).agg(F.max("__y").alias("y"))
    n = usable.count()
    chosen = usable.where(draw(F.lit("quality"), F.col("__key")) < F.lit(min(1.0, most_rows / max(1, n))))
    meta = named(chars) if chars in docs.columns else F.lit(None)
    short = docs.where(F.octet_length(named(text)) <= most_bytes).select(named(key).alias("__key"), named(text).alias("t"), meta.cast("long").alias("c"))
    rows = short.join(F.broadcast(chosen), "__key").groupBy("__key", "y").agg(F.min(F.struct("t", "c")).alias("row")).select("__key", "row.t", "row.c", F.col("y").cast("double").alias("y"))
    got = rows.orderBy("__key").select("t", "c", "y").toPandas()
    if got.empty:
        return None
    found = [features(t, None if c is None or c != c else int(c)) for t, c in zip(got.t, got.c)]
    return fit(*_laid_out(found), got.y.to_numpy())


def scored(docs: DataFrame, machine: Machine | None, text: str = "text", chars: str = "n_chars", columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` of ``docs`` (all if None) with ``__score`` from 0 to 1.

    Null texts are scored as empty ones. Without a machine every score is 0.5. Repeated rows give a row each; an empty
    table gives none. The added name begins with two underscores, and with more where the table has it (``common.fresh``).
    """
    keep = docs.columns if columns is None else columns
    score_name, text_name, chars_name = fresh(keep, "score", "text", "chars")
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(score_name, T.DoubleType())])
    meta = named(chars) if chars in docs.columns else F.lit(None)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out, held, size = [np.zeros(0)], [], 0
            for t, c in zip(batch.column(len(keep)), batch.column(len(keep) + 1).to_pylist()):
                if m is None:
                    continue
                held.append(features(t.as_py(), c))
                size += len(held[-1][0])
                if size >= BLOCK_WORDS:
                    out.append(m.scores(*_laid_out(held)))
                    held, size = [], 0
            if held:
                out.append(m.scores(*_laid_out(held)))
            score = np.concatenate(out) if m is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], names=schema.names)

    return docs.select(*map(named, keep), named(text).alias(text_name), meta.cast("long").alias(chars_name)).mapInArrow(run, schema)
