"""Best-fit packing by fitted patterns.

Documents become token pieces of at most ``LIMIT`` tokens; only the histogram of piece lengths (at most ``LIMIT``
counts) comes to the driver. There, patterns of two to four lengths that fill a sequence exactly are enumerated, their
repeat counts are fitted to the histogram by non-negative least squares and rounded down to what is there, and what
is left is packed best-fit decreasing, again as patterns with repeats. The plan is bounded by the number of lengths,
not by the data. Each piece then finds its slot from its rank among the pieces of its length, which is found in two
levels (length and salt), so a length that holds a third of all pieces isn't gathered in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, named

LIMIT = 1024
PIECES_PER_SALT = 20_000
#: What stands for the end of a document.
END_ID = 2
#: Runs of white space (as Unicode has it) that are too long for the encoder's pattern, which tracks back over each character.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def byte_of_letter() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(definition: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Tokens as bytes with their ids, and the special strings with theirs, of a byte-level BPE definition."""
    j = json.loads(definition)
    letters = byte_of_letter()
    special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
    return {bytes(map(letters.__getitem__, t)): i for t, i in j["model"]["vocab"].items() if t not in special}, special


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers in bytes.

    ids come from the merge ranks of the same vocabulary, so they are those of the tokenizer the definition is of. They stay
    in a buffer and never become a list of numbers, which costs more than encoding.

    The last character of a run of white space goes to what follows it and the rest is one pretoken, so long runs are cut
    out by that rule instead of by the pattern.
    """

    def __init__(self, definition: str):
        import public_tokenizers
        import tiktoken

        ranks, special = vocabulary(definition)
        self.encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def plain(self, text: str) -> bytes:
        """ids of a text without long runs of white space."""
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    def _with_runs(self, section: str) -> Iterator[bytes]:
        """ids of a text that is one special string or holds none, with its long runs of white space taken apart."""
        at = 0
        for run in LONG_RUN.finditer(section):
            yield self.plain(section[at : run.start()])
            at = run.end() if run.end() == len(section) else run.end() - 1
            yield array("I", self.encoding._encode_single_piece(section[run.start() : at])).tobytes()
        yield self.plain(section[at:])

    def __call__(self, text: str) -> bytes:
        if len(text) >= 4096 and LONG_RUN.search(text):
            sections = self.special.split(text) if self.special else [text]
            return b"".join(ids for section in sections for ids in self._with_runs(section))
        return self.plain(text)


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One encoder for a worker process, kept from task to task."""
    key = zlib.crc32(definition.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def piece_starts(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: all of ``limit``, but for a shorter first one."""
    first = n % limit or min(n, limit)
    return [(0, first)] + [(at, limit) for at in range(first, n, limit)]


PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, definition: str, text: str = "text", key: str = "doc_id", ids: bool = False, limit: int = LIMIT) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and the ids themselves if asked for) of every document."""
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(PIECE + ", ids array<int>" * ids)])
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            row, piece, start, length, crc, own = [], [], [], [], [], []
            for r, x in enumerate(batch.column(1)):
                raw = encode(x.as_py() or "") + end
                for k, (at, n) in enumerate(piece_starts(len(raw) // 4, limit)):
                    part = raw[4 * at : 4 * (at + n)]
                    for to, v in ((row, r), (piece, k), (start, at), (length, n), (crc, zlib.crc32(part))):
                        to.append(v)
                    if ids:
                        own.append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(own, pa.list_(pa.int32()))] if ids else []), names=schema.names)

    return docs.select(named(key), named(text)).mapInArrow(run, schema)


def patterns_for(counts: np.ndarray, limit: int = LIMIT, most: int = 6000) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths present that add up to ``limit``: all pairs, then those with common lengths."""
    there = np.flatnonzero(counts[:limit])
    there = there[there > 0]
    have = set(there.tolist())
    out = {(a, limit - a) for a in have if a <= limit - a and limit - a in have}
    common = there[np.argsort(-counts[there], kind="stable")].tolist()
    for width in (24, 48, 96, 192):
        for i, b in enumerate(common[:width]):
            for a in common:
                if (c := limit - a - b) in have:
                    out.add(tuple(sorted((a, b, c))))
                for b2 in common[: min(i + 1, 8)]:
                    if (c := limit - a - b - b2) in have:
                        out.add(tuple(sorted((a, b, b2, c))))
                if len(out) >= most:
                    return sorted(out, key=lambda p: (len(p), p))
    return sorted(out, key=lambda p: (len(p), p))


def fitted(counts: np.ndarray, found: list[tuple[int, ...]], sweeps: int = 40) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that bring their lengths nearest to ``counts`` (least squares).

    Coordinate descent: each pattern in turn takes its best value against what the others leave.
    """
    rest, x = counts.astype(float).copy(), np.zeros(len(found))
    parts = [tuple(Counter(p).items()) for p in found]
    norms = [sum(m * m for _, m in p) for p in parts]
    for _ in range(sweeps):
        moved = 0.0
        for i, p in enumerate(parts):
            step = max(-x[i], sum(m * rest[n] for n, m in p) / norms[i])
            if abs(step) > 1e-9:
                x[i] += step
                moved = max(moved, abs(step))
                for n, m in p:
                    rest[n] -= m * step
        if moved < 0.25:
            break
    return x


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up ``histogram`` exactly."""
    counts = np.zeros(limit + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    out = [((limit,), int(counts[limit]))] if counts[limit] else []
    left = counts.copy()
    left[limit] = 0
    found = patterns_for(counts, limit)
    repeats = np.floor(fitted(left, found) + 1e-6).astype(np.int64)
    for p, r in sorted(zip(found, repeats.tolist()), key=lambda t: -t[1]):
        r = min([r, *(int(left[n]) // m for n, m in Counter(p).items())])
        if r > 0:
            out.append((p, r))
            for n in p:
                left[n] -= r
    there = sorted(np.flatnonzero(left).tolist())
    while there:
        space, pattern, use = limit, [], Counter()
        for n in reversed(there):  # the largest that fits is the best fit for what is left of the sequence
            k = min(space // n, int(left[n]))
            if k:
                pattern += [n] * k
                use[n] = k
                space -= k * n
        r = min(int(left[n]) // k for n, k in use.items())
        for n, k in use.items():
            left[n] -= r * k
        out.append((tuple(pattern), r))
        there = [n for n in there if left[n]]
    return out


def slots(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first slot, how often in the pattern, first sequence, first offset), by first slot."""
    used: Counter[int] = Counter()
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for p, r in packed:
        offset = 0
        for n, m in Counter(p).items():
            rows.setdefault(n, []).append((used[n], m, sequence, offset))
            used[n] += m * r
            offset += m * n
        sequence += r
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def ranked(found: DataFrame, key: str, histogram: dict[int, int]) -> DataFrame:
    """``found`` with ``__rank``, from 0 among the pieces of the same length.

    A length has a salt for every PIECES_PER_SALT of its pieces, and 8 at least, so the table of salts stays small. Rows
    are dealt to the salts in turn, not by what they hold, so equal rows and null keys don't meet in one.
    """
    most = max(histogram, default=0)
    shares = F.array(*[F.lit(max(8, -(-histogram.get(n, 0) // PIECES_PER_SALT))) for n in range(most + 1)])
    salted = found.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.get(shares, F.col("length").cast("int"))))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "__salt").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = Window.partitionBy("length", "__salt").orderBy(named(key), "piece", "ids_crc32")
    inside = salted.withColumn("__inside", F.row_number().over(order))
    return inside.join(offsets, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__inside") - 1).drop("__salt", "__inside", "__before")


def pack(docs: DataFrame, definition: str, text: str = "text", key: str = "doc_id", ids: bool = False, limit: int = LIMIT) -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32, (ids,) sequence_id and offset.

    Null and empty texts are documents of the end id alone. Repeated rows and null keys are packed like any other. No
    rows give no pieces. Extra columns aren't read.
    """
    found = cut(pieces(docs, definition, text, key, ids, limit))
    histogram = {r.length: r["count"] for r in found.groupBy("length").count().collect()}  # limit rows at most
    where = docs.sparkSession.sparkContext.broadcast(slots(plan(histogram, limit)))
    placed = ranked(found, key, histogram)
    columns = [key, "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    schema = T.StructType([found.schema[c] for c in columns] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, len(columns)))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                rows = where.value[n]
                first, m, seq, off = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1].T
                j = rank[own] - first
                sequence[own], offset[own] = seq + j // m, off + j % m * n
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(sequence), pa.array(offset)], names=schema.names)

    return placed.select(*map(named, columns), "__rank").mapInArrow(run, schema)
