"""Token counts by a finite-state transducer compiled from a byte-level BPE definition.

Compilation. For byte-pair merges, the last token of the encoding of a prefix is the only vocabulary entry that ends
there and is compatible with the last token of what stands before it. So a deterministic machine can read a pretoken
byte by byte: its state holds the last token and, for every start from which some longer entry could still end, the
place in the vocabulary trie, the last token before that start and the count there relative to the present one. Each
transition is annotated with the change of the number of emitted tokens. States are numbered as they are first
reached, so the machine is compiled as far as the texts need it and each transition is worked out once in a worker.

Composition. A text is cut into chunks where a pretoken ends whatever stands around it; there the machine is in its start
state. A pretoken longer than a chunk is cut into chunks itself. Each chunk becomes a state map: from the state in which it
is entered to the state after it and the tokens counted. A map is worked out for the state that the bytes before the chunk
suggest, and for any other state it turns out to be entered in: that run ends as soon as it meets the known one. Maps
compose associatively and are reduced by a scan over halves, of which only the last value is kept.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named
from .packing import byte_of_letter

#: Characters of a chunk, or bytes where it lies inside one pretoken.
CHUNK = 1 << 16
#: States of the machine before it is begun anew (some 900 bytes each), looked at after every STRETCH bytes.
MOST_STATES, STRETCH = 1 << 18, 1024
#: Bytes of a worker's memory of counts, for words and for parts of texts, and of an entry of it.
MEMORY_WORDS, MEMORY_PARTS, ENTRY = 32 << 20, 80 << 20, 160
#: Letters of the longest word that is remembered, and bytes of a worker's memory of edges of tokens.
LONGEST_WORD, MEMORY_EDGES = 48, 48 << 20
#: Bytes before a chunk from which the state at its start is guessed.
BEFORE = 64
BASE = 128
#: The state at the start of a pretoken.
START: tuple = (None, ())
#: Where a pretoken ends whatever stands around: before white space, and after letters or digits before anything else.
SAFE_CUT = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])"
TWO_SPACES = re.compile(r"\s\s")
RESET = re.compile(r"(?<=\S) (?=\S)")
X = TypeVar("X")


def between_resets(text: str) -> list[str]:
    """The parts of a text between single spaces that stand between two characters that aren't white space.

    Such a space begins a new pretoken wherever it stands.
    """
    return RESET.split(text) if TWO_SPACES.search(text) else text.split(" ")


class Remembered(dict):
    """What ``of`` gives for a key, remembered for short keys until MEMORY is full, then forgotten and begun again."""

    def __init__(self, of: Callable, memory: int, entry: int):
        super().__init__()
        self.of = of
        self.most = memory // entry

    def __missing__(self, key: str | int):
        out = self.of(key)
        if isinstance(key, int) or len(key) <= LONGEST_WORD:
            if len(self) >= self.most:
                self.clear()
            self[key] = out
        return out


class Machine:
    """The transducer for one pretoken."""

    def __init__(self, definition: str):
        model = json.loads(definition)["model"]
        letters = byte_of_letter()
        vocab: dict[str, int] = model["vocab"]
        raw = {i: bytes(map(letters.__getitem__, t)) for t, i in vocab.items() if all(c in letters for c in t)}
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.made_at: dict[int, int] = {}
        for at, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            both, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[both] = at
            if whole not in self.split:
                self.split[whole], self.made_at[whole] = both, at
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner: list[bool] = [False]
        for i, word in raw.items():
            if len(word) > 1 and i not in self.split:
                continue  # no merge makes it, so no encoding has it
            node = 0
            for byte in word:
                self.inner[node] = True
                step = self.child.get(node << 8 | byte)
                if step is None:
                    step = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = step
            self.token[node] = i
        self.right = Remembered(lambda t: self._edge(t, 1), MEMORY_EDGES, 256)
        self.left = Remembered(lambda t: self._edge(t, 0), MEMORY_EDGES, 256)
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [START]
        self.number: dict[tuple, int] = {START: 0}
        self.table: dict[int, int] = {}
        self.ends: dict[int, int] = {}

    def _number(self, state: tuple) -> int:
        at = self.number.get(state)
        if at is None:
            at = self.number[state] = len(self.states)
            self.states.append(state)
        return at

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts that stood at one edge of a token while it was built, each with the merge that took it up."""
        out, until = [(token, float("inf"))], token
        while until in self.split:
            out.append((self.split[until][side], self.made_at[until]))
            until = self.split[until][side]
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge across the border comes before both sides are whole (of equal merges the left comes first)."""
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                at = self.rank.get((x, y))
                if at is not None and at < x_until and at <= y_until:
                    return False
        return True

    def _step(self, state: int, byte: int) -> tuple[int, int, list[tuple]]:
        """The last token after a byte, the change of the number of tokens, and the places in the trie that are reached."""
        last, active = self.states[state]
        child = self.child
        reached = [(step, before, count) for node, before, count in (*active, (0, last, 0)) if (step := child.get(node << 8 | byte)) is not None]
        for node, before, count in reached:  # the longest entry first
            token = self.token[node]
            if token >= 0 and (before is None or self.compatible(before, token)):
                return token, count + 1, reached
        raise AssertionError("every byte is a token")

    def _compile(self, state: int, byte: int) -> int:
        token, change, reached = self._step(state, byte)
        inner = self.inner
        new = (token, tuple([(n, b, c - change) for n, b, c in reached if inner[n]]))
        out = self.table[state << 8 | byte] = (self._number(new) << 8) + change + BASE
        return out

    def _end(self, state: int, byte: int) -> int:
        """A transition at the end of a pretoken, which needs no state to go on from."""
        out = self.ends[state << 8 | byte] = self._step(state, byte)[1] + BASE
        return out

    def run(self, data: bytes, entry: tuple = START) -> tuple[tuple, int]:
        """The state after ``data`` and the tokens counted. Full tables are begun anew, inside a pretoken too."""
        state, total = self._number(entry), 0
        for at in range(0, len(data), STRETCH):
            if len(self.states) > MOST_STATES:
                now = self.states[state]
                self.reset()
                state = self._number(now)
            get = self.table.get
            for byte in data[at : at + STRETCH]:
                step = get(state << 8 | byte) or self._compile(state, byte)
                state = step >> 8
                total += (step & 255) - BASE
        return self.states[state], total

    def count(self, pretoken: bytes) -> int:
        """Tokens of one pretoken."""
        if len(pretoken) > STRETCH:
            return self.run(pretoken)[1]
        if len(self.states) + len(self.ends) // 4 > MOST_STATES:
            self.reset()
        state = total = 0
        get = self.table.get
        for byte in pretoken[:-1]:
            step = get(state << 8 | byte) or self._compile(state, byte)
            state = step >> 8
            total += (step & 255) - BASE
        at = state << 8 | pretoken[-1]
        step = get(at) or self.ends.get(at) or self._end(state, pretoken[-1])
        return total + (step & 255) - BASE


class ChunkMap:
    """From the state in which a chunk is entered to the state after it and its tokens."""

    def __init__(self, way: Callable[[tuple], tuple[tuple, int]], entries: Iterable[tuple]):
        self.way = way
        self.ways: dict[tuple, tuple[tuple, int]] = {}
        for s in entries:
            self.after(s)

    def after(self, entry: tuple) -> tuple[tuple, int]:
        if entry not in self.ways:
            self.ways[entry] = self.way(entry)
        return self.ways[entry]

    def then(self, other: ChunkMap) -> ChunkMap:
        def way(entry: tuple) -> tuple[tuple, int]:
            middle, n = self.after(entry)
            end, m = other.after(middle)
            return end, n + m

        return ChunkMap(way, self.ways)


def inside(machine: Machine, data: bytes, before: bytes, last: bool) -> ChunkMap:
    """The map of a chunk inside a pretoken. ``before`` are the bytes before it; after the ``last`` one the pretoken ends."""
    marks: dict[int, tuple[tuple, int]] = {}
    known: list[tuple[tuple, int]] = []

    def way(entry: tuple) -> tuple[tuple, int]:
        state, total, at, to = entry, 0, 0, BEFORE
        while at < len(data):
            state, n = machine.run(data[at:to], state)
            total, at, to = total + n, to, 2 * to
            if not known:
                marks[at] = state, total
            elif marks[at][0] == state:  # from here on as before
                return known[0][0], total + known[0][1] - marks[at][1]
        out = START if last else state, total
        if not known:
            known.append(out)
        return out

    return ChunkMap(way, [machine.run(before)[0]])


def reduced(items: Iterable[X], combine: Callable[[X, X], X]) -> X | None:
    """The last value of a prefix scan over halves: equal numbers of neighbours are combined as soon as both are there."""
    held: list[tuple[int, X]] = []
    for x in items:
        n = 1
        while held and held[-1][0] == n:
            x, n = combine(held.pop()[1], x), 2 * n
        held.append((n, x))
    out = held.pop()[1] if held else None
    while held:
        out = combine(held.pop()[1], out)
    return out


class Counter:
    """Counts the tokens of whole texts."""

    def __init__(self, definition: str):
        import public_tokenizers
        import regex

        self.machine = Machine(definition)
        self.pretokens = regex.compile(public_tokenizers.PATTERN)
        self.safe = regex.compile(SAFE_CUT)
        specials = [t["content"] for t in json.loads(definition).get("added_tokens", [])]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.special_set = set(specials)
        self.words: Remembered = Remembered(lambda word: self.machine.count(word.encode("utf-8")), MEMORY_WORDS, ENTRY)
        self.parts: Remembered = Remembered(self._part, MEMORY_PARTS, ENTRY)

    def _part(self, part: str) -> int:
        """A part that follows a space. Letters alone are one pretoken with it, and so is a last sign a second one."""
        if part.isalpha():
            return self.machine.count(b" " + part.encode("utf-8"))
        if part[-1:] in (".", ",", "!", "?") and part[:-1].isalpha():
            return self.words[" " + part[:-1]] + self.words[part[-1]]
        return self.run(" " + part)

    def _sections(self, text: str) -> list[str]:
        """A text cut at its special strings, which are sections of their own."""
        return [x for x in self.special.split(text) if x] if any(s in text for s in self.special_set) else [text]

    def run(self, text: str) -> int:
        """The machine over a short text that is entered in the start state."""
        return sum(1 if piece in self.special_set else sum(map(self.words.__getitem__, self.pretokens.findall(piece))) for piece in self._sections(text))

    def whole(self, text: str) -> int:
        """The same by its parts, most of which recur."""
        first, *parts = between_resets(text)
        return self.run(first) + sum(map(self.parts.__getitem__, parts))

    def _cut(self, text: str, at: int, to: int) -> int | None:
        """The last safe cut after ``at`` up to ``to``."""
        for start in (max(at + 1, to - 256), at + 1):
            found = None
            for found in self.safe.finditer(text, start, to):
                pass
            if found is not None:
                return found.start()
        return None

    def maps(self, text: str) -> Iterator[ChunkMap]:
        """The state maps of a text's chunks, one after the other."""
        for section in self._sections(text):
            if section in self.special_set:
                yield ChunkMap(lambda entry: (START, 1), [START])
                continue
            at = 0
            while at < len(section):
                to = len(section) if len(section) - at <= CHUNK else self._cut(section, at, at + CHUNK)
                if to is not None:
                    n = self.whole(section[at:to])
                    yield ChunkMap(lambda entry, n=n: (START, n), [START])
                else:  # up to three pretokens, one of them longer than a chunk
                    later = self.safe.search(section, at + CHUNK)
                    to = later.start() if later else len(section)
                    for pretoken in self.pretokens.finditer(section[at:to]):
                        data = pretoken[0].encode("utf-8")
                        for i in range(0, len(data), CHUNK):
                            yield inside(self.machine, data[i : i + CHUNK], data[max(0, i - BEFORE) : i], i + CHUNK >= len(data))
                at = to

    def __call__(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.whole(text)
        return reduced(self.maps(text), ChunkMap.then).after(START)[1]


_COUNTERS: dict[int, Counter] = {}


def counter(definition: str) -> Counter:
    """One counter for a worker process, kept from task to task."""
    key = zlib.crc32(definition.encode())
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(definition)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, definition: str, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """Per row of ``docs``: key, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    Null texts count as empty. Repeated rows and null keys give a row each; an empty table gives none. Extra columns
    are not read.
    """
    whole = F.coalesce(named(text), F.lit(""))
    schema = T.StructType([T.StructField("__key", docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([count(t.as_py()) for t in batch.column(2)], pa.int64())], names=schema.names)

    counted = docs.select(named(key), F.octet_length(whole).cast("long").alias("__n"), whole.alias("__text")).mapInArrow(run, schema)
    return counted.select(F.col("__key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
