"""Plain-Python kernels for what has no column form; they run inside Arrow batches on the executors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from hashlib import blake2b
from itertools import accumulate, pairwise

import numpy as np

_GAP = re.compile(r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])")
_ATX = re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*\Z")
_FENCE = re.compile(r"\s*(?:```|~~~)")


def decode(data: bytes) -> str:
    """UTF-8 (a byte order mark goes), else UTF-16, else Latin-1, which takes anything."""
    for name in ("utf-8-sig", "utf-16", "latin-1"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    raise AssertionError("latin-1 decodes every byte")


def sentences(text: str) -> list[str]:
    flat = " ".join(re.split(r"\s+", text)).strip()
    return [s for s in map(str.strip, _GAP.split(flat)) if s]


def _lines_of_words(sentence: str, size: int) -> list[str]:
    """A sentence broken between words, and words longer than a line broken anywhere."""
    out, line = [], ""
    for word in sentence.split(" "):
        if len(word) > size:
            if line:
                out.append(line)
            whole = (len(word) - 1) // size * size
            out += [word[i : i + size] for i in range(0, whole, size)]
            line = word[whole:]
        elif line and len(line) + 1 + len(word) > size:
            out.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return out + [line] if line else out


def units(text: str, size: int) -> list[tuple[int, str]]:
    """(paragraph number, text) of the parts, none longer than ``size``, that chunks are made of."""
    out = []
    for number, paragraph in enumerate(map(str.strip, re.split(r"\n\s*\n", text))):
        if len(paragraph) <= size:
            parts = [paragraph] if paragraph else []
        else:
            parts = [p for s in sentences(paragraph) for p in ([s] if len(s) <= size else _lines_of_words(s, size))]
        out += [(number, p) for p in parts]
    return out


def chunk_text(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of up to ``size`` characters that share up to ``overlap`` characters of whole parts with the one before.

    The parts lie on one line of text, with one space inside a paragraph and an empty line between paragraphs; a chunk
    is an interval of it, so its length is a difference of two positions.
    """
    parts = units(text, size)
    gaps = ["" if i == 0 else " " if parts[i - 1][0] == n else "\n\n" for i, (n, _) in enumerate(parts)]
    ends = list(accumulate(len(g) + len(p) for g, (_, p) in zip(gaps, parts)))
    starts = [e - len(p) for e, (_, p) in zip(ends, parts)]
    whole = "".join(g + p for g, (_, p) in zip(gaps, parts))
    out, first = [], 0
    for i in range(len(parts)):
        if i > first and ends[i] - starts[first] > size:
            out.append(whole[starts[first] : ends[i - 1]])
            again = i
            while again > first and ends[i - 1] - starts[again - 1] <= overlap:
                again -= 1
            first = again if ends[i] - starts[again] <= size else i
    if parts:
        out.append(whole[starts[first] : ends[-1]])
    return out


def markdown_sections(text: str) -> list[tuple[str, str | None]]:
    """(body, heading path) of what stands before the first heading and after each; lines between fences are no headings.

    The headings are found first. The path of each is that of the one before it, less what is as deep or deeper.
    """
    lines = text.splitlines()
    fences = accumulate(_FENCE.match(x) is not None for x in lines)
    heads = [(i, len(m[1]), m[2].strip()) for i, (x, n) in enumerate(zip(lines, fences)) if n % 2 == 0 and (m := _ATX.match(x))]
    paths = accumulate(heads, lambda above, head: [*(x for x in above if x[1] < head[1]), head], initial=[])
    edges = pairwise([-1, *(i for i, _, _ in heads), len(lines)])
    bodies = ("\n".join(lines[before + 1 : after]).strip() for before, after in edges)
    return [(body, " > ".join(said for _, _, said in path) or None) for body, path in zip(bodies, paths) if body]


def root_heading(found: list[tuple[str, str | None]]) -> str | None:
    return next((h.partition(" > ")[0] for _, h in found if h), None)


def _hashes(features: Iterable[str]) -> np.ndarray:
    return np.frombuffer(b"".join([blake2b(f.encode(), digest_size=8).digest() for f in features]), "<u8")


@lru_cache(maxsize=1 << 16)
def _word_hashes(token: str) -> np.ndarray:
    """Of a word and its letter trigrams."""
    edged = f"#{token}#"
    return _hashes([f"w:{token}", *(f"c:{edged[i : i + 3]}" for i in range(len(edged) - 2))])


def hash_embedding(tokens: list[str], dim: int) -> np.ndarray:
    """Signed feature hashing of words, their letter trigrams and their pairs, scaled to length 1.

    Words recur, so each is hashed once in a worker while it is remembered. Weights are multiples of a quarter, so sums
    are exact in any order.
    """
    if not tokens:
        return np.zeros(dim, np.float32)
    words, pairs = Counter(tokens), Counter(zip(tokens, tokens[1:]))
    found = [_word_hashes(t) for t in words]
    times = np.fromiter(words.values(), float, len(words))
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    weight = np.repeat(0.25 * times, sizes)
    weight[np.cumsum(sizes) - sizes] = times  # the word itself stands before its trigrams
    value = np.concatenate([*found, _hashes([f"b:{a}_{b}" for a, b in pairs])])
    weight = np.concatenate([weight, 0.5 * np.fromiter(pairs.values(), float, len(pairs))])
    out = np.bincount((value % np.uint64(dim)).astype(np.int64), np.where(value >> np.uint64(63), weight, -weight), dim)
    length = float(np.sqrt(out @ out))
    return (out / length if length else out).astype(np.float32)
