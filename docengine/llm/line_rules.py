"""Quality rules that clean line by line before they judge the document.

Each line with a word is held against rules for symbols, navigation, shouting, boilerplate and punctuation; lines that
fail are removed. A document is rejected if the whole text fails the base rules (too few words, too much repetition)
or if the removed lines held too many of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WHITE_SPACE, fresh, named

SYMBOLS = "#*$%&|<>"
#: Phrases of site furniture, lower case.
BOILERPLATE = re.compile(
    r"\b(?:cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|accept (?:all )?cookies|enable javascript|javascript is (?:disabled|required)"
    r"|click here to|sign up for our newsletter|subscribe to our newsletter|skip to (?:main )?content|lorem ipsum|powered by wordpress|add to cart|forgot your password)\b"
)
#: Ends of sentences: Latin, CJK, Arabic and Urdu, Devanagari, Armenian, Ethiopic, Khmer, Burmese, Tibetan, Mongolian.
SENTENCE = re.compile(r"[.!?…。！？｡．؟۔।॥։።፧។៕။།༎᠃᠉]")
#: Thai and Lao, which end sentences with no mark.
UNMARKED = re.compile(r"[\u0e00-\u0eff]")


@dataclass(frozen=True)
class LineRules:
    """Limits. A line of up to ``short`` words may be a heading; a longer one needs the end of a sentence in it."""

    least_words: int = 10
    repeated_percent: int = 20
    window: int = 5
    symbols_per_word: float = 0.3
    bars: int = 3
    least_letters: int = 20
    short: int = 12
    lost: float = 0.5


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows of ``window`` words that stand in the text twice or more, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    # Numbers for windows of growing length, each from a pair of numbers, so equal numbers mean equal windows.
    key, reach = at, 1
    while reach < window:
        step = min(reach, window - reach)
        pair = key[:-step] * (int(key.max()) + 1) + key[step:]
        if reach + step == window:
            key = pair
            break
        key, reach = np.unique(pair, return_inverse=True)[1], reach + step
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-window][twice] += 1
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_passes(line: str, rules: LineRules) -> bool:
    """Whether a line that has a word stays."""
    n = len(line.encode("utf-8").split())  # as in whole texts, at exactly the six ASCII white-space characters
    if line.count("|") >= rules.bars:  # navigation and tables cut into cells
        return False
    if sum(map(line.count, SYMBOLS)) > rules.symbols_per_word * n:
        return False
    capitals = sum(x.isupper() and x.isalpha() for x in line) if n > 1 and line.upper() == line else 0
    if capitals >= rules.least_letters:  # no small letter at all; letters without case don't count
        return False
    if BOILERPLATE.search(line.lower()):
        return False
    if n <= rules.short or SENTENCE.search(line):
        return True
    return 2 * len(UNMARKED.findall(line)) > len(line) - sum(map(line.count, WHITE_SPACE))


def judge(text: str | None, rules: LineRules = LineRules()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_words, cleaned text.

    A null text counts as empty: no words, base_failed, not kept, cleaned to null.
    """
    if text is None:
        return 0, 0, 0, 0, 0, True, False, 0, None
    raw = text.encode("utf-8")
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    n = len(words)
    chars = len(text) - sum(map(text.count, WHITE_SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    filled = [x for x in lines if x.strip(" \t\x0b\x0c\r")]
    duplicates = len(filled) - len(set(filled))
    again = repeated_words(words, rules.window)
    base_failed = n < rules.least_words or 100 * again > rules.repeated_percent * n
    stay = [x for x in filled if line_passes(x, rules)]
    kept_words = n if len(stay) == len(filled) else sum(len(x.encode("utf-8").split()) for x in stay)
    kept = not base_failed and n - kept_words <= rules.lost * n
    cleaned = text if len(stay) == len(filled) else "\n".join(stay)
    return n, chars, symbols, duplicates, again, base_failed, kept, kept_words, cleaned


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words", "cleaned")
KINDS = (*[T.LongType()] * 5, T.BooleanType(), T.BooleanType(), T.LongType(), T.StringType())


def judged(docs: DataFrame, text: str = "text", rules: LineRules = LineRules(), columns: list[str] | None = None, cleaned: bool = True) -> DataFrame:
    """The ``columns`` of ``docs`` (all if None) with the verdict of each row as ``__<field>``.

    Every row gives one row; an empty table gives none. The names of the added columns begin with two underscores, and
    with more where the table has such a name itself (``common.fresh``).
    """
    keep = docs.columns if columns is None else columns
    fields = [(f, k) for f, k in zip(FIELDS, KINDS) if cleaned or f != "cleaned"]
    names = fresh(keep, *[f for f, _ in fields])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, k) for n, (_, k) in zip(names, fields)])
    read = docs.select(*map(named, dict.fromkeys([*keep, text])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(x.as_py(), rules) for x in batch.column(batch.schema.get_field_index(text))]
            added = list(zip(*found)) if found else [()] * len(FIELDS)
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(added[i], pa.string() if f == "cleaned" else pa.bool_() if f in ("base_failed", "kept") else pa.int64()) for i, (f, _) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return read.mapInArrow(run, schema)
