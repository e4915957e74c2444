"""Text functions as columns: everything here runs inside the JVM.

All of them give null for null. Regular expressions are Java's; ``(?U)`` makes white space mean what Unicode says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word list, the patterns and the sentence that results depend on.
STOPWORDS = (
    "a about after all also an and any are as at be been before but by can could did do does each for from had has have how i if in into is it its "
    "just may might more most must no not of off on only or other our out over own per s same shall should so such t than that the their them then "
    "there these they this to under up very via was we were what when where which who whom why will with would you your yours"
).split()
TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])"
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"
MOVED_CITATION = r"([.!?])\s*((?:\[\d+(?:\s*,\s*\d+)*\]\s*)*\[\d+(?:\s*,\s*\d+)*\])\s*"
NO_ANSWER = "I could not find the answer in the provided documents."
SNIPPET_CHARS = 300
WHITE = r"(?U)[\s\x1c-\x1f]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, rf"^{WHITE}+|{WHITE}+\z", "")


@cache
def _capitals() -> tuple[str, str]:
    """The code points that have a capital of one code point, and these capitals."""
    pairs = {"ß": "ẞ"}
    for c in map(chr, range(0x20000)):  # planes 0 and 1; the others have no letters of two cases
        one = next((u for u in (c.upper(), c.title()) if len(u) == 1), c)
        if one != c:
            pairs[c] = one
    return "".join(pairs), "".join(pairs.values())


def upper(x: Column) -> Column:
    """Capitals one for one, as in SQL: ``ẞ`` for ``ß`` where Spark's own function writes ``SS``; ligatures have none and stay."""
    return F.translate(x, *_capitals())


def _without_last(x: Column, n: int) -> Column:
    return F.left(x, F.length(x) - n)


def stem(t: Column) -> Column:
    """Plural, -ing and -ed endings taken off one token."""
    plural = (F.length(t) > 3) & t.endswith("s") & ~(t.endswith("ss") | t.endswith("us") | t.endswith("is"))
    singular = F.when(t.endswith("sses"), _without_last(t, 2)).when(plural, _without_last(t, 1)).otherwise(t)
    base = let(singular, lambda u: F.when((F.length(u) > 5) & u.endswith("ing"), _without_last(u, 3)).when((F.length(u) > 4) & u.endswith("ed"), _without_last(u, 2)).otherwise(u))
    return F.when((F.length(t) > 4) & t.endswith("ies"), F.concat(_without_last(t, 3), F.lit("y"))).otherwise(base)


def raw_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case, each with an apostrophe suffix where there is one."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokenize(text: Column, drop_stopwords: bool = True, stemming: bool = True) -> Column:
    """Tokens in order, repeats kept; stop words go before stemming."""
    out = raw_tokens(text)
    if drop_stopwords:
        out = F.filter(out, lambda t: ~t.isin(*STOPWORDS))
    return F.transform(out, stem) if stemming else out


def split_sentences(text: Column) -> Column:
    """Sentences of the text with its white space collapsed."""
    flat = F.trim(F.regexp_replace(text, rf"{WHITE}+", " "))
    return F.filter(F.split(flat, SENTENCE_GAP), lambda s: s != "")  # gaps take all white space there is between sentences


def citation_refs(answer: Column) -> Column:
    """Cited numbers in order of first appearance."""
    lists = F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda v: F.split(v, ","))
    return F.array_distinct(F.transform(F.flatten(lists), lambda y: strip(y).cast("int")))


def strip_citations(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, CITATION, ""), rf"{WHITE}{{2,}}", " "))


def split_cited_sentences(answer: Column) -> Column:
    """Sentences with the citations that follow them moved in front of their full stop."""
    return split_sentences(F.regexp_replace(answer, MOVED_CITATION, " $2$1 "))


def search_text(heading: Column, text: Column) -> Column:
    """What is indexed: the heading path, if any, on a line before the text."""
    return F.when(F.length(heading) > 0, F.concat(heading, F.lit("\n"), text)).otherwise(text)


def snippet(text: Column) -> Column:
    cut = F.regexp_replace(F.left(text, F.lit(SNIPPET_CHARS)), rf"{WHITE}+\z", "")
    return F.when(F.length(text) > SNIPPET_CHARS, F.concat(cut, F.lit("..."))).otherwise(text)


def source_header(ref: Column, doc_name: Column, page: Column, heading: Column) -> Column:
    said = F.concat_ws(" | ", doc_name, F.concat(F.lit("page "), page.cast("string")), F.when(F.length(heading) > 0, F.concat(F.lit("section: "), heading)))
    return F.concat(F.lit("["), ref.cast("string"), F.lit("] source: "), said)


def result_label(document: Column, page: Column) -> Column:
    return F.when(page.isNotNull() & (page != 0), F.concat(document, F.lit("#p"), page.cast("string"))).otherwise(document)


def is_refusal(answer: Column) -> Column:
    return F.lower(F.regexp_replace(strip(answer), r"\.+\z", "")) == NO_ANSWER.rstrip(".").lower()


def doc_id(collection: Column, name: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("/", collection, name), 256), F.lit(16))


def base_name(name: Column) -> Column:
    """The last part of a path, with either kind of slash; ``document`` if nothing is left."""
    last = F.regexp_extract(F.translate(name, "\\", "/"), r"([^/]*)/*\z", 1)
    return F.when((last == "") | last.isin(".", ".."), F.lit("document")).otherwise(last)


def expected_source(said: Column) -> Column:
    """``name#pN`` as struct(document, page); anything else is a document with no page."""
    page = F.regexp_extract(said, r"(?s)\A.*#[pP]([0-9]+)\z", 1)
    return F.struct(
        F.when(page != "", F.regexp_extract(said, r"(?s)\A(.*)#[pP][0-9]+\z", 1)).otherwise(said).alias("document"),
        F.when(page != "", page.cast("int")).alias("page"),
    )


def unwrap_pdf_lines(text: Column) -> Column:
    """Hard-wrapped lines joined to paragraphs where they don't end a sentence."""
    clean = F.regexp_replace(strip(text), r"[ \t]+\n", "\n")
    joined = F.regexp_replace(clean, r"(?<=[^.!?:\n])\n(?!\n)", " ")
    return F.regexp_replace(joined, r"\n(?!\n)", "\n\n")


def valid_collection(name: Column) -> Column:
    return name.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_-]{0,63}\z")


def judge_score(reply: Column) -> Column:
    """The score in a judge's reply, held between 0 and 1; null if it can't be read."""
    braces = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    value = F.when(braces != "", F.get_json_object(braces, "$.score").try_cast("double")).otherwise(strip(reply).try_cast("double"))
    return F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
