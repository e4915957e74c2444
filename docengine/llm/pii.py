"""Format-preserving pseudonyms for personal data (DataFrame functions only).

Validated numbers and dates go through a keyed Feistel network over their own format: a card number that passes the
Luhn test becomes another one that does, an IPv4 address another address, a date another date between 1900 and 2099.
A permutation has no collisions, and equal values get equal pseudonyms, so documents stay linked. Values that fail
their validation (a number that only looks like a card) are left alone. E-mail addresses and secrets, which are no
numbers, get keyed hashes in their own alphabet.

One regular expression finds all kinds, so a text is cut once and put together again; texts without a digit or an @
skip it. Every repetition in the expression is bounded, so the time for a text is linear in its length.
"""

from __future__ import annotations

import secrets
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, named

#: The session's setting that holds the secret key. Who has it can undo the pseudonyms of numbers and dates.
KEY_SETTING = "spark.docengine.pseudonym.key"
ROUNDS = 10

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}"
SECRET = r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,80}|sk-[A-Za-z0-9_-]{20,120})(?![\p{L}\p{N}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
IPV4 = r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])"
DATE = r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\p{L}\p{N}/-]|\.[0-9])"
SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
#: Digits in one run, in groups of four (and three more), or 4-6-5 and 4-6-4. Other groups aren't a card's, and taking any digits in
#: reach would join a card with the number beside it.
CARD = r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![\p{L}\p{N}])"
PHONE = (
    r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?<sep>[ .-])[0-9]{1,4}(?:\k<sep>[0-9]{2,4}){1,4}|\+[0-9]{7,15}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}])"
)
ANY = "|".join((EMAIL, SECRET, IBAN, IPV4, DATE, SSN, PHONE, CARD))

#: 1900-01-01 to 2099-12-31 are 73,049 = 17 * 4,297 days.
FIRST_DAY, DAY_RADIX = "1900-01-01", (17, 4297)
#: Valid areas (1 to 899 without 666), groups and serials of a social security number.
AREAS, GROUP_SERIALS = 898, 99 * 9999


def session_key(spark: SparkSession) -> str:
    """The session's secret key. Where none is set, a new one that nobody keeps: values stay linked within one run then."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def _mac(key: str, *parts: Column) -> Column:
    """HMAC-SHA256 of the parts, as hex digits."""
    raw = key.encode("utf-8")
    block = (sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    said = F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, said), 256))), 256)


def _hash(key: str, *parts: Column) -> Column:
    """52 bits of a keyed hash."""
    return F.conv(F.substring(_mac(key, *parts), 1, 13), 16, 10).cast("long")


def feistel(kind: str, left: Column, right: Column, left_radix: Column, right_radix: Column, key: str) -> Column:
    """A keyed permutation of pairs (left, right) with left < left_radix and right < right_radix, as struct(l, r)."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        into_left = F.pmod(acc["l"] + _hash(key, F.lit(kind), i, acc["r"]), left_radix)
        into_right = F.pmod(acc["r"] + _hash(key, F.lit(kind), i, acc["l"]), right_radix)
        return F.when(i % 2 == 0, F.struct(into_left.alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), into_right.alias("r")))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits_permuted(digits: Column, kind: str, key: str) -> Column:
    """Another string of as many digits (2 to 26) for a string of digits."""

    def of(d: Column) -> Column:
        half = F.floor(F.length(d) / 2).cast("int")
        a, b = F.substring(d, F.lit(1), half), F.substring(d, half + 1, F.length(d) - half)
        # Powers of ten up to 10^13 are exact in a double.
        wide = lambda s: F.pow(F.lit(10.0), F.length(s)).cast("long")
        out = feistel(kind, a.cast("long"), b.cast("long"), wide(a), wide(b), key)
        return _let(out, lambda o: F.concat(F.lpad(o["l"].cast("string"), half, "0"), F.lpad(o["r"].cast("string"), F.length(d) - half, "0")))

    return _let(digits, of)


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _refilled(shape: Column, digits: Column, skip: Column | int = 0) -> Column:
    """``shape`` with its digits after the first ``skip`` characters replaced in turn by ``digits``."""
    head = F.substring(shape, F.lit(1), skip if isinstance(skip, Column) else F.lit(skip))
    rest = F.substring(shape, (skip if isinstance(skip, Column) else F.lit(skip)) + 1, F.length(shape))

    def one(c: Column, i: Column) -> Column:
        before = F.length(_only_digits(F.substring(rest, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, before + 1, F.lit(1))).otherwise(c)

    return F.concat(head, F.concat_ws("", F.transform(F.split(rest, ""), one)))


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of all digits, the last one counted singly."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _first_valid(m: Column, heads: list[Column], valid, replaced) -> Column:
    """``m`` with the first of its ``heads`` that is valid replaced. A last group that was taken along stays as it is."""

    def of(head: Column) -> Column:
        return F.when(head.isNull(), m).otherwise(F.concat(replaced(head), F.substring(m, F.length(head) + 1, F.length(m))))

    return _let(F.get(F.filter(F.array(*heads), valid), 0), of)


def _card(m: Column, key: str) -> Column:
    """A card number, or its first four groups where the three digits after them are another number."""

    def valid(head: Column) -> Column:
        return _let(_only_digits(head), lambda d: (_luhn_sum(d) % 10 == 0) & ~d.rlike("^0+$") & (F.length(d) >= 13))

    def replaced(head: Column) -> Column:
        def of(d: Column) -> Column:
            body = _digits_permuted(F.substring(d, F.lit(1), F.length(d) - 1), "card", key)
            whole = _let(body, lambda b: F.concat(b, F.pmod(10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))
            return _let(whole, lambda w: _refilled(head, w))

        return _let(_only_digits(head), of)

    return _first_valid(m, [m, F.regexp_replace(m, "[ -][0-9]{3}$", "")], valid, replaced)


def _ip(m: Column, key: str) -> Column:
    def of(p: Column) -> Column:
        octet = lambda i: F.get(p, i).cast("long")
        out = feistel("ip", octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), key)
        text = lambda o: F.concat_ws(".", *[x.cast("string") for x in (F.floor(o["l"] / 256), o["l"] % 256, F.floor(o["r"] / 256), o["r"] % 256)])
        return F.when(F.forall(p, lambda x: x.cast("int") < 256), _let(out, text)).otherwise(m)

    return _let(F.split(m, r"\."), of)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - F.when(area > 666, 2).otherwise(1)
    out = feistel("ssn", rank, (group - 1) * 9999 + serial - 1, F.lit(AREAS), F.lit(GROUP_SERIALS), key)

    def text(o: Column) -> Column:
        a = o["l"] + F.when(o["l"] >= 665, 2).otherwise(1)
        pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
        return F.concat_ws("-", pad(a, 3), pad(F.floor(o["r"] / 9999) + 1, 2), pad(o["r"] % 9999 + 1, 4))

    return F.when(valid, _let(out, text)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso = F.when(m.rlike("^[0-9]{4}-"), m)
    day_first = F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))
    month_first = F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))
    date = lambda s: F.try_to_date(s, "yyyy-MM-dd")
    by_day, by_month = date(day_first), F.when(m.contains("/"), date(month_first))
    found = F.when(iso.isNotNull(), date(iso)).otherwise(F.coalesce(by_day, by_month))
    form = F.when(iso.isNotNull(), 0).when(m.contains("."), 1).when(by_day.isNotNull(), 2).otherwise(3)

    def of(d: Column) -> Column:
        n = F.datediff(d, F.lit(FIRST_DAY).cast("date")).cast("long")
        out = feistel("date", F.floor(n / DAY_RADIX[1]), n % DAY_RADIX[1], F.lit(DAY_RADIX[0]), F.lit(DAY_RADIX[1]), key)
        new = _let(out, lambda o: F.date_add(F.lit(FIRST_DAY).cast("date"), (o["l"] * DAY_RADIX[1] + o["r"]).cast("int")))

        def text(x: Column) -> Column:
            s = x.cast("string")
            y, mo, dd = F.substring(s, 1, 4), F.substring(s, 6, 2), F.substring(s, 9, 2)
            return F.when(form == 0, s).when(form == 1, F.concat_ws(".", dd, mo, y)).when(form == 2, F.concat_ws("/", dd, mo, y)).otherwise(F.concat_ws("/", mo, dd, y))

        return F.when(d.between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")), _let(new, text)).otherwise(m)

    return _let(found, of)


def _phone(m: Column, key: str) -> Column:
    """The country code stays; a number of fewer than 7 or more than 15 digits isn't one."""
    code = F.length(F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0))

    def of(d: Column) -> Column:
        new = _let(_digits_permuted(d, "phone", key), lambda p: _refilled(m, p, code))
        return F.when(F.length(d).between(7, 15), new).otherwise(m)

    return _let(_only_digits(F.substring(m, code + 1, F.length(m))), of)


def _mod97(rearranged: Column) -> Column:
    def add(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + letter) % 97)

    return F.aggregate(F.split(rearranged, ""), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    """An account number; capital letters or digits in one or two groups behind it may be other words."""

    def packed(head: Column) -> Column:
        return F.regexp_replace(head, " ", "")

    def valid(head: Column) -> Column:
        return _let(packed(head), lambda s: F.length(s).between(15, 34) & (_mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1))

    def replaced(head: Column) -> Column:
        def of(s: Column) -> Column:
            country, body = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
            d = _only_digits(body)
            new_body = F.when(F.length(d).between(2, 26), _let(_digits_permuted(d, "iban", key), lambda p: _refilled(body, p))).otherwise(body)

            def whole(b: Column) -> Column:
                check = F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
                plain = F.concat(country, check, b)
                return F.when(head.contains(" "), F.rtrim(F.regexp_replace(plain, "(.{4})", "$1 "))).otherwise(plain)

            return _let(new_body, whole)

        return _let(packed(head), of)

    return _first_valid(m, [m, *[F.regexp_replace(m, "(?: [A-Z0-9]{1,4}){%d}$" % n, "") for n in (1, 2)]], valid, replaced)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(_mac(key, F.lit("email"), F.lower(m)), 1, 16), F.lit("@example.invalid"))


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, "^(AKIA|ASIA|gh[pousr]_|sk-)", 1)
    digest = lambda i: _mac(key, F.lit("secret"), F.lit(i), m)
    body = F.substring(F.concat(digest(0), digest(1)), F.lit(1), F.length(m) - F.length(head))
    return F.concat(head, F.when(m == F.upper(m), F.upper(body)).otherwise(body))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of ``ANY``; the match itself where it isn't valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(whole(SECRET), _secret(m, key))
        .when(whole(IBAN), _iban(m, key))
        .when(whole(IPV4), _ip(m, key))
        .when(whole(DATE), _date(m, key))
        .when(whole(SSN), _ssn(m, key))
        .when(whole(PHONE), _phone(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymised(docs: DataFrame, text: str = "text", key: str | None = None, count: str | None = None) -> DataFrame:
    """``docs`` with ``text`` replaced and, where ``count`` names a column, the number of values replaced in it.

    The key is the session's if none is given. Null texts stay null and count 0; empty ones stay empty. Other columns and
    the order of values are kept, whatever the columns' names; repeated rows get the same text. An empty table stays empty.
    """
    key = key or session_key(docs.sparkSession)
    found_name, new_name, count_name = fresh(docs.columns, "found", "new", "count")
    whole, found, new = named(text), F.col(found_name), F.col(new_name)
    # Columns under lambdas are computed for each element: what an element needs is laid out before.
    laid = docs.withColumn(found_name, F.when(whole.rlike("[0-9@]"), F.regexp_extract_all(whole, F.lit(ANY), F.lit(0))))
    done = laid.withColumn(new_name, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key))))
    between = F.split(whole, ANY, -1)
    joined = F.concat_ws("", F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    columns = [F.when(new.isNotNull(), joined).otherwise(whole).alias(c) if c == text else named(c) for c in docs.columns]
    counted = F.when(new.isNull(), 0).otherwise(changed).cast("long")
    return done.select(*columns, *([counted.alias(count)] if count else []))
