"""Format-preserving pseudonyms of personal data by keyed Feistel permutations.

Card numbers, phone numbers, IP addresses, IBANs, dates and the local parts of e-mail addresses are
found by one regular expression and validated. The digits (or letters and digits) of a valid one
are split into two halves, and eight rounds add a keyed hash of one half to the other, modulo the
number of values that half can take. That permutes the values of the format: equal values get equal
pseudonyms in every document, different ones stay different, and who has the key can go back.
Separators, lengths and check digits stay right, a date stays a date.

All work is DataFrame functions: a text is split at its matches and put together again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# Dates are permuted within FIRST_DAY and the 270 * 271 days that follow (to 2100).
FIRST_DAY, DATE_SPLIT = "1900-01-01", (271, 270)

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{2,}"
IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
PHONE = r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}"
US_PHONE = (r"(?:\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}"
            r"|[0-9]{3}\.[0-9]{3}\.[0-9]{4})")
PAIRS = (r"(?:\+[0-9]{1,3}[ .\-]?(?:\(0\) ?)?[0-9]{1,4}(?:[ .\-][0-9]{2}){3,5}"
         r"|0[0-9](?:[ .\-][0-9]{2}){4})")
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}"
CARD = r"[0-9](?:[ \-]?[0-9]){12,18}"
# A full stop before a match is the end of a number's part, unless it ends a word ("No.4111...").
_EDGE = r"(?<![A-Za-z0-9@+])(?<!(?:^|[^A-Za-z])\.)", r"(?![A-Za-z0-9@]|[.\-][0-9])"
PATTERN = (f"{_EDGE[0]}(?:{EMAIL}|{IP}|{PAIRS}|{PHONE}|{US_PHONE}|{DATE}|{IBAN}|{CARD})"
           f"{_EDGE[1]}")
# Written into a text behind the valid part of a match; _MARK of the text itself gets _OWN.
_MARK, _OWN, _CUT = "\uFDD0", "\uFDD1", "\uFDD2"


def _keyed(key: str, tweak: Column, turn: Column, value: Column) -> Column:
    """60 bits of a keyed hash as a long."""
    text = F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), value.cast("string"),
                       F.lit(key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, sizes: tuple[Column, Column], key: str, tweak: Column,
            back: bool = False) -> Column:
    """Permutes pairs (left < sizes[0], right < sizes[1]); struct(l, r). ``back`` undoes it."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    if back:
        turns = F.reverse(turns)
    sign = -1 if back else 1

    def step(state: Column, turn: Column) -> Column:
        on_left = turn % 2 == 0
        noise = _keyed(key, tweak, turn, F.when(on_left, state["r"]).otherwise(state["l"]))
        return F.struct(
            F.when(on_left, F.pmod(state["l"] + sign * (noise % sizes[0]), sizes[0]))
            .otherwise(state["l"]).alias("l"),
            F.when(on_left, state["r"])
            .otherwise(F.pmod(state["r"] + sign * (noise % sizes[1]), sizes[1])).alias("r"))

    return F.aggregate(turns, start, step)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _power(base: int, n: Column) -> Column:
    """base ** n as a long, for n up to 18 (base 10) or 12 (base 36)."""
    table = F.lit([base ** i for i in range(13 if base == 36 else 19)])
    return F.get(table, n)


def _string(digits: Column, base: int, key: str, tweak: str, back: bool) -> Column:
    """Permutes a string of digits in base 10 or 36 (lower case), keeping its length."""
    def halves(d: Column) -> Column:
        cut = F.floor(F.length(d) / 2).cast("int")
        left, right = F.substring(d, F.lit(1), cut), F.substring(d, cut + 1, F.length(d) - cut)
        long = [F.when(F.length(x) == 0, F.lit(0)).otherwise(F.conv(x, base, 10)).cast("long")
                for x in (left, right)]
        sizes = (_power(base, cut), _power(base, F.length(d) - cut))
        named = F.concat(F.lit(tweak), F.length(d).cast("string"))
        moved = feistel(*long, sizes, key, named, back)
        return _let(moved, lambda m: F.concat(
            F.lpad(F.when(cut == 0, F.lit("")).otherwise(F.lower(F.conv(m["l"], 10, base))),
                   cut, "0"),
            F.lpad(F.lower(F.conv(m["r"], 10, base)), F.length(d) - cut, "0")))

    # Halves of up to 18 digits or 12 letters fit a long; longer strings are permuted in pieces.
    most = 36 if base == 10 else 24
    pieces = F.regexp_extract_all(digits, F.lit(f".{{1,{most}}}"), F.lit(0))
    return F.array_join(F.transform(pieces, halves), "")


def _refill(form: Column, new: Column, char_class: str) -> Column:
    """``form`` with its characters of the class replaced, in order, by those of ``new``."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    at = F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), lambda s, c:
                     F.struct(
                         F.concat(s["out"], F.when(c.rlike(f"[{char_class}]"),
                                                   F.substring(new, s["i"], F.lit(1)))
                                  .otherwise(c)).alias("out"),
                         (s["i"] + F.when(c.rlike(f"[{char_class}]"), 1).otherwise(0)).alias("i")))
    return at["out"]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """Check digit that makes ``digits`` with it appended a valid card number."""
    values = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")),
                         lambda c, i: F.when(i % 2 == 0, 2 * c.cast("int")
                                             - F.when(c.cast("int") > 4, 9).otherwise(0))
                         .otherwise(c.cast("int")))
    total = F.aggregate(values, F.lit(0), lambda s, x: s + x)
    return ((10 - total % 10) % 10).cast("string")


def _mod97(text: Column) -> Column:
    """Remainder of a string of digits and capitals (A = 10) by 97."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda s, c: F.when(
        c.rlike("[0-9]"), (s * 10 + F.ascii(c) - 48) % 97).otherwise(
            (s * 100 + F.ascii(c) - 55) % 97))


# Every kind takes a match and gives its pseudonym, or null where the match isn't valid.


def _email(m: Column, key: str, back: bool) -> Column:
    local = F.substring_index(m, "@", 1)
    plain = F.lower(F.regexp_replace(local, "[^A-Za-z0-9]+", ""))
    new = _refill(local, _string(plain, 36, key, "email", back), "A-Za-z0-9")
    return F.concat(new, F.substring(m, F.length(local) + 1, F.length(m)))


def _ip(m: Column, key: str, back: bool) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
    plain = m.rlike(r"^(?:(?:0|[1-9][0-9]*)\.){3}(?:0|[1-9][0-9]*)$")
    valid = plain & (F.array_max(parts) <= 255)
    size = F.lit(65536)
    moved = feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], (size, size), key,
                    F.lit("ip"), back)
    out = _let(moved, lambda x: F.concat_ws(
        ".", *[v.cast("string") for h in ("l", "r")
               for v in (F.floor(x[h] / 256), x[h] % 256)]))
    return F.when(valid, out)


def _phone(m: Column, key: str, back: bool) -> Column:
    """The country code (what stands before the first separator) stays."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .\-(])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    n = F.length(_digits(m))
    return F.when((n >= 7) & (n <= 15), F.concat(code, _refill(
        rest, _string(_digits(rest), 10, key, "phone", back), "0-9")))


def _is_card(m: Column) -> Column:
    digits = _digits(m)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return _luhn(body) == F.substring(digits, -1, 1)


def _card(m: Column, key: str, back: bool) -> Column:
    digits = _digits(m)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    valid = _is_card(m)
    out = _let(_string(body, 10, key, "card", back), lambda b: F.concat(b, _luhn(b)))
    return F.when(valid, _refill(m, out, "0-9"))


def _is_iban(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    land, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    return (_mod97(F.concat(body, land, F.substring(plain, 3, 2))) == 1) & (
        F.length(plain).between(15, 34))


def _iban(m: Column, key: str, back: bool) -> Column:
    plain = F.regexp_replace(m, " ", "")
    land, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    valid = _is_iban(m)
    digits = _digits(body)

    def whole(b: Column) -> Column:
        check = F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(land, check, b)

    new = _refill(body, _string(digits, 10, key, "iban", back), "0-9")
    return F.when(valid, _refill(m, _let(new, whole), "A-Z0-9"))


def _month_first(day: Column, key: str, back: bool) -> Column:
    """Pseudonym of a date behind the 12th of a month, again one behind a 12th: it can't be read with
    the day first, so the way back knows it. A day that its month doesn't have is moved on."""
    def day_of(s: Column) -> Column:
        first = F.make_date((F.lit(1900) + F.floor(s["l"] / 12)).cast("int"),
                            (s["l"] % 12 + 1).cast("int"), F.lit(1))
        return _let(first, lambda d: F.when(s["r"] + 13 <= F.dayofmonth(F.last_day(d)),
                                            F.date_add(d, (s["r"] + 12).cast("int"))))

    def step(s: Column, _: Column) -> Column:
        return F.when((s["n"] > 0) & day_of(s).isNotNull(), s).otherwise(_let(
            feistel(s["l"], s["r"], (F.lit(2400), F.lit(19)), key, F.lit("month first"), back),
            lambda x: F.struct(x["l"].alias("l"), x["r"].alias("r"), (s["n"] + 1).alias("n"))))

    start = F.struct(((F.year(day) - 1900) * 12 + F.month(day) - 1).cast("long").alias("l"),
                     (F.dayofmonth(day) - 13).cast("long").alias("r"), F.lit(0).alias("n"))
    # Three in a hundred pairs are no day; twelve steps in a row don't end on one.
    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step), day_of)


def _date(m: Column, key: str, back: bool) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    mark = F.when(m.contains("."), ".").otherwise("/")
    parts = F.split(m, r"[./\-]")
    pad = [F.lpad(p, 2, "0") for p in (parts[0], parts[1])]
    text = F.when(iso, m).otherwise(F.concat_ws("-", parts[2], pad[1], pad[0]))
    day = F.try_to_date(text, "yyyy-MM-dd")
    other = F.when(~iso, F.try_to_date(F.concat_ws("-", parts[2], *pad), "yyyy-MM-dd"))
    index = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    a, b = DATE_SPLIT
    moved = feistel(F.floor(index / b), index % b, (F.lit(a), F.lit(b)), key, F.lit("date"), back)
    new = F.date_add(F.lit(FIRST_DAY).cast("date"),
                     _let(moved, lambda x: (x["l"] * b + x["r"]).cast("int")))

    def spelled(d: Column, *order: str) -> Column:
        return F.concat_ws("", F.date_format(d, order[0]), mark, F.date_format(d, order[1]), mark,
                           F.date_format(d, "yyyy"))

    out = F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(spelled(new, "dd", "MM"))
    month_first = _let(_month_first(other, key, back), lambda d: spelled(d, "MM", "dd"))
    return F.when(day.isNotNull() & index.between(0, a * b - 1), out).when(
        day.isNull() & F.year(other).between(1900, 2099), month_first)


# Later patterns stand back where an earlier one matches as well.
_KINDS = ((EMAIL, _email), (IP, _ip), (PAIRS, _phone), (PHONE, _phone), (US_PHONE, _phone), (DATE, _date),
          (IBAN, _iban), (CARD, _card))


def pseudonym(match: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one match of PATTERN; null if it isn't valid data of its kind."""
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(_KINDS):
        out = F.when(match.rlike(f"^(?:{pattern})$"), kind(match, key, back)).otherwise(out)
    return out


def _part(m: Column) -> Column:
    """The longest part of a match before a separator that is a card number or an IBAN where the
    whole match is neither; null if there is none."""
    def valid(p: Column) -> Column:
        return F.when(p.rlike(f"^(?:{IBAN})$"), _is_iban(p)).when(
            p.rlike(f"^(?:{CARD})$"), _is_card(p)).otherwise(F.lit(False))

    ends = F.filter(F.sequence(F.length(m) - 1, F.lit(1), F.lit(-1)),
                    lambda i: F.substring(m, i + 1, F.lit(1)).isin(" ", "-"))
    parts = F.filter(F.transform(ends, lambda i: F.substring(m, F.lit(1), i)), valid)
    return F.when(m.rlike(f"^(?:{IBAN}|{CARD})$") & ~m.rlike(f"^(?:{PAIRS}|{PHONE}|{US_PHONE})$")
                  & m.rlike("[ -]") & ~valid(m), F.get(parts, F.lit(0)))


def _cut(text: Column) -> Column:
    """``text`` with a mark behind the valid part of every match that goes on behind it, so that the
    part and what follows are found on their own; null where there is none."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    parts = F.transform(found, _part)
    filled = F.concat(F.zip_with(found, parts, lambda m, p: F.coalesce(F.concat(
        p, F.lit(_MARK + _CUT), F.substring(m, F.length(p) + 1, F.length(m))), m)),
        F.array(F.lit("")))
    between = F.split(text, PATTERN)
    whole = F.array_join(F.zip_with(between, filled, lambda a, b: F.concat(a, b)), "")
    return F.when(F.exists(parts, lambda p: p.isNotNull()), whole)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", back: bool = False,
                 found_col: str = "n_replaced") -> DataFrame:
    """``docs`` with personal data replaced in ``text_col`` and the number of replacements added.

    A card number or an IBAN that other digits or capitals follow ("4111 ... 1111 123") is replaced
    and these stay. There the way back is not always sure: with the pseudonym the whole may be valid
    by chance (a card number in about one of ten places where an odd number of digits follows).

    Nulls and texts without personal data stay as they are, and so do matches that are not valid
    (a card number with a wrong check digit, an address above 255, the 31st of June). ``back``
    with the same key restores the original values, but for capitals in e-mail addresses and
    leading zeros of days and months. A column that has the name ``found_col`` gives way to it.
    """
    own = F.replace(F.col(text_col), F.lit(_MARK), F.lit(_MARK + _OWN))
    rows = docs.withColumn("__cut", _cut(own))
    source = F.coalesce("__cut", F.col(text_col))
    rows = rows.withColumn("__m", F.regexp_extract_all(source, F.lit(PATTERN), F.lit(0)))
    rows = rows.withColumn("__p", F.when(F.size("__m") > 0, F.transform(
        "__m", lambda m: pseudonym(m, key, back))))
    between = F.split(source, PATTERN)
    filled = F.concat(F.zip_with("__p", "__m", lambda p, m: F.coalesce(p, m)),
                      F.array(F.lit("")))
    text = F.array_join(F.zip_with(between, filled, lambda a, b: F.concat(a, b)), "")
    text = F.when(F.col("__cut").isNull(), text).otherwise(F.replace(F.replace(
        text, F.lit(_MARK + _CUT), F.lit("")), F.lit(_MARK + _OWN), F.lit(_MARK)))
    count = F.size(F.filter("__p", lambda p: p.isNotNull()))
    return rows.select(
        *[F.when(F.col("__p").isNull(), F.col(c)).otherwise(text).alias(c) if c == text_col
          else F.col(c) for c in docs.columns if c != found_col],
        F.when(F.col("__p").isNull(), F.lit(0)).otherwise(count).cast("long").alias(found_col))
