"""The whole replacement against Feistel rounds, validity rules and formats in plain Python."""

import calendar
import datetime
import hashlib

import regex

from tenura.llm import pii
from test_pii import INSIDE, INVALID, VALID

KEY = "another key"
ALNUM = "0123456789abcdefghijklmnopqrstuvwxyz"
EPOCH = datetime.date(1900, 1, 1)


def feistel(left, right, a, b, tweak):
    for turn in range(8):
        value = right if turn % 2 == 0 else left
        text = f"{KEY}|{tweak}|{turn}|{value}|{KEY}"
        noise = int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)
        if turn % 2 == 0:
            left = (left + noise) % a
        else:
            right = (right + noise) % b
    return left, right


def spell(n, base, size):
    out = ""
    for _ in range(size):
        n, digit = divmod(n, base)
        out = ALNUM[digit] + out
    return out


def string(text, base, tweak):
    most, out = (36 if base == 10 else 24), ""
    for start in range(0, len(text), most):
        piece = text[start:start + most]
        cut = len(piece) // 2
        left, right = int(piece[:cut] or "0", base), int(piece[cut:], base)
        left, right = feistel(left, right, base ** cut, base ** (len(piece) - cut),
                              f"{tweak}{len(piece)}")
        out += spell(left, base, cut) + spell(right, base, len(piece) - cut)
    return out


def refill(form, new, chars):
    left = iter(new)
    return "".join(next(left) if regex.match(f"[{chars}]", c) else c for c in form)


def digits(text):
    return regex.sub("[^0-9]", "", text)


def luhn_digit(body):
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def email(m):
    local, at, rest = m.partition("@")
    plain = regex.sub("[^a-z0-9]", "", local.lower())
    return refill(local, string(plain, 36, "email"), "A-Za-z0-9") + at + rest


def ip(m):
    parts = m.split(".")
    if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
        return None
    a, b, c, d = map(int, parts)
    left, right = feistel(a * 256 + b, c * 256 + d, 65536, 65536, "ip")
    return ".".join(map(str, (*divmod(left, 256), *divmod(right, 256))))


def phone(m):
    if not 7 <= len(digits(m)) <= 15:
        return None
    code = regex.match(r"\+[0-9]{1,3}(?=[ .\-(])", m)
    cut = code.end() if code else 0
    return m[:cut] + refill(m[cut:], string(digits(m[cut:]), 10, "phone"), "0-9")


def is_card(m):
    return luhn_digit(digits(m)[:-1]) == digits(m)[-1]


def card(m):
    body = string(digits(m)[:-1], 10, "card")
    return refill(m, body + luhn_digit(body), "0-9") if is_card(m) else None


def is_iban(m):
    plain = m.replace(" ", "")
    return 15 <= len(plain) <= 34 and mod97(plain[4:] + plain[:4]) == 1


def iban(m):
    if not is_iban(m):
        return None
    plain = m.replace(" ", "")
    body = refill(plain[4:], string(digits(plain[4:]), 10, "iban"), "0-9")
    return refill(m, f"{plain[:2]}{98 - mod97(body + plain[:2] + '00'):02d}{body}", "A-Z0-9")


def day_of(year, month, day):
    try:
        return datetime.date(int(year), int(month), int(day))
    except ValueError:
        return None


def date(m):
    iso = m[4] == "-" and m[:4].isdigit()
    mark = "." if "." in m else "/"
    a, b, c = regex.split(r"[./-]", m)
    day = day_of(a, b, c) if iso else day_of(c, b, a)
    if day is not None:
        index = (day - EPOCH).days
        if not 0 <= index < 271 * 270:
            return None
        left, right = feistel(*divmod(index, 270), 271, 270, "date")
        new = EPOCH + datetime.timedelta(left * 270 + right)
        return f"{new:%Y-%m-%d}" if iso else f"{new:%d}{mark}{new:%m}{mark}{new.year}"
    day = None if iso else day_of(c, a, b)
    if day is None or not 1900 <= day.year <= 2099:
        return None
    left, right = (day.year - 1900) * 12 + day.month - 1, day.day - 13
    while True:
        left, right = feistel(left, right, 2400, 19, "month first")
        year, month = 1900 + left // 12, left % 12 + 1
        if right + 13 <= calendar.monthrange(year, month)[1]:
            return f"{month:02d}{mark}{right + 13:02d}{mark}{year}"


def full(pattern, m):
    return regex.fullmatch(pattern, m) is not None


def pseudonym(m):
    for pattern, kind in ((pii.EMAIL, email), (pii.IP, ip), (pii.PAIRS, phone), (pii.PHONE, phone),
                          (pii.US_PHONE, phone), (pii.DATE, date), (pii.IBAN, iban),
                          (pii.CARD, card)):
        if full(pattern, m):
            return kind(m)
    return None


def valid_number(m):
    if full(pii.IBAN, m):
        return is_iban(m)
    return full(pii.CARD, m) and is_card(m)


def valid_part(m):
    """The longest part before a separator that is a number where the whole is none."""
    if not full(f"{pii.IBAN}|{pii.CARD}", m) or valid_number(m):
        return None
    if full(f"{pii.PAIRS}|{pii.PHONE}|{pii.US_PHONE}", m):
        return None
    ends = [i for i in range(len(m) - 1, 0, -1) if m[i] in " -"]
    return next((m[:i] for i in ends if valid_number(m[:i])), None)


def replaced(text):
    if text is None:
        return None, 0
    n = 0

    def cut(match):
        part = valid_part(match.group())
        return match.group() if part is None else part + "\x00" + match.group()[len(part):]

    def put(match):
        nonlocal n
        new = pseudonym(match.group())
        n += new is not None
        return match.group() if new is None else new

    marked = regex.sub(pii.PATTERN, cut, text)
    return regex.sub(pii.PATTERN, put, marked).replace("\x00", ""), n


def compare(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.text, r.n_replaced) for r in pii.pseudonymize(rows, KEY).collect()}
    changed = 0
    for i, text in enumerate(texts):
        expected = replaced(text)
        assert got[i] == expected, text
        changed += expected[1]
    return changed


def test_formats(spark):
    dates = [f"{d:%Y-%m-%d} {d:%d.%m.%Y} {d:%m/%d/%Y}" for d in (
        EPOCH + datetime.timedelta(1237 * i) for i in range(58))]
    texts = [*VALID, *INVALID, *[t for t, _ in INSIDE], *dates, None, "", " | ".join(VALID),
             "a_b.C-d%e+f@x.org", "x" * 90 + "1@example.org"]
    assert compare(spark, texts) > 200


def test_documents(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    assert compare(spark, texts) > 20
