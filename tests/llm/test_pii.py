import datetime
import itertools
import re

import pytest

from tenura.llm import pii, queries
from pyspark.sql import functions as F

KEY = "test key"


def run(spark, texts, back=False, key=KEY):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = pii.pseudonymize(rows, key, back=back).orderBy("doc_id").collect()
    return [(r.text, r.n_replaced) for r in found]


def luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(digits[::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0


VALID = ["jo.doe7@mail9.example.com", "129.38.82.176", "+1 (017) 555-7713", "(017) 555-7713",
         "4111 1111 1111 1111", "4111111111111111", "2024-02-29", "31.12.1999", "01/02/2003",
         "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "+49 171 234 5678",
         "378282246310005"]
INVALID = ["4111111111111112", "256.1.1.1", "2023-02-29", "31.06.2001", "4.0", "555-7713",
           "GB83 WEST 1234 5698 7654 32", "a@b", "12345678", "01.2.3.4", "1899-12-31",
           "v1.2.3.4.5"]


def test_formats_stay_valid_and_values_go_back(spark):
    got = [t for t, _ in run(spark, VALID)]
    for old, new in zip(VALID, got, strict=True):
        assert old != new
        if old == VALID[1]:  # an address stays one, its numbers may have fewer digits
            continue
        assert re.sub("[0-9a-z]", "0", old) == re.sub("[0-9a-z]", "0", new)
    assert all(luhn(got[i]) for i in (4, 5, 12)) and got[4].replace(" ", "") == got[5]
    assert all(0 <= int(x) <= 255 for x in got[1].split("."))
    assert got[0].endswith("@mail9.example.com") and got[2].startswith("+1 (")
    datetime.date.fromisoformat(got[6])
    for iban in (got[9], got[10]):
        plain = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert [t for t, _ in run(spark, got, back=True)] == VALID
    assert [t for t, _ in run(spark, VALID, key="other")] != got


def test_invalid_data_stays(spark):
    assert run(spark, INVALID) == [(t, 0) for t in INVALID]


def test_texts_around_and_links_between_documents(spark):
    texts = [f"Call +1 (017) 555-7713, or mail a.b@c.org!! {VALID[1]}###", VALID[1],
             f"({VALID[1]}) | {VALID[1]}", "Nothing here.\n", None, "", "x" * 200_000 + " " + VALID[1]]
    got = run(spark, texts)
    ip = got[1][0]
    assert [n for _, n in got] == [3, 1, 2, 0, 0, 0, 1]
    assert got[2][0] == f"({ip}) | {ip}" and got[0][0].endswith(f"!! {ip}###")
    assert [t for t, _ in got[3:6]] == texts[3:6] and got[6][0] == "x" * 200_000 + " " + ip


@pytest.mark.parametrize("a,b", [(7, 11), (1, 10), (10, 10)])
def test_permutation(spark, a, b):
    pairs = list(itertools.product(range(a), range(b)))
    rows = spark.createDataFrame(pairs, "x long, y long")
    size = (F.lit(a), F.lit(b))
    moved = rows.withColumn("m", pii.feistel(F.col("x"), F.col("y"), size, KEY, F.lit("t")))
    there = moved.withColumn("n", pii.feistel(F.col("m.l"), F.col("m.r"), size, KEY, F.lit("t"),
                                              back=True)).collect()
    assert sorted((r.m.l, r.m.r) for r in there) == pairs
    assert all((r.n.l, r.n.r) == (r.x, r.y) for r in there)


def test_documents(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op3_pii(spark, small).collect()}
    assert set(got) == set(docs)
    mail = re.compile(r"\S+@\S+\.com")
    card = re.compile(r"(?<![\w.+@])\d{16}(?![\w@])")
    seen = {}
    for i, text in docs.items():
        old, new = text, got[i].text
        valid = [m for m in card.findall(old) if luhn(m)]
        assert not set(valid + mail.findall(old)) & set(card.findall(new) + mail.findall(new))
        for a, b in zip(mail.findall(old), mail.findall(new), strict=True):
            assert seen.setdefault(a, b) == b
        if not re.search(r"\d", old):
            assert old == new and got[i].n_replaced == 0
    assert seen


def test_edge_rows(spark):
    rows = spark.createDataFrame([(1, VALID[1], 3), (1, VALID[1], 3), (None, None, None)],
                                 "doc_id long, text string, m int")
    again = pii.pseudonymize(rows, KEY, found_col="m")
    assert again.columns == ["doc_id", "text", "m"] and [r.m for r in again.collect()] == [1, 1, 0]
    got = pii.pseudonymize(rows, KEY)
    assert got.columns == ["doc_id", "text", "m", "n_replaced"] and got.count() == 3
    assert pii.pseudonymize(rows.limit(0), KEY).count() == 0


CARD_NO, IBAN_NO = "4111 1111 1111 1111", "BE68 5390 0754 7034"
INSIDE = [(f"{CARD_NO} 123", CARD_NO), ("4111111111111111 12/27", "4111111111111111"),
          ("4111-1111-1111-1111 7", "4111-1111-1111-1111"), (f"{IBAN_NO} EUR 500", IBAN_NO),
          ("BE68539007547034 EUR 500", "BE68539007547034"), (f"{IBAN_NO} PAID INTO", IBAN_NO),
          ("No.4111111111111111", "4111111111111111"), ("12/25/2020", "12/25/2020"),
          ("due 2.29.2024!", "2.29.2024"), ("+33 1 23 45 67 89", "1 23 45 67 89"),
          ("01 23 45 67 89", "01 23 45 67 89"), ("212-555-0123", "212-555-0123"),
          ("﷐﷒ 4111111111111111 12", "4111111111111111")]


def test_valid_data_before_and_behind_other_characters(spark):
    got = run(spark, [t for t, _ in INSIDE])
    alone = dict(run(spark, [CARD_NO, IBAN_NO, "4111111111111111"]))
    for (old, value), (new, n) in zip(INSIDE, got, strict=True):
        begin, end = old.split(value)
        assert n == 1 and value not in new, old
        assert new.startswith(begin) and new.endswith(end), (old, new)
        part = new[len(begin):len(new) - len(end)]
        if "." not in value:
            assert re.sub("[0-9]", "0", part) == re.sub("[0-9]", "0", value)
        if value in (CARD_NO, IBAN_NO, "4111111111111111"):
            assert part in alone
    (new, n), = run(spark, [f"4111111111111111 12/05/2020 and {IBAN_NO} EUR 500"])
    assert n == 3 and "12/05/2020" not in new and new.endswith(" EUR 500")


def test_month_first_dates_go_back(spark):
    days = [datetime.date(1900, 1, 13) + datetime.timedelta(97 * i) for i in range(750)]
    texts = [f"{d:%m/%d/%Y}" for d in days if d.day > 12]
    got = [t for t, n in run(spark, texts) if n == 1]
    assert len(set(got)) == len(texts) > 400
    assert all(datetime.datetime.strptime(t, "%m/%d/%Y").day > 12 for t in got)
    assert [t for t, _ in run(spark, got, back=True)] == texts
