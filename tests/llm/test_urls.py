import duckdb
import pytest

from tenura.llm import queries, urls


def test_matches_sql(spark, medium):
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{medium}/{name}.parquet'")
    cursor = con.execute(queries.SQL["op4_urls"])
    names = [c[0] for c in cursor.description]
    df = queries.op4_urls(spark, medium)
    assert sorted(df.columns) == sorted(names)
    got = sorted(df.select(*names).collect())
    assert got == sorted(cursor.fetchall())
    assert {"allow", "block"} == {r.verdict for r in got}


@pytest.mark.parametrize("url,want", [
    ("https://A.Example.COM/x?y#z", ("a.example.com", "/x")),
    ("http://h", ("h", "")), ("x://h?q/z", ("h", "")), ("x://h#f", ("h", "")),
    ("://h/a://b", ("h", "/a://b")), ("no scheme", ("", "")), (None, ("", "")), ("", ("", "")),
    ("http://É.org/p\nq?", ("É.org", "/p\nq")), ("http:///p", ("", "/p"))])
def test_parts(spark, url, want):
    host, path = urls.parts(urls.F.col("u"))
    row = spark.createDataFrame([(url,)], "u string").select(host, path).first()
    assert tuple(row) == want


@pytest.mark.parametrize("host,want", [
    ("www.a.co.uk", ("a.co.uk", "co.uk")), ("a.co.uk:80", ("a.co.uk", "co.uk")),
    ("co.uk", ("co.uk", "co.uk")), ("x.y.example.com", ("example.com", "com")),
    ("example.com", ("example.com", "com")), ("localhost", ("localhost", "localhost")),
    ("", ("", "")), ("10.1.2.3", ("10.1.2.3", "(address)")),
    ("10.1.2.3:8080", ("10.1.2.3", "(address)")), ("[2001:db8::1]:80", ("[2001:db8::1]", "(address)")),
    ("1.2.3.com", ("3.com", "com")), ("b.a.city.kawasaki.jp", ("kawasaki.jp", "jp"))])
def test_registered_domains(spark, host, want):
    domain, suffix = urls.levels(urls.F.col("h"))
    assert tuple(spark.createDataFrame([(host,)], "h string").select(domain, suffix).first()) == want


def test_given_suffixes(spark):
    domain, suffix = urls.levels(urls.F.col("h"), ["a.b.jp", "b.jp"])
    df = spark.createDataFrame([("y.x.a.b.jp",), ("y.x.b.jp",), ("x.co.uk",)], "h string")
    assert [tuple(r) for r in df.select(domain, suffix).collect()] == [
        ("x.a.b.jp", "a.b.jp"), ("x.b.jp", "b.jp"), ("co.uk", "uk")]
    domain, suffix = urls.levels(urls.F.col("h"), [])
    assert tuple(df.select(domain, suffix).collect()[2]) == ("co.uk", "uk")


def test_sites_under_a_public_suffix_are_apart(spark, tmp_path):
    """One bad site under co.uk does not take another's pages with it; addresses stand alone."""
    rows, labels = [], []
    for host, outcome, n in [("a.bad.co.uk", 0, 40), ("b.bad.co.uk", 0, 40), ("good.co.uk", 1, 40),
                             ("10.0.0.1", 0, 40), ("10.9.0.1", 1, 40), ("fine.org", 1, 40)]:
        for _ in range(n):
            rows.append((len(rows), f"https://{host}/p"))
            labels.append((len(labels), outcome, 1 - outcome))
    rows += [(len(rows), "https://new.bad.co.uk/"), (len(rows) + 1, "http://[::1\n]/"),
             (len(rows) + 2, "https://" + "long." * 20000 + "org/" + "x" * 100_000)]
    rows += rows[:1] + rows[-1:]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    marks = spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int")
    good = marks.select("doc_id", ((urls.F.col("quality") == 1) & (urls.F.col("toxic") == 0))
                        .cast("int").alias("good"))
    out = urls.judge(pages, good, [])
    got = {(r.host, r.verdict) for r in out.collect() if len(r.host) < 100}
    assert {h for h, v in got if v == "block"} == {
        "a.bad.co.uk", "b.bad.co.uk", "new.bad.co.uk", "10.0.0.1"}
    assert out.count() == len(rows)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    cursor = con.execute(queries.SQL["op4_urls"])
    names = [c[0] for c in cursor.description]
    ours = queries.op4_urls(spark, str(tmp_path)).select(*names).distinct().collect()
    assert sorted(map(tuple, ours)) == sorted(set(cursor.fetchall()))


def test_reputation_of_hosts(spark):
    rows, labels = [], []

    def pages(host, good, bad, unknown=0):
        for outcome in [1] * good + [0] * bad + [None] * unknown:
            rows.append((len(rows), f"http://{host}/", 7))
            if outcome is not None:
                labels.append((len(rows) - 1, outcome))

    for i in range(20):
        pages(f"www.fine{i}.net", 40, 2, 5)
        pages(f"farm{i}.bad.biz", 1, 30, 5)
    pages("new.bad.biz", 0, 0, 3)
    pages("once.fine.net", 0, 1)
    df = spark.createDataFrame(rows + [(None, None, 7)], "page_id long, url string, host int")
    found = urls.judge(df, spark.createDataFrame(labels, "id long, good int"), [])
    got = {(r.host, r.verdict) for r in found.collect()}
    assert {v for h, v in got if h.endswith("bad.biz")} == {"block"}
    assert {v for h, v in got if h.endswith(".net")} == {"allow"}
    assert ("", "allow") in got and len({h for h, _ in got}) == len(got)
    assert urls.judge(df.limit(0), spark.createDataFrame(labels, "id long, good int"), []).count() == 0
    none = spark.createDataFrame([], "id long, good int")
    assert {r.verdict for r in urls.judge(df, none, queries.URL_RULES).collect()} == {"allow"}


def test_longest_rule_wins(spark):
    cases = {"http://example.org/es/1": ("example.org/es/", "block"),
             "http://x.example.org/en/12": ("example.org/en/1", "block"),
             "http://x.example.org/en/2": ("org/", "allow"),
             "http://badexample.org/es/": ("org/", "allow"),
             "http://org": (None, None), "http://a.com/fr/": ("com/fr/", "allow"),
             "http://com/de/x": ("com/de/", "block"), "http://a.com/en/": (None, None)}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    host, path = urls.parts(urls.F.col("u"))
    rule, verdict = urls.first_rule(host, path, queries.URL_RULES)
    assert {r[0]: (r[1], r[2]) for r in df.select("u", rule, verdict).collect()} == cases
