import math
import re
from collections import Counter

import duckdb

from tenura.llm import quality, queries

SPACE = r"[\x20\x09-\x0D]+"


def brute(text):
    words = [w for w in re.split(SPACE, text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)),
            len(covered), failed)


def histograms(text):
    words = [w for w in re.split(SPACE, text) if w]
    common = Counter(w.lower() for w in words if w.lower() in quality.VOCABULARY)
    chars = Counter()
    for c in text:
        chars["upper" if "A" <= c <= "Z" else "lower" if "a" <= c <= "z"
              else "digit" if "0" <= c <= "9" else "space" if c in " \t\n\r\f\v"
              else "stop" if c in ".,;:!?'\"()-" else "symbol" if c in "#*$%&|<>"
              else "letter" if c.isalpha() else "other"] += 1
    return ([chars[n] for n in [*quality.CHAR_CLASSES, "lower"]],
            [*(common[w] for w in quality.VOCABULARY), len(words) - sum(common.values())])


def distance(p, q):
    def kl(a, b):
        return sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)

    return math.sqrt(max(0.0, (kl(p, q) + kl(q, p)) / 2))


def share(x):
    return [v / max(sum(x), 1) for v in x]


def brute_verdicts(docs):
    """docs: [(id, text, lang)] -> {id: (base, distances, kept)}."""
    limits = quality.Limits()
    base = {i: brute(t) for i, t, _ in docs}
    hist = {i: histograms(t) for i, t, _ in docs}
    kept = {i for i, b in base.items() if not b[5]}
    for _ in range(2):
        refs = {}
        for lang in {x for *_, x in docs}:
            own = [i for i, t, x in docs if x == lang and i in kept and len(t) >= 200
                   and base[i][0] >= 50]
            if own:
                refs[lang] = [[sum(c) / len(own) for c in
                               zip(*(share(hist[i][k]) for i in own), strict=True)]
                              for k in (0, 1)]
        far, kept = {}, set()
        for i, text, lang in docs:
            n, size = base[i][0], len(text)
            c = (distance(share(hist[i][0]), refs[lang][0])
                 if size >= 200 and lang in refs else None)
            w = distance(share(hist[i][1]), refs[lang][1]) if n >= 50 and lang in refs else None
            far[i] = (c, w)
            if (not base[i][5]
                    and (c or 0) <= limits.max_char_distance + limits.char_noise / size ** 0.5
                    and (w or 0) <= limits.max_word_distance + limits.word_noise / n ** 0.5):
                kept.add(i)
    return {i: (base[i], far[i], i in kept) for i in base}


def test_counts_and_verdicts_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op2_quality(spark, small).collect()}
    want = brute_verdicts([(d.doc_id, d.text, d.lang) for d in docs])
    assert set(got) == set(want)
    for i, (base, far, kept) in want.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == base
        for a, b in zip((r.char_distance, r.word_distance), far, strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6)
        assert r.kept == kept


def test_matches_sql(spark, medium):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{medium}/documents.parquet'")
    cursor = con.execute(queries.SQL["op2_quality"])
    names = [c[0] for c in cursor.description]
    df = queries.op2_quality(spark, medium)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=lambda r: r[0]) == sorted(
        cursor.fetchall())


def test_labelled_documents(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    rows = queries.op2_quality(spark, medium).join(labels, "doc_id").where("not base_failed")
    counts = {(r.quality, r.kept): r["count"] for r in
              rows.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.01 * counts[(1, True)]
    assert counts.get((0, True), 0) <= 0.15 * counts[(0, False)]


def test_edge_rows(spark):
    loop = "a b c d e f g h " * 2000
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "en", 1), (2, "", None, 1), (3, " \n\t", "xx", 1), (4, loop, "en", 1),
            (5, long, None, 1), (5, long, None, 1), (None, "x\nx\n\nx", "en", 1),
            (7, "é" * 30_000, "xx", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    got = quality.judge(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == [
        (None, 3, 2, 0, True), (1, 0, 0, 0, True), (2, 0, 0, 0, True), (3, 0, 0, 0, True),
        (4, 16000, 0, 16000, True), (5, 30000, 0, 0, False), (5, 30000, 0, 0, False),
        (7, 1, 0, 0, True)]
    assert quality.judge(docs.limit(0)).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [5, 5]
