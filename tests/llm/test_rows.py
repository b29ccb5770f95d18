"""Stages of the pipeline decide per row, also where rows share an id or have none."""

import random

from tenura.llm import lines, quality, simhash


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
                    for _ in range(n))


def test_quality_keeps_good_rows_beside_bad_ones(spark):
    good = [prose(i) for i in range(3)]
    rows = [(None, good[0], "xx"), (None, "bad", "xx"), (7, good[1], "xx"), (7, None, "xx"),
            (8, good[2], None), (7, good[1], "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.keep_good(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(
        str(r) for r in docs.collect() if r.text in good)


def test_lines_go_from_their_own_row_only(spark):
    line, own, other = prose(1, 12), prose(2, 12), prose(3, 12)
    rows = [(1, line), (5, f"{line}\n{other}"), (5, own), (6, f"{own}\n{line}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text, r.lines_removed) for r in lines.dedup_lines(docs).collect()}
    assert got == {(1, line, 0), (5, other, 1), (5, own, 0), (6, "", 2)}


def test_a_line_twice_under_one_id_stays_once(spark):
    line = prose(1, 12)
    rows = [(5, f"{line}\n{prose(2, 12)}"), (5, f"{line}\n{prose(3, 12)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.dedup_lines(docs).collect()
    assert sorted(r.lines_removed for r in got) == [0, 1]


def test_every_group_keeps_one_row(spark):
    a, b, c, d = (prose(i, 80) for i in range(4))
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (9, b, 3), (5, b, 4), (None, c, 5), (None, c, 6),
            (None, a, 7), (None, d, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = simhash.one_per_group(docs)
    assert got.columns == docs.columns
    kept = {(r.doc_id, r.text) for r in got.collect()}
    assert got.count() == 4 and kept == {(1, a), (5, b), (None, c), (None, d)}
    same = spark.createDataFrame([(3, a, i) for i in range(50)], docs.schema)
    assert simhash.one_per_group(same).count() == 1
