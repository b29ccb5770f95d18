import random

import duckdb
import pytest

from tenura.llm import decontaminate, queries


def test_matches_sql(spark, medium):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{medium}/{name}.parquet'")
    want = con.execute(queries.SQL["op10_leaks"]).fetchall()
    got = [tuple(r) for r in queries.op10_leaks(spark, medium).collect()]
    assert sorted(got) == sorted(want) and len(got) > 5


@pytest.mark.parametrize("length", [20, 300, 5000, 60_000])
def test_planted_items_in_documents_of_any_length(spark, length):
    rng = random.Random(length)

    def text(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    items = [(i, " ".join(text(rng.choice([4, 5, 6, 8, 12, 40])))) for i in range(60)]
    rows, want = [], set()
    for i, item in items:
        words, own = text(length), item.split()
        if i % 3 == 0:
            at = rng.randrange(length)
            words[at:at] = own
            want.add((i, i))
        elif i % 3 == 1 and len(own) >= 40:  # two edited words at the ends
            words += ["x", *own[1:-1], "y"]
            want.add((i, i))
        rows.append((i, " ".join(words).title() + "!"))
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"),
                                spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_edge_rows(spark):
    item = "one two three four five six seven"
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "just two"),
                                   (None, item), (6, "never seen in any of the texts here")],
                                  "item_id long, text string")
    rows = [(1, f"x {item.upper()}, y", 0), (1, f"x {item.upper()}, y", 0), (2, None, 0),
            (3, "", 0), (4, "Just two.", 0), (5, "it has just two words", 0), (None, item, 0),
            (7, "pad " * 60_000 + item, 0), (8, "clean", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1), (4, 4), (5, 4), (7, 1)}
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 8]
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_short_items_are_found_inside_documents(spark):
    rng = random.Random(2)

    def text(n):
        return " ".join(f"w{rng.randrange(900)}" for _ in range(n))

    items = [(1, "alpha beta gamma delta"), (2, "Omega!"), (3, "one two three"), (4, "w1 never"),
             (5, "lambda mu"), (5, "nu xi omicron")]
    rows = [(1, f"{text(200)} alpha, beta gamma DELTA {text(200)}"), (2, f"{text(400)} omega"),
            (3, f"{text(50)} one two {text(50)} three"), (4, "one two three"),
            (5, f"{text(9)} one two three one two three omega omega"), (6, text(400)),
            (7, "lambda mu nu xi omicron"), (8, "lambda mu")]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"),
                              spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.shared) for r in got.collect()} == {
        (1, 1, 1), (2, 2, 1), (4, 3, 1), (5, 3, 1), (5, 2, 1), (7, 5, 2)}


def test_only_candidates_are_counted_and_none_is_lost(spark):
    """Every item that a document contains to 0.8 shares a signature shingle with it."""
    rng = random.Random(9)
    items = [(i, " ".join(f"t{rng.randrange(10**6)}" for _ in range(rng.randint(20, 30))))
             for i in range(400)]
    rows = []
    for i, item in items:
        words = item.split()
        words[0], words[-1] = "edited", "edited"
        pad = [f"p{rng.randrange(10**6)}" for _ in range(rng.choice([10, 300, 3000]))]
        rows.append((i, " ".join(pad + words)))
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"),
                              spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i, _ in items}
    assert all(r.shared == len(items[r.item_id][1].split()) - 6 for r in got)
