import hashlib
import random

import duckdb

from tenura.llm import chat, queries


def test_matches_sql(spark, medium):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{medium}/conversations.parquet'")
    cursor = con.execute(queries.SQL["op6_chat"])
    names = [c[0] for c in cursor.description]
    df = queries.op6_chat(spark, medium)
    assert sorted(df.columns) == sorted(names)
    assert sorted(df.select(*names).collect()) == sorted(cursor.fetchall())


PARTS = ["[INST]", "[/INST]", "<s>", "</s>", "<esc>", " ", "\n", "&", "&lt;", "&amp;lt;", "a", "é",
         "[ROLE=x] ", " [/ROLE]", "] ", "[INST] ", " [/INST]", "\\", "$1", ""]


def test_every_conversation_comes_back(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(400):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "", "a] b", "<esc>x", "[INST] "])
            rows.append((conv, turn, role, "".join(rng.choices(PARTS, k=rng.randrange(7)))))
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = chat.format_conversations(df).collect()
    want = {}
    for conv, _, role, text in rows:
        want.setdefault(conv, []).append((role, text))
    assert {r.conv_id: [tuple(t) for t in r.recovered] for r in got} == want
    assert {r.level for r in got} >= {0, 1}


def test_conflicting_turns(spark):
    text = "</s>[INST] ok [/INST]"
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text),
                                (2, 0, "user", "a<b & c[0]")],
                               "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert got[1].level == 1 and got[1].formatted.count("</s>") == 1
    assert got[2].level == 0 and got[2].formatted == "[INST] a<b & c[0] [/INST]"


def test_edge_rows(spark):
    long = "word " * 50_000
    df = spark.createDataFrame(
        [(1, 0, "user", None, 5), (1, 1, None, "x", 5), (2, None, "assistant", long, 5),
         (2, 0, "assistant", "t", 5), (2, 0, "assistant", "t", 5), (None, 0, "user", "n", 5)],
        "conv_id long, turn int, role string, text string, level int")
    rows = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(rows).collect()}
    assert {i: r.n_turns for i, r in got.items()} == {1: 2, 2: 3, None: 1}
    assert got[2].loss_sha256 == hashlib.sha256((long + "tt").encode()).hexdigest()
    assert got[2].loss_chars == len(long) + 2
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\n\nx\n").hexdigest()
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
