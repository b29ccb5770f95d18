import random
import re
import zlib

import pytest

from tenura.llm import spelling


def brute_counts(rows):
    counts = {}
    for i, text in rows:
        text = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for word in re.findall("[a-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1:]
            counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_near(words):
    near, holes = {w: set() for w in words}, {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1:]), set()).add(w)
    for w in words:
        for k in range(len(w)):
            near[w] |= holes[w[:k], w[k + 1:]] - {w}
            shorter = w[:k] + w[k + 1:]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    return near


def brute_variants(words):
    near, forms, out = brute_near(words), {}, {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * n:
            forms[w] = best
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        out[w] = (form, root, n, len(near[w]), words[form] if form else None)
    return out


def collected(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def test_documents_match_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    words = brute_counts([(r.doc_id, r.text) for r in docs.collect()])
    counted = spelling.word_counts(docs)
    assert {r.word: r.n for r in counted.collect()} == words
    want = brute_variants(words)
    assert collected(spelling.variants(counted)) == want
    assert sum(v[0] is not None for v in want.values()) > 10


@pytest.mark.parametrize("tile, pieces", [(1, 3), (2, 2), (7, 4), (512, 3), (512, 1)])
def test_every_tile_size_finds_all_near_words(spark, tile, pieces):
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(3, 9))): rng.choice((2, 2, 30, 900))
             for _ in range(250)}
    rows = spark.createDataFrame(sorted(words.items()), "word string, n long")
    assert collected(spelling.variants(rows, tile=tile, pieces=pieces)) == brute_variants(words)


def test_chains_ties_and_code_points(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "mmmmmmm": 3,
             "mmmmmmz": 40, "mmmmmmb": 40, "éééàéé": 5, "éééàééé": 50, "😀bcdefgh": 2,
             "😀bcdefg": 70, "alone": 9, "ab": 2, "a": 40, "b": 40}
    got = collected(spelling.variants(spark.createDataFrame(sorted(words.items()),
                                                            "word string, n long")))
    assert got == brute_variants(words)
    assert got["aaaaaaa"][:2] == ("aaaaaab", "aaaabbb")
    assert got["mmmmmmm"][0] == "mmmmmmb" and got["ab"][0] == "a"


def test_a_planted_copy_with_every_kind_of_edit(spark):
    base = "straordinario"
    edits = {base[:k] + base[k + 1:] for k in range(len(base))}
    edits |= {base[:k] + "q" + base[k:] for k in range(len(base) + 1)}
    edits |= {base[:k] + "w" + base[k + 1:] for k in range(len(base))}
    far = {base[:-2], base + "qq", "xx" + base[2:]}
    rows = [(w, 2) for w in sorted(edits | far)] + [(base, 1000)]
    got = collected(spelling.variants(spark.createDataFrame(rows, "word string, n long")))
    assert {w for w, v in got.items() if v[0] == base} == edits
    assert got[base][3] == len(edits)


def test_edge_rows(spark):
    long_word = "x" * 30_000
    rows = [(1, "Wandern wandern WANDERN kurz", 1), (None, "wandern " * 3, 2), (None, None, 3),
            (3, "", 4), (3, "wanderns wanderns", 5), (1, "Wandern wandern WANDERN kurz", 1),
            (4, f"{long_word} {long_word}y {long_word} {long_word}y", 6), (5, "1234567 Ä×÷ßÄÄÄ", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    words = brute_counts([(i, t) for i, t, _ in rows])
    counted = spelling.word_counts(docs)
    assert {r.word: r.n for r in counted.collect()} == words
    assert long_word in words
    assert collected(spelling.variants(counted)) == brute_variants(words)
    empty = spelling.variants(spelling.word_counts(docs.limit(0)))
    assert empty.count() == 0 and len(empty.columns) == 6


def test_a_third_of_all_words_in_one_group_is_split_into_tiles(spark):
    words = [("gleichanfang" + "".join(p), 2) for p in
             zip(*[random.Random(s).choices("abcdefgh", k=700) for s in range(4)])]
    words = sorted(set(words))
    dealt = spelling._dealt(spark.createDataFrame(words, "word string, n long"), 3)
    tiled = spelling._tiled(dealt, 64)
    sizes = tiled.groupBy("m", "piece", "around", "x", "y").count().agg({"count": "max"}).first()[0]
    assert sizes < 4 * 64
    got = {r.word: r.n_near for r in spelling.near_words(
        spark.createDataFrame(words, "word string, n long"), tile=64).collect()}
    want = brute_near({w for w, _ in words})
    assert got == {w: len(v) for w, v in want.items() if v}
