import json

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tenura.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    text = text or ""
    return len(text.encode()), len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("head", [token_counts.HEAD, 50, 0])
def test_documents_match_the_library(spark, small, head):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = token_counts.count_tokens(docs, PATH, head=head)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((r.doc_id, *expected(r.text), expected(r.text)[1] > 1024)
                  for r in docs.collect())
    assert sorted(map(tuple, got.collect())) == want


TEXTS = [
    None, "", " ", "  ", "\n", " \n\t  x", "a", "I'll they're 'S we'd", "<|endoftext|>",
    "a<|endoftext|><|endoftext|> b", " <|endoftext|> ", "<|endoftext", "x" * 50_000,
    "naïve Straße ñandú 東京 🙂🙂 é", "1234567 ½ Ⅻ ٣٤", "a b c　d​e",
    # Letters that newer Unicode tables have and the library's don't.
    "xᲉy \U0001dfff࢏ z౜Ⱟ \U000323b0\U00031350", "\x00\x01 \x7f", "� ﻿",
    "word " * 3000, "ﬁ Ǆ ʰ ⁴ ₂ ๑ 〇 ㆒", "don't’t", "\r\n\r\n  a", "end  ", "...!!! ???\n\n",
]


def test_hard_texts_match_the_library(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = token_counts.count_tokens(
        spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {
        i: expected(t) for i, t in rows}


def test_every_code_point_is_cut_as_the_library_does():
    pre = token_counts.PreTokens(token_counts._read(PATH))
    cut = LIBRARY.pre_tokenizer.pre_tokenize_str
    for start in range(0, 0x110000, 0x400):
        if 0xD800 <= start < 0xE000:
            continue
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in range(start, start + 0x400))
        assert pre.cut(text) == [text[a:b] for _, (a, b) in cut(text)], hex(start)


def test_edge_rows(spark):
    rows = [(None, "same words here", "u", 1), (None, "same words here", "v", 2), (7, None, "w", 3),
            (7, "unlikelyword unlikelyword", "x", 4), (7, "", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string, row long")
    got = token_counts.count_tokens(docs, PATH, limit=3).collect()
    want = [(i, *expected(t), expected(t)[1] > 3) for i, t, *_ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0
    named = docs.select(docs.doc_id.cast("string").alias("key"), docs.text.alias("body"))
    other = token_counts.count_tokens(named, PATH, id_col="key", text_col="body")
    assert other.columns[0] == "key" and other.count() == 5


def test_a_pre_token_in_every_document(spark):
    word = "gnorptalbique"
    docs = spark.range(3000).selectExpr("id AS doc_id", f"concat('{word} ', id) AS text")
    for head in (0, 100):
        got = token_counts.count_tokens(docs, PATH, head=head).agg({"n_tokens": "sum"}).first()[0]
        assert got == sum(expected(f"{word} {i}")[1] for i in range(3000))


def test_other_tokenizers_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    spec = json.loads(token_counts._read(PATH))
    spec["added_tokens"][0]["lstrip"] = True
    changed = tmp_path / "t.json"
    changed.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="added token"):
        token_counts.count_tokens(docs, str(changed))
