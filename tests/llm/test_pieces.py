import random

import pytest
import sentencepiece

from tenura.llm import pieces, queries

MODEL = queries.PIECES
WORDS = ["the", "aaaaaaaaaaaaaaaaaaaaaaaa", "  ", "zz\n\t", "日本語テキスト", "éèê", "🙂🙂", "x" * 50,
         "internationalization", "1234567890", "​", "<s>", "</s>", "<0x0A>", "ﬁ", "-----", "=" * 40,
         "\x00", "hahahahaha", "ééééé", "!!!!!!!", "aAbBaAbB", "\r\n", "___", "[INST]", "of"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(MODEL)


def texts():
    rng = random.Random(4)
    for n in (0, 1, 2, 5, 20, 80):
        for _ in range(60):
            yield rng.choice(["", " ", "  "]).join(rng.choice(WORDS) for _ in range(n))
    for _ in range(200):
        yield "".join(rng.choice("aehinorst  .") for _ in range(200))


def test_model_kind(model):
    assert model.bpe and model.longest == 16 and len(model.bytes) == 256


def test_same_ids_as_the_library(model, library):
    for text in texts():
        ids = model.encode(text)
        assert ids == library.encode(text), text
        assert model.decode(ids) == text == library.decode(ids)


def test_streaming_over_spaces_gives_the_same_ids(model, library):
    for text in list(texts())[::7]:
        marked = pieces.SPACE + text.replace(" ", pieces.SPACE) if text else ""
        assert list(model.stream(marked)) == library.encode(text)


def test_long_runs_without_spaces(model, library):
    rng = random.Random(9)
    for letters in ("ab", "aehinorst", "aehinorstdlcumé日\n", "=-_.", "0123456789"):
        for _ in range(20):
            text = "".join(rng.choice(letters) for _ in range(900))
            assert model.encode(text) == library.encode(text)


def test_ids_are_committed_early(model):
    taken = 0

    def chars():
        nonlocal taken
        for c in pieces.SPACE + "another" * 5000:
            taken += 1
            yield c

    stream = model.stream(chars())
    next(stream)
    assert taken < 200


def test_short_spans_are_committed_where_paths_meet(model, library):
    for word in ("straightforwardness", "Zzyzx-road", "日本語テキスト", "qqqq", "0123456789"):
        runs = list(model.commits(pieces.SPACE + word))
        assert [i for run in runs for i in run] == library.encode(word)
    long_word = pieces.SPACE + "straightforwardness-and-more"
    assert len(long_word) < 64 and len(list(model.commits(long_word))) > 1
    taken = 0

    def chars():
        nonlocal taken
        for taken, c in enumerate(long_word, 1):
            yield c

    next(model.commits(chars()))
    assert taken < len(long_word)


def test_the_window_stays_bounded(model):
    sizes = []
    path = model._path
    model._path = lambda window, *rest: sizes.append(len(window)) or path(window, *rest)
    try:
        list(model.stream(pieces.SPACE + "internationalization" * 3000))
    finally:
        del model._path
    assert max(sizes) <= 3 * model.longest and len(sizes) > 100


def test_other_models_are_refused(tmp_path, library):
    proto = library.serialized_model_proto()
    # A second normaliser message wins over the first in protobuf, the first in this reader.
    changed = tmp_path / "m.model"
    changed.write_bytes(bytes([3 << 3 | 2, 2, 4 << 3, 1]) + proto)
    with pytest.raises(ValueError, match="extra spaces"):
        pieces._refuse_others(changed.read_bytes())
    with pytest.raises(ValueError, match="model type"):
        pieces._refuse_others(bytes([2 << 3 | 2, 2, 3 << 3, 4]) + proto)
    pieces._refuse_others(proto)


def test_round_trips_are_judged_by_span(model):
    for text in ("plain words", "a\u2581b", " é \x00 🙂 ", "", "日本"):
        ids, same = model.packed(text)
        assert same == (model.decode(model.encode(text)) == text)


def test_unigram_path_has_the_best_score(model):
    rng = random.Random(2)
    model = pieces.PieceModel(MODEL)
    model.bpe = False
    model.scores = {p: -rng.uniform(1, 12) for p in model.ids}
    model._id_scores = {i: model.scores[p] for p, i in model.ids.items()}
    model.unknown_score = -30.0

    def best(text):
        scores = [(0.0, ())]
        for end in range(1, len(text) + 1):
            arcs = [(scores[b][0] + model.scores[text[b:end]], (*scores[b][1], text[b:end]))
                    for b in range(max(0, end - 16), end) if text[b:end] in model.ids]
            scores.append(max(arcs))
        return scores[-1][0]

    for _ in range(100):
        text = "".join(rng.choice("aehinorst") for _ in range(150))
        path = [model.pieces[i] for i in model.stream(text)]
        assert "".join(path) == text
        assert abs(sum(model.scores[p] for p in path) - best(text)) < 1e-6


def test_documents(spark, small, library):
    docs = {r.doc_id: r.text for r in
            spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op8_pieces(spark, small).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.ids == library.encode(docs[i]) and r.n_tokens == len(r.ids) and r.round_trip


def test_edge_rows(spark):
    long = "ab" * 40_000
    rows = [(1, None, "q"), (2, "", None), (None, " x ", "q"), (4, long, "q"), (4, long, "q"),
            (5, "a▁b", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    encoded = pieces.encode_documents(docs, MODEL)
    assert encoded.columns == ["doc_id", "lang", "n_tokens", "round_trip", "ids"]
    got = {(r.doc_id, r.lang): (r.n_tokens, r.round_trip) for r in encoded.collect()}
    assert got[1, "q"] == (0, None) and got[2, None] == (0, True)
    assert got[None, "q"][1] and got[4, "q"][1] and not got[5, "q"][1]
    back = pieces.decode_documents(encoded, MODEL)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == [
        (0, " x "), (1, ""), (2, ""), (4, long), (4, long), (5, "a b")]
    assert pieces.encode_documents(docs.limit(0), MODEL).count() == 0
    named = pieces.encode_documents(docs.withColumnRenamed("lang", "ids"), MODEL)
    assert named.columns == ["doc_id", "n_tokens", "round_trip", "ids"]
    assert named.where("doc_id = 2").first().ids == []
