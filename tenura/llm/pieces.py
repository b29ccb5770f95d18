"""SentencePiece encoding and decoding by a streaming Viterbi search.

Only the vocabulary (pieces, scores, kinds) is read from the model file; segmentation is done here.
A lattice over the characters has one node per boundary and one arc per vocabulary piece. For a
unigram model the best path has the largest sum of scores. For a BPE model an arc may follow
another only if merging their two texts gives back just these two pieces; every prefix then has one
path, which is the result of the merges.

The search follows, character by character, the vocabulary pieces that are still open, in a trie; a
boundary survives while a piece that began there is open, so the window never holds more than the
longest piece before it. Once the backpointer paths of all surviving boundaries meet in one
boundary, the ids before it are final: they are committed and forgotten. Texts of every length take
this one search. Words repeat, so the ids of spans between two boundaries that no piece of the
vocabulary crosses are remembered in a table of bounded size, with whether they decode to the span.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType

SPACE = "▁"
_REMEMBERED = 1_000_000
_BPE = 2


class PieceModel:
    """Vocabulary of a SentencePiece model and the search over it."""

    def __init__(self, path: str):
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=path)
        _refuse_others(source.serialized_model_proto())
        n = source.get_piece_size()
        self.pieces = [source.id_to_piece(i) for i in range(n)]
        self.unknown = source.unk_id()
        self.bytes = {}
        self.ids = {}
        self.scores = {}
        for i, piece in enumerate(self.pieces):
            if source.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (source.is_control(i) or source.is_unknown(i) or source.is_unused(i)):
                self.ids[piece] = i
                self.scores[piece] = source.get_score(i)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self._high = {i for b, i in self.bytes.items() if b > 127}
        self._texts = [chr(self.byte_of.get(i, 0)) if self.byte_of.get(i, 128) < 128 else p
                       for i, p in enumerate(self.pieces)]
        self.longest = max(map(len, self.ids), default=1)
        self._id_scores = {i: self.scores[p] for p, i in self.ids.items()}
        self.unknown_score = min(self.scores.values(), default=0.0) - 10.0
        self.bpe = _model_type(source.serialized_model_proto()) == _BPE
        # Without pieces such as "a_b" no arc crosses from a letter to a following space.
        self.split_at_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._spans: dict[str, bytes] = {}
        self._changed: set[str] = set()  # remembered spans whose ids don't decode to them
        self._fit: dict[int, dict[int, bool]] = {}  # by left and right piece
        self._fit_count = 0
        self._chunks = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self._trie = self._grown()

    def _grown(self) -> dict:
        """Character -> (id of the piece that ends here or -1, what may follow)."""
        root: dict = {}
        for piece in sorted(self.ids):  # what a piece extends comes before it
            children = root
            for char in piece[:-1]:
                children = children.setdefault(char, (-1, {}))[1]
            children[piece[-1]] = (self.ids[piece], {})
        return root

    # -------------------------------------------------------------------------- encoding

    def encode(self, text: str | None) -> list[int]:
        """Piece ids of one text; null and empty texts have none."""
        return np.frombuffer(self.packed(text)[0], np.int32).tolist()

    def packed(self, text: str | None) -> tuple[bytes, bool]:
        """The ids of one text as 32-bit numbers, and whether they decode to it."""
        if not text:
            return b"", True
        marked = SPACE + text.replace(" ", SPACE)
        if not self.split_at_spaces:
            ids = list(self.stream(marked))
            return np.array(ids, np.int32).tobytes(), self.decode(ids) == text
        spans, changed = self._spans, self._changed
        chunks = self._chunks.findall(marked)
        found = list(map(spans.get, chunks))
        same = SPACE not in text
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._remembered(chunks[i])
        if changed:
            same = same and changed.isdisjoint(chunks)
        if len(spans) > _REMEMBERED:
            spans.clear()
            changed.clear()
        if self._fit_count > _REMEMBERED:
            self._fit.clear()
            self._fit_count = 0
        return b"".join(found), same

    def _remembered(self, span: str) -> bytes:
        ids = self._spans.get(span)
        if ids is None:
            listed = list(self.stream(span))
            ids = self._spans[span] = np.array(listed, np.int32).tobytes()
            # Whole characters only: then texts decode span by span.
            if "".join(self._decoded(listed)) != span:
                self._changed.add(span)
        return ids

    def _spelled(self, char: str) -> list[int]:
        """Ids of a character outside the vocabulary."""
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of characters, each as soon as it is final."""
        for ids in self.commits(chars):
            yield from ids

    def commits(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """The ids of a stream of characters, run by run as they become final."""
        root, fit, scores, bpe = self._trie, self._fit, self._id_scores, self.bpe
        most = self.longest
        window: list[str] = []  # characters from the last committed boundary
        back = [0]  # start of the last piece for each boundary of the window
        last = [-1]  # and its id, -1 for a character outside the vocabulary and at the start
        best = [0.0]
        after = [fit.setdefault(-1, {})]  # known pairs with the last piece on the left
        active: list[tuple[int, dict]] = []  # (begin, what may follow) of open pieces, oldest first
        for char in chars:
            end = len(back)
            window.append(char)
            active.append((end - 1, root))
            still, start, chosen, score = [], -1, -1, None
            for begin, children in active:
                step = children.get(char)
                if step is None:
                    continue
                right, onward = step
                if onward:
                    still.append((begin, onward))
                if right < 0:
                    continue
                if bpe:
                    if start < 0:
                        known = after[begin].get(right)
                        if known is None:
                            known = self._fits(last[begin], right)
                        if known:
                            start, chosen = begin, right
                elif score is None or best[begin] + scores[right] > score:
                    start, chosen, score = begin, right, best[begin] + scores[right]
            if start < 0:  # a character outside the vocabulary is an arc of its own
                start = end - 1
                score = 0.0 if bpe else best[start] + self.unknown_score
            back.append(start)
            last.append(chosen)
            if bpe:
                known = fit.get(chosen)
                after.append(fit.setdefault(chosen, {}) if known is None else known)
            else:
                best.append(score)
            active = still
            if not still:
                # Nothing is open: all paths go through this boundary.
                yield self._path(window, back, last, end)
                window, back, last, best, after = [], [0], [chosen], [0.0], after[-1:]
            elif end >= most:
                cut = self._meeting(back, end, still)
                if cut:
                    yield self._path(window, back, last, cut)
                    # Scores count from the cut; a piece across it cannot survive.
                    window, last, after = window[cut:], last[cut:], after[cut:]
                    back = [0] + [max(b - cut, 0) for b in back[cut + 1:]]
                    best = best if bpe else [x - best[cut] for x in best[cut:]]
                    active = [(begin - cut, children) for begin, children in still]
        if window:
            yield self._path(window, back, last, len(window))

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the texts of two pieces gives back just these two pieces.

        Without a piece on the left the right one must be whole itself.
        """
        pieces = [self.pieces[right]] if left < 0 else [self.pieces[left], self.pieces[right]]
        known = self._fit.setdefault(left, {})[right] = self._merged("".join(pieces)) == pieces
        self._fit_count += 1
        return known

    def _meeting(self, back: list[int], end: int, open_: list[tuple[int, dict]]) -> int:
        """The last boundary on the paths of all surviving boundaries, 0 if there is none."""
        live = {begin for begin, _ in open_} | {end}
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(back[far])
        return live.pop()

    def _path(self, window: list[str], back: list[int], last: list[int], end: int) -> list[int]:
        """The ids of the best path to a boundary of the window."""
        out: list[int] = []
        while end:
            if last[end] >= 0:
                out.append(last[end])
            else:
                out.extend(reversed(self._spelled(window[end - 1])))
            end = back[end]
        out.reverse()
        return out

    # -------------------------------------------------------------------------- merges

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best-scored neighbours, leftmost first."""
        parts, get = list(text), self.scores.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    # -------------------------------------------------------------------------- decoding

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids. Byte pieces that are no valid UTF-8 become replacement characters."""
        return "".join(self._decoded(list(ids))).replace(SPACE, " ").removeprefix(" ")

    def _decoded(self, ids: list[int]) -> list[str]:
        """Texts of ids one behind another, spaces still marked."""
        if self._high.isdisjoint(ids):  # every piece is a text of its own
            texts = self._texts
            return [texts[i] for i in ids]
        pieces, byte_of = self.pieces, self.byte_of
        out, raw = [], bytearray()
        for i in ids:
            byte = byte_of.get(i)
            if byte is not None:
                raw.append(byte)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return out


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message in protobuf wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[at:at + size]
            at += size
        else:
            size = 8 if key & 7 == 1 else 4
            yield key >> 3, data[at:at + size]
            at += size


def _model_type(proto: bytes) -> int:
    """trainer_spec.model_type of a serialized model: 1 unigram, 2 BPE."""
    spec = next((v for k, v in _fields(proto) if k == 2), b"")
    return next((v for k, v in _fields(spec) if k == 3), 1)


def _refuse_others(proto: bytes) -> None:
    """Raise for models whose ids need more than the vocabulary: normalisation and the like."""
    message = list(_fields(proto))
    trainer = dict(_fields(next((v for k, v in message if k == 2), b"")))
    normalizer = dict(_fields(next((v for k, v in message if k == 3), b"")))
    found = []
    if trainer.get(3, 1) not in (1, _BPE):
        found.append("a model type other than unigram and BPE")
    if trainer.get(24, 0):
        found.append("spaces marked behind words")
    if normalizer.get(2, b""):
        found.append("character normalisation")
    if not normalizer.get(3, 1):
        found.append("no space before the text")
    if normalizer.get(4, 1):
        found.append("removal of extra spaces")
    if not normalizer.get(5, 1):
        found.append("unmarked spaces")
    if any(dict(_fields(v)).get(3, 1) == 4 for k, v in message if k == 1):
        found.append("user-defined symbols")
    if found:
        raise ValueError(f"the model is not supported, it has {', '.join(found)}")


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    """One model per Python worker and path."""
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with ids array<int>, n_tokens and round_trip.

    ``round_trip`` says whether decoding gives back the text; it is false for texts that hold the
    space mark itself, which the vocabulary cannot tell from a space. Null texts have no ids and
    a null round_trip. Columns of ``docs`` that have one of the three names give way to them. The
    model file travels with the job, so executors need no path of their own.
    """
    docs.sparkSession.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[-1]
    others = [c for c in docs.columns if c not in (text_col, "ids", "n_tokens", "round_trip")]
    rows = docs.select(*others, F.col(text_col).alias("__text"))
    schema = docs.select(*others).schema
    for column, kind in (("n_tokens", LongType()), ("round_trip", BooleanType()),
                         ("ids", ArrayType(IntegerType()))):
        schema = schema.add(column, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(SparkFiles.get(name))
        for batch in batches:
            for part in _bounded(batch):
                texts = part.column(part.num_columns - 1).to_pylist()
                found = [model.packed(text) for text in texts]
                same = [None if text is None else ok for text, (_, ok) in zip(texts, found)]
                sizes = np.array([len(ids) // 4 for ids, _ in found], np.int64)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                flat = np.frombuffer(b"".join([ids for ids, _ in found]), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(sizes), pa.array(same, pa.bool_()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=[*others, "n_tokens", "round_trip", "ids"])

    return rows.mapInArrow(run, schema)


def _bounded(batch: pa.RecordBatch, size: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that the ids held at once stay few."""
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def decode_documents(encoded: DataFrame, model_file: str, ids_col: str = "ids",
                     text_col: str = "text") -> DataFrame:
    """``encoded`` with its ids replaced by their text; null ids give a null text."""
    encoded.sparkSession.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[-1]
    others = [c for c in encoded.columns if c not in (ids_col, text_col)]
    rows = encoded.select(*others, F.col(ids_col).alias("__ids"))
    schema = encoded.select(*others).schema.add(text_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(SparkFiles.get(name))
        for batch in batches:
            texts = [None if x is None else model.decode(x)
                     for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())],
                                             names=[*others, text_col])

    return rows.mapInArrow(run, schema)
