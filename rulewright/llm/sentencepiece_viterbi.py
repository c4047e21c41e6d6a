"""SentencePiece encoding and decoding with forward states shared between words of a common prefix.

A text becomes marked words: runs of the space mark with what follows up to the next mark. The distinct words of a
batch are sorted, which lists a trie depth-first; a stack holds the forward state of each character of the
current path, and the next word starts from the last character that it shares with the one before.

Unigram models: the state is the best score of any segmentation up to there (Viterbi). BPE models have no path score
to maximise; there the state is the last piece of the prefix's encoding. It is found likewise from earlier states:
piece t after a prefix is right exactly if the prefix's last piece and t, joined, are encoded as those two pieces.
"""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import mapped, quoted, slices, stretches

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _fields(data: bytes):
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ((4, 8)[key & 7 == 1], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """The pieces of a model file with identity normalisation."""

    def __init__(self, path: str, kind: int | None = None):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.prefix = BPE if kind is None else kind, True
        with open(path, "rb") as file:
            data = file.read()
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif field == 2 and kind is None:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                self.prefix = bool(spec.get(3, 1))
                if spec.get(1) != b"identity" or spec.get(4, 1):
                    raise ValueError("only models with identity normalisation that keep white space")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        if USER in self.types or UNUSED in self.types:
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.unknown = self.types.index(UNKNOWN)
        self.begins = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.gain = {p: self.scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        #: Neighbouring characters within pieces; no merge or piece ever crosses any others.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces must not cross the start of a word")
        #: What each id adds to a decoded text.
        self.parts = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]

    def words(self, text: str) -> list[str]:
        """The marked words of a text; joined, they are the text with marks for spaces."""
        if not text:
            return []
        runs = (" " + text if self.prefix else text).split(" ")
        out, marks = ([runs[0]] if runs[0] else []), ""
        for run in runs[1:]:
            marks += MARK
            if run:
                out.append(marks + run)
                marks = ""
        return out + [marks] if marks else out

    def pairs(self, text: str) -> list[str]:
        """The pieces of a text by BPE merges: the best score first, of equals the leftmost."""
        parts, none = list(text), -np.inf
        gains = [self.gain.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while gains and (best := max(gains)) > none:
            at = gains.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            for i in (at - 1, at):
                if 0 <= i < len(gains):
                    gains[i] = self.gain.get(parts[i] + parts[i + 1], none)
        return parts


class Encoder:
    """Encodes words; keeps about `most` of them (those of up to 64 characters), and more verdicts on pairs of pieces.

    When `most` words are held they become the old ones; an old word that is met again is held again.
    """

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.after: dict[tuple[str, str], bool] = {}
        self.steps: dict[tuple[str, str], tuple[str, tuple[str, ...]]] = {}
        self.whole: dict[str, bool] = {}
        self.reused = self.visited = 0

    def _follows(self, left: str, right: str) -> bool:
        verdict = self.after.get((left, right))
        if verdict is None:
            if len(self.after) >= 5 * self.most:
                self.after.clear()
            verdict = self.after[left, right] = self.model.pairs(left + right) == [left, right]
        return verdict

    def _whole(self, piece: str) -> bool:
        """Whether merges make just this piece of its characters; known for at most the model's pieces."""
        if piece not in self.whole:
            self.whole[piece] = self.model.pairs(piece) == [piece]
        return self.whole[piece]

    def _step(self, state: str, char: str) -> tuple[str, tuple[str, ...]]:
        """The longest end of state and char that begins a piece, and the pieces that end there, the longest first.

        A single character counts as a piece. state: the longest end of a prefix that begins a piece, as found before.
        """
        found = self.steps.get((state, char))
        if found is None:
            if len(self.steps) >= 5 * self.most:
                self.steps.clear()
            ends = state + char
            pieces = tuple(p for n in range(len(ends), 0, -1) if n == 1 or ends[-n:] in self.model.ids for p in (ends[-n:],))
            while ends and ends not in self.model.begins:
                ends = ends[1:]
            found = self.steps[state, char] = ends, pieces
        return found

    def encode_sorted(self, words: list[str]):
        """Yields the pieces of each of the sorted words."""
        model, before = self.model, ""
        # Of each prefix on the path: its last piece, its best score, and its longest end that begins a piece.
        last, score, states = [""], [0.0], [""]
        bpe, steps, after = model.kind == BPE, self.steps, self.after
        for word in words:
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], score[shared + 1 :], states[shared + 1 :]
            self.reused, self.visited, before = self.reused + shared, self.visited + len(word) - shared, word
            state = states[-1]
            for end, char in enumerate(word[shared:], shared + 1):
                state, pieces = steps.get((state, char)) or self._step(state, char)
                states.append(state)
                if bpe:
                    for piece in pieces:
                        if at := end - len(piece):
                            verdict = after.get((last[at], piece))
                            if self._follows(last[at], piece) if verdict is None else verdict:
                                break
                        # The first piece of a word has no piece before it and must itself come out whole.
                        elif self._whole(piece):
                            break
                    last.append(piece)
                else:
                    best, chosen = -np.inf, char
                    for piece in pieces:
                        value = score[end - len(piece)] + model.gain.get(piece, model.unknown_score)
                        if value > best:
                            best, chosen = value, piece
                    last.append(chosen)
                    score.append(best)
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            yield pieces[::-1]

    def ids_of(self, pieces: list[str]) -> list[int]:
        model, out = self.model, []
        for piece in pieces:
            k = model.ids.get(piece)
            if k is not None:
                out.append(k)
            elif model.bytes:
                out += [model.bytes[b] for b in piece.encode()]
            else:
                out.append(model.unknown)
        return out

    def batch(self, texts: list[str]) -> list[tuple[int, bytes]]:
        """The number of marked words and the ids of each text, as little-endian 32-bit bytes."""
        split = [self.model.words(t) for t in texts]
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        missing = set().union(*split).difference(self.known)
        back = [w for w in missing if w in self.old]
        self.known.update((w, self.old[w]) for w in back)
        missing.difference_update(back)
        # A word whose last mark no piece joins to what stands before it is that word without it, and the mark.
        ends = {w for w in missing if len(w) > 2 and w[-1] in ".,;:!?" and w[-2:] not in self.model.inside}
        stems = {x for w in ends for x in (w[:-1], w[-1])}
        fresh = sorted(stems.union(missing.difference(ends)).difference(self.known))
        for word, pieces in zip(fresh, self.encode_sorted(fresh), strict=True):
            self.known[word] = np.array(self.ids_of(pieces), "<u4").tobytes()
        self.known.update((w, self.known[w[:-1]] + self.known[w[-1]]) for w in ends)
        out = [(len(words), b"".join(map(self.known.__getitem__, words))) for words in split]
        for word in [w for w in missing if len(w) > 64]:
            del self.known[word]
        return out

    def forget(self) -> None:
        """Drops the words; verdicts on pairs stay, since texts to come need the same ones."""
        self.known, self.old = {}, {}


@cache
def kept_encoder(path: str, kind: int | None) -> Encoder:
    """One for each model, kept by a Python worker from task to task."""
    return Encoder(Model(path, kind))


def decode(model: Model, ids) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    data = b"".join(map(model.parts.__getitem__, ids))
    return (data[1:] if model.prefix and data[:1] == b" " else data).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model_path: str, kind: int | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_words, n_ids, n_bytes_ids (ids of single bytes), ids_crc32, decoded_chars, round_trip for each row.

    Null text is empty: no ids. Repeated rows and null ids are rows like any other; other columns are ignored.
    round_trip: decoding the ids gives the text again. with_ids adds the ids themselves.
    """
    kept = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_words", "n_ids", "n_byte_ids", "ids_crc32", "decoded_chars", "round_trip"]

    def run(batches):
        encoder = kept_encoder(model_path, kind)
        try:
            yield from encoded(batches, encoder, encoder.model)
        finally:
            encoder.forget()

    def encoded(batches, encoder, model):
        single = np.zeros(len(model.pieces), bool)
        single[list(model.bytes.values())] = True
        for batch in stretches(batches, 1, 4 << 20):
            texts = batch.column(1).to_pylist()
            rows = []
            for text, (n_words, data) in zip(texts, encoder.batch(texts), strict=True):
                ids = np.frombuffer(data, "<u4")
                back = decode(model, ids.tolist())
                rows.append((n_words, len(ids), int(single[ids].sum()), zlib.crc32(data), len(back), back == text, ids.astype(np.int32).tolist() if with_ids else None))
            columns = list(zip(*rows, strict=True))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(columns[6], pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    texts = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.transform(mapped, run, f"doc_id {kept}, n_words long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_chars long, round_trip boolean" + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with ids. Null or no ids: empty text. Ids outside the model raise an error."""
    kept = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        model = Model(model_path)
        for batch in slices(batches, 512):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(model, ids or []) for ids in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(quoted(id_col).alias("doc_id"), quoted(ids_col).alias("ids")).transform(mapped, run, f"doc_id {kept}, text string")
