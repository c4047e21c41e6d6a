"""Vector bin packing of examples into training sequences.

Each sequence has three limits: tokens, segments and loss-bearing tokens. The next piece of a sequence is the
waiting example whose demand has the largest dot product with what the sequence has left, both relative to the
limits. If none fits and cutting is allowed, the longest waiting example is cut to fill the sequence exactly.
Large examples win that product, so very short ones pile up; while they are most of those that wait, each sequence
first takes the shortest, up to half of its segments.

Every task packs the rows that it reads, from a window of waiting examples, so nothing is shuffled, memory is
bounded and a lost task is repeated alone. A task leaves at most one sequence short of its limits.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import mapped, quoted, slices, stretches

#: Bytes of text that are tokenized at a time.
SLICE = 2 << 20
EXAMPLE_SCHEMA = "start long, length long, loss_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. window: examples that wait at a time."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    window: int = 256


class Packer:
    """Packs (handle, tokens, loss) examples; gives (handle, start, length, loss, sequence, offset) pieces."""

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut = limits, cut
        self.handles: list = []
        self.start: list[int] = []
        self.tokens: list[int] = []
        self.loss: list[int] = []
        self.sequence = 0

    def add(self, handle, tokens: int, loss: int) -> Iterator[tuple]:
        start, most = 0, self.limits
        # A whole sequence's worth needs no partner.
        while tokens > most.tokens or loss > most.loss_tokens or tokens == most.tokens:
            part, borne = self._part(tokens, loss, most.tokens, most.loss_tokens)
            yield handle, start, part, borne, self.sequence, 0
            self.sequence += 1
            start, tokens, loss = start + part, tokens - part, loss - borne
            if not tokens:
                return
        self.handles.append(handle)
        self.start.append(start)
        self.tokens.append(tokens)
        self.loss.append(loss)
        if len(self.handles) >= 2 * most.window:
            yield from self._pack(most.window)

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(0)

    @staticmethod
    def _part(tokens: int, loss: int, room: int, loss_room: int) -> tuple[int, int]:
        """The longest prefix of an example that fits, its loss spread evenly; at least one token."""
        part = min(tokens, room)
        if loss and loss * part > loss_room * tokens:
            part = max(1, loss_room * tokens // loss)
        return part, loss if part == tokens else min(loss_room, loss * part // tokens)

    def _pack(self, leave: int) -> Iterator[tuple]:
        most = self.limits
        tokens, loss = np.array(self.tokens, np.int64), np.array(self.loss, np.int64)
        start, waiting = list(self.start), np.ones(len(tokens), bool)
        left = len(tokens)
        while left > leave:
            room, segments, loss_room, offset = most.tokens, most.segments, most.loss_tokens, 0
            # Shorter than a sequence's mean piece if its segments run out together with its tokens.
            short = np.flatnonzero(waiting & (tokens * most.segments < most.tokens))
            first = most.segments // 2 if 2 * len(short) > left else 0
            queue = short[np.argsort(tokens[short], kind="stable")][:first].tolist()[::-1]
            while left and room and segments:
                fits = waiting & (tokens <= room) & (loss <= loss_room)
                while queue and not fits[queue[-1]]:
                    queue.pop()
                if queue:
                    k = queue.pop()
                else:
                    # The segment term is the same for each example: one segment against those left.
                    score = np.where(fits, tokens * (room / most.tokens**2) + loss * (loss_room / most.loss_tokens**2), -1.0)
                    k = int(score.argmax())
                if fits[k]:
                    part, borne = int(tokens[k]), int(loss[k])
                elif self.cut:
                    k = int(np.where(waiting, tokens, -1).argmax())
                    if loss[k] and not loss_room:
                        break
                    part, borne = self._part(int(tokens[k]), int(loss[k]), room, loss_room)
                else:
                    break
                yield self.handles[k], start[k], part, borne, self.sequence, offset
                offset, room, segments, loss_room = offset + part, room - part, segments - 1, loss_room - borne
                tokens[k], loss[k], start[k] = tokens[k] - part, loss[k] - borne, start[k] + part
                if not tokens[k]:
                    waiting[k] = False
                    left -= 1
            self.sequence += 1
        kept = np.flatnonzero(waiting).tolist()
        self.handles = [self.handles[k] for k in kept]
        self.start, self.tokens, self.loss = [start[k] for k in kept], tokens[kept].tolist(), loss[kept].tolist()


#: A letter, the ASCII signs after it, and the end of the word; of letters those that stay one letter in lower case.
TAIL = r"([\p{Ll}\p{Lo}])([!-/:-@\[-`{-~]+)( |$)"


class WordIds(dict):
    """The ids of space-separated words as little-endian 32-bit bytes, by a tokenizer that drops white space.

    Such a tokenizer never joins characters across a space, so a text's ids are its words' ids in a row. It also never
    joins a letter to the full stops or other signs after it, and lower-cases, so a new word is looked up without those
    first. When `most` words are held, before the next texts, they become the old ones; an old word that is met again is
    held again.
    """

    def __init__(self, path: str, most: int = 60_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.most, self.old = Tokenizer.from_file(path), most, {}
        #: The same merges for runs of lower-case ASCII words, which need no normalising.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if "<|" not in word:  # the tokenizer's own tokens are no words
                stem = word.rstrip(punctuation)
                if stem != word and stem[-1:].lower().isalpha():
                    return self[stem] + self[word[len(stem) :]]
                if word.isascii() and not word.islower() and (low := word.lower()) != word:
                    return self[low]
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def learn(self, words: list[str]) -> None:
        """Holds those of the distinct words that are letters alone, encoded in long runs.

        A run is cut where a token ends a word; one with more or fewer ends than words is encoded word by word.
        """
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        old = self.old
        missing = [w for w in words if w not in self]
        self.update((w, old[w]) for w in missing if w in old)
        fresh = [w for w in missing if w not in old and w.isalpha() and len(w) <= 64 and w[-1].lower().isalpha()]
        for tokenizer, some in ((self.plain, [w for w in fresh if w.isascii() and w.islower()]), (self.tokenizer, [w for w in fresh if not w.isascii()])):
            runs = [some[at : at + 256] for at in range(0, len(some), 256)]
            for run, found in zip(runs, tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, "<u4")
                cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
                if len(cuts) == len(run):
                    data, at = ids.tobytes(), 0
                    for word, cut in zip(run, cuts, strict=True):
                        self[word], at = data[at:cut], cut

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the last one's end). Distinct words are looked up once."""
        texts = pc.replace_substring(texts, "\n", " ")
        # Lower case, and signs apart from the word before them: the ids stay the same, and fewer words are distinct.
        parted = pc.replace_substring_regex(pc.ascii_lower(texts), TAIL, r"\1 \2\3")
        named = pc.match_substring(texts, "<|")  # may be the tokenizer's own tokens, which are in lower case
        split = pc.split_pattern(pc.if_else(named, texts, parted), " ")
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.learn(words)
        found = list(map(self.__getitem__, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        size = sizes[at]
        after = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(first[at] - after[:-1], size) + np.arange(after[-1])]
        return ids, after[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def of(self, text: str) -> bytes:
        return self.encode(pa.array([text]))[0].tobytes()


@cache
def word_ids(path: str) -> WordIds:
    """One for each tokenizer, kept by a Python worker from task to task; its words are forgotten after each."""
    return WordIds(path)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where it starts in the document's ids and where it lies in its sequence.

    A document's ids are its text's, then end_id; all but the first bear loss, since nothing before the first foretells
    it. Null text is an empty one: just end_id. Repeated rows and null ids are packed like any other; ids keep their
    type. Other columns are ignored. No rows give no pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    end = int(end_id).to_bytes(4, "little")

    def pack(batches):
        ids, packer = word_ids(tokenizer_path), Packer(limits, cut=True)
        first, out, handles, like = TaskContext.get().partitionId() << 40, [], [], None

        def rows(pieces):
            for (doc, data), start, length, _, sequence, offset in pieces:
                handles.append(doc)
                out.append((start, length, zlib.crc32(memoryview(data)[4 * start : 4 * (start + length)]), len(data) // 4, first + sequence, offset))

        def table():
            done = pa.RecordBatch.from_arrays([pa.array(handles, like), *_table(out, schema).columns], names=["doc_id", *names])
            out.clear(), handles.clear()
            return done

        try:
            for batch in stretches(batches, 1, SLICE):
                like = batch.schema.types[0]
                flat, bounds = ids.encode(batch.column(1))
                for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    data = flat[a:b].tobytes() + end
                    rows(packer.add((doc, data), len(data) // 4, len(data) // 4 - 1))
                if len(out) >= 8192:
                    yield table()
            rows(packer.finish())
            if out:
                yield table()
        finally:
            ids.forget()

    texts = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.transform(mapped, pack, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits = Limits(), cut: bool = False) -> DataFrame:
    """Packs instruction examples of known length: id_col, start, length, loss_tokens, sequence_id, offset.

    Whole examples stay together unless cut is set or one is over a limit by itself. Null or negative counts are
    zero, loss is at most the tokens, and an example without tokens gets no piece. Repeated rows count each. Ids keep
    their type; an empty table gives no rows.
    """
    kind = examples.schema[id_col].dataType
    pairs = examples.select(quoted(id_col), *[F.greatest(F.coalesce(quoted(c).cast("long"), F.lit(0)), F.lit(0)).alias(n) for c, n in ((tokens_col, "__tokens"), (loss_col, "__loss"))])

    def pack(batches):
        packer, first, out, handles = Packer(limits, cut), TaskContext.get().partitionId() << 40, [], []
        rest = pa.schema([(n, pa.int64()) for n in ("start", "length", "loss_tokens", "sequence_id", "offset")])

        def table(like):
            ids = pa.array(handles, like)
            return pa.RecordBatch.from_arrays([ids, *_table(out, rest).columns], names=[id_col, *rest.names])

        def rows(pieces):
            for handle, start, length, loss, sequence, offset in pieces:
                handles.append(handle)
                out.append((start, length, loss, first + sequence, offset))

        like = None
        for batch in slices(batches, 4096):
            like = batch.schema.types[0]
            for handle, tokens, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tokens:
                    rows(packer.add(handle, tokens, min(loss, tokens)))
            if len(out) >= 8192:
                yield table(like)
                out.clear(), handles.clear()
        rows(packer.finish())
        if out:
            yield table(like)

    return pairs.transform(mapped, pack, f"`{id_col}` {kind.simpleString()}, {EXAMPLE_SCHEMA}")


def conversation_lengths(turns: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Tokens and loss-bearing tokens (those of loss_role) of each conversation, for pack_examples.

    Null text is empty; a null role bears no loss; turns without a conversation's id count as one conversation with a
    null id. Repeated turns count each. An empty table gives no rows.
    """

    def count(batches):
        ids = word_ids(tokenizer_path)
        try:
            for batch in stretches(batches, 2, SLICE):
                n = np.diff(ids.encode(batch.column(2))[1])
                borne = np.where(batch.column(1).to_numpy(zero_copy_only=False), n, 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(borne, pa.int64())], names=[conv_col, "n_tokens", "n_loss"])
        finally:
            ids.forget()

    kind = turns.schema[conv_col].dataType.simpleString()
    texts = turns.select(quoted(conv_col), F.coalesce(quoted(role_col) == loss_role, F.lit(False)).alias("__borne"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("__text"))
    counts = texts.transform(mapped, count, f"`{conv_col}` {kind}, n_tokens long, n_loss long")
    return counts.groupBy(quoted(conv_col)).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_loss").alias("n_loss"))
