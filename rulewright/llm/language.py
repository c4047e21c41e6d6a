"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams of a language, most frequent first. A document's own list is compared to
each: every n-gram costs by how many ranks it is out of place, or the length of a list if the profile lacks it. The
nearest profile names the language.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rulewright.llm.common import mapped, quoted, slices

#: Ranks of a profile; longest n-gram; most languages that may be learned: their profiles go to the driver and every task.
RANKS, LONGEST, LANGUAGES = 300, 3, 1000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def ngrams(word: str, longest: int = LONGEST):
    """The n-grams of one word, as gram_counts() counts them."""
    padded = f"_{word}_"
    for n in range(1, longest + 1):
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if gram != "_":
                yield gram


def ranked(counts: dict[str, int], ranks: int = RANKS) -> list[str]:
    """The most frequent n-grams; of equals, the first in code point order."""
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:ranks]]


@cache
def letter_table() -> np.ndarray:
    """For each code point, whether LETTERS takes it."""
    every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.zeros(0x110000, bool)
    for m in LETTERS.finditer(every):
        out[m.start() : m.end()] = True
    return out


def key_of(gram: str) -> int:
    """An n-gram of at most three code points as a number, in code point order."""
    return sum(ord(c) << (42 - 21 * i) for i, c in enumerate(gram))


def gram_of(key: int) -> str:
    return "".join(chr(c) for c in (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if c)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at, np.concatenate([n for _, n in parts]))
    return keys, sums


def gram_counts(text: str, longest: int = LONGEST, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the n-grams (at most 3) of a text's words, in key order; a piece of the text at a time."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = letter_table()[points]
    last = np.concatenate([[False], letter[:-1]])
    # "_" before the first word and after each: the words with one sign between them.
    keep = letter | last
    line = np.concatenate([[ord("_")], np.where(letter, points, ord("_"))[keep], [ord("_")] if len(letter) and letter[-1] else []]).astype(np.int64)
    parts = []
    for start in range(0, len(line), piece):
        one = line[start : start + piece + 2]
        most = min(piece, len(line) - start)
        whole = one != ord("_")
        keys = [(one[:most] << 42)[whole[:most]]]
        if longest > 1:
            keys.append(((one[:-1] << 42) | (one[1:] << 21))[:most])
        if longest > 2:
            keys.append(((one[:-2] << 42) | (one[1:-1] << 21) | one[2:])[whole[1:-1]] if len(one) > 2 else one[:0])
        parts.append(np.unique(np.concatenate(keys), return_counts=True))
    return merged(parts)


def learn(rows: DataFrame, ranks: int = RANKS, longest: int = LONGEST, languages: int = LANGUAGES) -> dict[str, list[str]]:
    """A profile for each language of rows (text, lang); counts cover all rows. longest: 3 at most.

    What comes to the driver is bounded: ranks n-grams of each of at most `languages` languages; more are an error.
    """

    def count(batches):
        waiting: dict[str, list[str]] = {}
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        chars = 0

        def take():
            for lang, texts in waiting.items():
                found = gram_counts("\n".join(texts), longest)
                held[lang] = merged([held[lang], found]) if lang in held else found
            waiting.clear()

        def flush():
            langs = [lang for lang, (keys, _) in held.items() for _ in range(len(keys))]
            out = [pa.array(langs, pa.string()), *(pa.array(np.concatenate([pair[i] for pair in held.values()])) for i in (0, 1))]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=["lang", "gram", "n"])

        for batch in slices(batches, 64):
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = text.as_py()
                waiting.setdefault(lang, []).append(text)
                chars += len(text)
                if chars > 1_000_000:
                    take()
                    chars = 0
                    if sum(len(keys) for keys, _ in held.values()) > 200_000:
                        yield flush()
        take()
        if held:
            yield flush()

    if longest > 3:
        raise ValueError("n-grams have at most three letters")
    counts = rows.where("text is not null and lang is not null").select("text", "lang").transform(mapped, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= ranks)
    size = top.groupBy("lang").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("grams"))
    found = size.limit(languages + 1).collect()
    if len(found) > languages:
        raise ValueError(f"more than {languages} languages: raise the parameter if their profiles fit in memory")
    return {r.lang: [gram_of(g.gram) for g in r.grams] for r in sorted(found, key=lambda r: r.lang)}


class Profiles:
    """Profiles as a matrix: the rank of each known n-gram in each language."""

    def __init__(self, profiles: dict[str, list[str]], ranks: int = RANKS, longest: int = LONGEST):
        self.langs, self.ranks, self.longest = list(profiles), ranks, longest
        self.known = np.array(sorted({key_of(g) for grams in profiles.values() for g in grams}) or [0], np.int64)
        # The rank of each known n-gram, or -1.
        self.place = np.full((len(self.known), max(1, len(self.langs))), -1, np.int64)
        for k, grams in enumerate(profiles.values()):
            self.place[np.searchsorted(self.known, np.array([key_of(g) for g in grams], np.int64)), k] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, the first of equals, and how near: 1 for a list in the profile's own order, 0 for nothing in common."""
        text = text or ""
        # LETTERS also takes signs such as superscript digits, which alone aren't letters.
        if not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        keys, counts = gram_counts(text, self.longest)
        if not len(keys):
            return UNKNOWN, 0.0
        own = keys[np.argsort(-counts, kind="stable")[: self.ranks]]  # keys are in order: so are those with equal counts
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        place = np.where((self.known[at] == own)[:, None], self.place[at], -1)
        cost = np.where(place < 0, self.ranks, np.abs(place - np.arange(len(own))[:, None])).sum(0)
        best = int(cost.argmin())
        return self.langs[best], float(1 - cost[best] / (self.ranks * len(own)))


def identify(docs: DataFrame, profiles: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row by its whole text; und and 0 for null, no letter or no profiles."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = Profiles(profiles)
        for batch in slices(batches, 512):
            got = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text")).transform(mapped, run, f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Documents that nothing is learned from: crc32 of the id as text divides by 5. A null id counts as an empty one, and is held out."""
    return F.crc32(F.coalesce(quoted(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def held_out_predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; profiles are learned from those not held out.

    Null texts and languages teach nothing. Repeated rows count each. An empty table gives no rows.
    """
    rows = docs.select(quoted(text_col).cast("string").alias("text"), quoted(lang_col).cast("string").alias("lang"), held_out(id_col).alias("out"))
    found = identify(docs, learn(rows.where("not out"), RANKS), id_col, text_col)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
