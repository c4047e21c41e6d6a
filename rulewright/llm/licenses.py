"""License scans by diagonal voting.

Every rolling k-gram hash of every document is joined to the places where a template has it. Matches on one diagonal
(document place less template place) vote together; the words around neighbouring diagonals, moved apart by an
inserted or a missing word, are aligned with the template's, and a span counts if few enough words were edited.

A template of m words with at most d edits is cut by them into d+1 pieces, so some piece of at least (m-d)/(d+1) words
is whole: k is that for each template, and no span within the limit is without a vote.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rulewright.llm.common import checked_broadcast, mapped, materialize, quoted, row_key, separators_to_space, slices, stretches, text_bytes

#: Values that are fixed: phrases of the base scan and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices as they stand at the head of files and pages; a parameter.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License. See LICENSE for details."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)

#: Words that name the kind of a license: an aligned span has just those of its template, whatever else was edited.
KINDS = frozenset(b"nc nd sa noncommercial noderivs noderivatives sharealike lesser affero gnu apache mit mozilla bsd mpl gpl lgpl agpl".split())

#: Words are runs of a-z, 0-9 and bytes over 0x7F, once A-Z is lower-cased.
WORDS = separators_to_space(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORDS).split()


class Grams(dict):
    """Rolling k-gram hashes of word lists: a polynomial in 64-bit word hashes, mixed; words are kept up to a bound."""

    def __init__(self, k: int, most: int = 200_000):
        self.k, self.most = k, most
        self.powers = [pow(0x9E3779B97F4A7C15, k - 1 - i, 1 << 64) for i in range(k)]

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        n = len(words) - self.k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        one = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        total = np.zeros(n, np.uint64)
        for i, p in enumerate(self.powers):
            total += one[i : i + n] * np.uint64(p)
        total ^= total >> np.uint64(29)
        return (total * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def phrase_places(words: list[bytes], phrases: list[list[bytes]]) -> list[list[int]]:
    """Where each phrase's words stand consecutively, by the word where it starts."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase in phrases:
        want, places, at, count, upto = b" " + b" ".join(phrase) + b" ", [], joined.find(b" " + b" ".join(phrase) + b" "), 0, 0
        while at >= 0:
            count, upto = count + joined.count(b" ", upto, at), at
            places.append(count)
            at = joined.find(want, at + 1)
        out.append(places)
    return out


def base_scan(docs: DataFrame, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n_words, n_base, first_word, last_word, base_labels (sorted array) of each row."""
    parts, labels = [p.encode().split() for p, _ in phrases], [x for _, x in phrases]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, 1024):
            rows = []
            for text in batch.column(2):
                words = words_of(text.as_buffer().to_pybytes())
                places = phrase_places(words, parts)
                flat = [x for p in places for x in p]
                rows.append((len(words), len(flat), min(flat, default=None), max(flat, default=None), sorted({x for x, p in zip(labels, places, strict=True) if p})))
            columns = zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.list_(pa.string())], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in columns)], names=["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base_labels"])

    rows = docs.select(quoted(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), text_bytes(text_col).alias("text"))
    return rows.transform(mapped, run, f"doc_id {kind}, key binary, n_words long, n_base long, first_word long, last_word long, base_labels array<string>")


def gram_rows(docs: DataFrame, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """key, k, place and gram of every rolling k-gram of each size; a text of fewer words has none."""

    def run(batches):
        makers = [Grams(k) for k in sizes]
        for batch in stretches(batches, 1):
            texts = [words_of(t.as_buffer().to_pybytes()) for t in batch.column(1)]
            for k, grams in zip(sizes, makers, strict=True):
                found = [grams.of(words) for words in texts]
                lengths = [len(x) for x in found]
                if not sum(lengths):
                    continue
                place = np.concatenate([np.arange(n, dtype=np.int64) for n in lengths])
                owner = pa.array(np.repeat(np.arange(len(lengths), dtype=np.int32), lengths))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(np.full(len(place), k, np.int64)), pa.array(place), pa.array(np.concatenate(found))], names=["key", "k", "place", "gram"])

    rows = docs.select(row_key(id_col, text_col).alias("key"), text_bytes(text_col).alias("text"))
    return rows.transform(mapped, run, "key binary, k long, place long, gram long")


def edits_allowed(m: int, least: float) -> int:
    return int((1 - least) * m + 1e-9)


def gram_size(m: int, least: float, most: int) -> int:
    """Words of a piece that any span within the edits allowed shares with a template of m words; `most` at most."""
    d = edits_allowed(m, least)
    return max(1, min(most, -(-(m - d) // (d + 1))))


def template_grams(spark, templates, most: int, least: float) -> tuple[DataFrame, int, list[int]]:
    """k, gram, template, at and need (the fewest votes that the edits allowed leave); how many; the sizes k."""
    rows, sizes = [], set()
    for number, (_, text) in enumerate(templates):
        words = words_of(text.encode())
        if not words:
            continue
        k = gram_size(len(words), least, most)
        sizes.add(k)
        found = Grams(k).of(words).tolist()
        need = max(1, len(found) - k * edits_allowed(len(words), least))
        rows += [(k, g, number, place, need) for place, g in enumerate(found)]
    return spark.createDataFrame(rows, "k long, gram long, template int, at long, need long"), len(rows), sorted(sizes)


def align(words: list[bytes], template: list[bytes], most: int) -> list[tuple[int, int, int]]:
    """Spans (edits, first, last word) of the words within `most` edits of the template, that don't overlap; fewest edits first."""
    unit, m = 1 << 32, len(template)
    ids = {w: i for i, w in enumerate(dict.fromkeys(template))}
    want = np.array([ids[w] for w in template])
    climb = np.arange(m + 1, dtype=np.int64) * unit
    # cost * unit less the first word: of equal costs the latest start, so the shortest span, is least
    cost, ends = climb.copy(), []
    for j, word in enumerate(words):
        now = np.empty(m + 1, np.int64)
        now[0] = -(j + 1)
        np.minimum(cost[1:] + unit, cost[:-1] + np.where(want == ids.get(word, -1), 0, unit), out=now[1:])
        cost = np.minimum.accumulate(now - climb) + climb
        edits = -(-int(cost[m]) // unit)
        if edits <= most:
            ends.append((edits, j - (edits * unit - int(cost[m])) + 1, edits * unit - int(cost[m]), j))
    out: list[tuple[int, int, int]] = []
    # A span starts and ends as the template's kinds say; of equal edits the longest, so that no end is left off.
    kinds = sorted(w for w in template if w in KINDS)
    for edits, _, first, last in sorted(ends, key=lambda e: (e[0], -e[1], e[2])):
        if all(last < f or first > e for _, f, e in out) and sorted(w for w in words[first : last + 1] if w in KINDS) == kinds:
            out.append((edits, first, last))
    return out


def matches(docs: DataFrame, templates=TEMPLATES, k: int = 5, drift: int = 3, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans: key, label, template, first and last place (words, last inclusive), similarity.

    similarity: 1 less the share of the template's words that are edited (inserted, missing or other words); spans
    under least are dropped, as are those whose KINDS differ. Grams have k words at most, fewer for short templates.
    Windows around diagonals at most drift, or the edits allowed, apart are aligned as one. Repeated rows count once.
    """
    index, size, sizes = template_grams(docs.sparkSession, templates, k, least)
    # The templates are a parameter of known size; a set too large to broadcast meets the grams in a shuffled join.
    hits = gram_rows(docs, sizes, id_col, text_col).join(checked_broadcast(index, size), ["k", "gram"])
    # One row for each diagonal, merged before it is exchanged.
    lines = hits.groupBy("key", "template", "need", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    voted = lines.groupBy("key", "template", "need").agg(F.collect_list("diagonal").alias("diagonals"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes")).where("votes >= need")
    found = materialize(voted.groupBy("key").agg(F.collect_list(F.struct("template", "diagonals")).alias("candidates")), small=True)
    parts = [(label, words_of(text.encode())) for label, text in templates]

    def run(batches):
        for batch in slices(batches, 128):
            out = []
            for key, text, candidates in zip(*(batch.column(i) for i in range(3)), strict=True):
                words, key = words_of(text.as_buffer().to_pybytes()), key.as_py()
                for c in candidates.as_py():
                    label, template = parts[c["template"]]
                    d = edits_allowed(len(template), least)
                    windows: list[list[int]] = []
                    for at in sorted(c["diagonals"]):
                        low, high = max(0, at - max(d, drift)), min(len(words), at + len(template) + max(d, drift))
                        if windows and low <= windows[-1][1]:
                            windows[-1][1] = high
                        else:
                            windows.append([low, high])
                    for low, high in windows:
                        out += [(key, label, c["template"], low + first, low + last, 1 - edits / len(template)) for edits, first, last in align(words[low:high], template, d)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()], strict=True)], names=["key", "label", "template", "first", "last", "similarity"])

    rows = docs.select(row_key(id_col, text_col).alias("key"), text_bytes(text_col).alias("text"))
    joined = rows.join(checked_broadcast(found), "key").select("key", "text", "candidates")
    return joined.transform(mapped, run, "key binary, label string, template int, first long, last long, similarity double").distinct()


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = 5, drift: int = 3, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    Null text is empty: no words, no labels. score is 1 if a phrase stands in the text, else the best similarity of
    a template's span, else 0. Repeated rows have equal results; an empty table gives no rows.
    """
    by = matches(docs, templates, k, drift, least, id_col, text_col).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("similarity").alias("best"), F.count("*").alias("n_spans"))
    joined = base_scan(docs, phrases, id_col, text_col).join(materialize(by).withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
    )
