"""Quality rules: fixed limits, then robust multivariate outliers of each language and source.

A document's transformed statistics are a vector. For each group (language and source) the minimum covariance
determinant estimate is found over all its documents: from each of several starts, concentration steps take the
share of documents nearest by Mahalanobis distance and estimate anew from those; the start with the least determinant
after a few steps goes on until no determinant falls any more. A document too far from its group by it is rejected.
A group of few documents is judged by its language's estimate, a language of few by the whole corpus's.

Vectors are whole numbers (thousandths), so sums are exact and the same however Spark deals out the rows. Quantiles
of distances come from counts by logarithmic bucket; each bucket also holds its sums, so a step is one aggregation.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rulewright.llm.common import checked_broadcast, drop_keyed, mapped, materialize, quoted, row_key, slices, text_bytes

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
FEATURES = ["x0", "x1", "x2", "x3"]
P = len(FEATURES)
SYMBOLS = b"#*$%&|<>"
#: Lines and words without repeats that are added to each document's: one repeat in a short text is no large share.
MORE_LINES, MORE_WORDS = 4, 50


@dataclass(frozen=True)
class Robust:
    """How estimates are made.

    share: of a group's documents that an estimate is from. trial: concentration steps from every start, after which the
    one with the least determinant goes on. steps: in all at most; fewer if no determinant falls by a share of settle.
    tail: chance of a regular document beyond the limit. least: documents that a group needs for an estimate of its own.
    floors: standard deviations in thousandths added to each statistic's own, about what counting noise is in texts of
    50 words; each statistic alone can pass the limit.
    """

    share: float = 0.75
    trial: int = 2
    steps: int = 12
    settle: float = 1e-3
    tail: float = 1e-5
    least: int = 50
    floors: tuple[int, ...] = (60, 350, 50, 40)


#: Where concentration starts: a quantile of each statistic, and whether its spread is the quartiles' or just the floor.
STARTS = ((0.5, True), (0.5, False), (0.25, False), (0.75, False))


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    size = len(ids)
    pair = one[:-1] * size + one[1:]
    if size >= 2_000_000:  # the product of three would overflow
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:n] * size + one[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    mark = np.zeros(len(words), bool)
    mark[:n] |= again
    mark[1 : n + 1] |= again
    mark[2:] |= again
    return int(mark.sum())


def statistics(data: bytes) -> tuple[int, ...]:
    """COUNTS of a text's UTF-8 bytes."""
    words = data.split()
    joined = b"".join(words)
    chars = len(joined) - int(np.count_nonzero(np.frombuffer(joined, np.uint8) & 0xC0 == 0x80))
    lines = Counter(line for line in data.split(b"\n") if line and not line.isspace())
    full = sum(lines.values())
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), full - len(lines), repeated_words(words), full


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A narrow row per document: doc_id, key, lang, source, COUNTS, FEATURES, base_failed; materialized."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, 1024):
            columns = zip(*(statistics(t.as_buffer().to_pybytes()) for t in batch.column(4)), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "key", "lang", "source", *COUNTS])

    rows = docs.select(quoted(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), *[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))], text_bytes(text_col).alias("text"))
    counted = rows.transform(mapped, run, f"doc_id {kind}, key binary, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    words = F.greatest(F.col("n_words"), F.lit(1))
    vector = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.log1p(100 * F.col("n_symbols") / words),
        F.col("n_dup_lines") / (F.col("n_lines") + MORE_LINES),
        F.col("n_repeat_words") / (F.col("n_words") + MORE_WORDS),
    ]
    return materialize(counted.select("*", *[F.round(1000 * v).cast("long").alias(n) for v, n in zip(vector, FEATURES, strict=True)], failed.alias("base_failed")))


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution of even k."""
    term = total = 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(share: float, k: int, upper: bool = False) -> float:
    """Where the distribution has share below, or above if upper."""
    low, high = 0.0, 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        term = total = 1.0
        for i in range(1, k // 2):
            term *= mid / 2 / i
            total += term
        above = math.exp(-mid / 2) * total
        low, high = (mid, high) if (above > share if upper else 1 - above < share) else (low, mid)
    return low


PRODUCTS = [(i, j) for i in range(P) for j in range(i, P)]
CENTRES, SHAPES = [f"m{i}" for i in range(P)], [f"q{i}{j}" for i, j in PRODUCTS]
#: Of each group and start: the centre, the inverse covariance, the logarithm of its determinant, and that before.
MODEL = "g string, start int, " + ", ".join(f"{c} double" for c in CENTRES + SHAPES) + ", det double, before double"


def _distance() -> F.Column:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    terms = [(1 if i == j else 2) * F.col(f"q{i}{j}") * d[i] * d[j] for i in range(P) for j in range(i, P)]
    return sum(terms[1:], terms[0])


def placed(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """rows with g, the group whose estimate judges them; and g with FEATURES of each row that an estimate is from.

    g is language and source, the language alone where fewer than `least` documents share both, or "" for the whole
    corpus where those of the language are fewer too. An estimate is from all documents of its language or corpus.
    """
    both, alone, whole = F.concat_ws("\x1f", F.lit("both"), "lang", "source"), F.concat_ws("\x1f", F.lit("lang"), "lang"), F.lit("")
    sizes = materialize(rows.groupBy("lang", "source").agg(F.count("*").alias("n")), small=True)
    langs = sizes.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("all"))
    g = F.when(F.col("n") >= least, both).when(F.col("all") >= least, alone).otherwise(whole)
    places = materialize(sizes.join(langs, F.col("lang") == F.col("of")).select("lang", "source", g.alias("g")), small=True)
    n = places.count()
    judged = rows.join(checked_broadcast(places, n, 20_000), ["lang", "source"])
    needed = checked_broadcast(places.select("g").distinct(), n, 20_000)
    wide = places.where(~F.col("g").startswith("both")).isEmpty()
    levels = F.array(both) if wide else F.array(both, alone, whole)
    feed = rows.select(F.explode(levels).alias("g"), *FEATURES).join(needed, "g", "left_semi")
    return judged, feed


def start_model(rows: DataFrame, robust: Robust) -> DataFrame:
    """A MODEL of each group at each of STARTS, from quantiles of its statistics."""
    each = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(x).alias("x")) for i, x in enumerate(FEATURES)])).alias("e")).select("g", "e.*")
    # Distinct values of one statistic in one group: thousandths of a bounded range, however many rows there are.
    counts = each.groupBy("g", "i", "x").agg(F.count("*").alias("n"))
    place = W.partitionBy("g", "i")
    ranked = counts.withColumn("upto", F.sum("n").over(place.orderBy("x").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(place))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("x")))
    quart = ranked.groupBy("g", "i").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    floors = F.array(*[F.lit(float(f)) for f in robust.floors])[F.col("i")]
    width = (F.col("high") - F.col("low")) / 1.349
    centre = {0.25: "low", 0.5: "mid", 0.75: "high"}
    starts = F.array(*[F.struct(F.lit(k).alias("start"), F.col(centre[q]).cast("double").alias("m"), (1 / ((width * width if spread else 0) + floors * floors)).alias("q")) for k, (q, spread) in enumerate(STARTS)])
    sized = quart.select("g", "i", F.explode(starts).alias("s")).select("g", "i", "s.*")
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    shape = [(pick("q", i) if i == j else F.lit(0.0)).alias(f"q{i}{j}") for i, j in PRODUCTS]
    none = [F.lit(float("inf")).alias(c) for c in ("det", "before")]
    return sized.groupBy("g", "start").agg(*[pick("m", i).alias(f"m{i}") for i in range(P)], *shape, *none)


def concentrate(rows: DataFrame, model: DataFrame, robust: Robust) -> DataFrame:
    """The MODEL of the share of each group's documents nearest by the present one, start by start."""
    bucket = F.least(F.lit(4000), F.floor(100 * F.log1p(_distance()))).cast("int")
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PRODUCTS]
    sums = rows.join(model, "g").groupBy("g", "start", bucket.alias("bucket")).agg(F.max("det").alias("det"), F.count("*").alias("n"), *[F.sum(x).alias(x) for x in FEATURES], *products)
    place = W.partitionBy("g", "start")  # at most 4,001 buckets
    before = F.coalesce(F.sum("n").over(place.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = sums.withColumn("earlier", before).withColumn("all", F.sum("n").over(place)).where(F.col("earlier") < robust.share * F.col("all"))
    taken = near.groupBy("g", "start").agg(F.max("det").alias("before"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in FEATURES + [f"s{i}{j}" for i, j in PRODUCTS]])
    quantile = chi2_quantile(robust.share, P)
    consistent = robust.share / chi2_cdf(quantile, P + 2)

    def invert(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mean = np.array([r[x] / r["n"] for x in FEATURES])
                cov = np.zeros((P, P))
                for i, j in PRODUCTS:
                    cov[i, j] = cov[j, i] = r[f"s{i}{j}"] / r["n"] - mean[i] * mean[j]
                cov = cov * consistent + np.diag(np.square(np.array(robust.floors, float)))
                inverse = np.linalg.inv(cov)
                out.append((r["g"], r["start"], *mean.tolist(), *(float(inverse[i, j]) for i, j in PRODUCTS), float(np.linalg.slogdet(cov)[1]), r["before"]))
            if out:
                types = [pa.string(), pa.int32()] + [pa.float64()] * (len(out[0]) - 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["g", "start", *CENTRES, *SHAPES, "det", "before"])

    return taken.transform(mapped, invert, MODEL)


def fit(rows: DataFrame, robust: Robust) -> DataFrame:
    """The estimate of each group of rows (columns g and FEATURES): of the start with the least determinant; materialized."""
    model = materialize(start_model(rows, robust), small=True)
    n = model.count()
    for k in range(robust.steps):
        model = concentrate(rows, checked_broadcast(model, n, 20_000), robust)
        if k + 1 == min(robust.trial, robust.steps):
            least = F.min_by(F.struct("start", *CENTRES, *SHAPES, "det", "before"), F.struct("det", "start")).alias("e")
            model = model.groupBy("g").agg(least).select("g", "e.*")
        model = materialize(model, small=True)
        if k + 1 > robust.trial and model.where(F.col("det") < F.col("before") - robust.settle).isEmpty():
            break
    return model


def judge(docs: DataFrame, robust: Robust = Robust(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, key, COUNTS, base_failed, distance (null if base_failed), kept.

    Null text has no words and fails. A null language or source counts as an empty one. Estimates are from documents
    that don't fail; those of groups too small for one are judged by their language's, or the corpus's. Repeated rows
    count each and have equal results. An empty table gives no rows; other columns are ignored.
    """
    rows = document_statistics(docs, id_col, text_col, lang_col, source_col)
    judged, feed = placed(rows.where(~F.col("base_failed")), robust.least)
    model = fit(feed, robust)
    limit = chi2_quantile(robust.tail, P, upper=True)
    far = judged.join(checked_broadcast(model, limit=20_000), "g").withColumn("distance", _distance())
    names = ["doc_id", "key", *COUNTS, "base_failed"]
    kept = far.select(*names, "distance", (F.col("distance") <= limit).alias("kept"))
    return kept.unionByName(rows.where("base_failed").select(*names, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))


def drop_rejected(docs: DataFrame, robust: Robust = Robust(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs without the rows that judge() rejects; all columns kept. Null and empty texts go; an empty table stays empty."""
    return drop_keyed(docs, judge(docs, robust, id_col, text_col, lang_col, source_col).where("not kept").select("key"), id_col, text_col)
