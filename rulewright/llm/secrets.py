"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found by regular expressions in every whole text. Their hashes are then counted over the corpus by
distinct repositories and owners: a value that many owners hold, or very many repositories, is a widely copied example
(documentation, a test fixture); one that few owners hold looks like a live credential of theirs. Base kinds keep their spans either way;
further kinds, less certain by themselves, are reported only where ownership says that they look live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rulewright.llm.common import checked_broadcast, free_name, materialize, quoted, row_key


@dataclass(frozen=True)
class Kind:
    """A kind of secret: a Java regular expression with its value in `group`; either the match or the value has a least length."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    least_group: int = 0
    base: bool = False


ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: In the order of spans that start together. Values that are fixed: the three base patterns.
KINDS = (
    Kind("assign", ASSIGN, 1, 6, 1, base=True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, 0, base=True),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, 0, base=True),
    Kind("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, 0),
    Kind("web", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29, 0),
    # Up to the END line, without which nothing tells a key from the prose after it.
    Kind("private", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,20000}+-----END [A-Z ]{0,30}PRIVATE KEY-----", 0, 64, 0),
)
MASK = "<secret>"


def _found(text: Column, kind: Kind, order: int) -> Column:
    """Each match in order: kind, place in the list, characters before it since the last, its length, value's hash (null if too short)."""
    pattern = F.lit(kind.pattern)
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, kind.pattern, -1)
    values = F.regexp_extract_all(text, pattern, F.lit(kind.group)) if kind.group else found
    measured = found if kind.least_group == 0 else values
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), values.alias("value"), measured.alias("sized")),
        lambda x: F.struct(
            F.lit(order).alias("kind"),
            F.char_length(x["gap"]).alias("gap"),
            F.char_length(x["hit"]).alias("size"),
            F.when(F.char_length(x["sized"]) >= kind.least, F.xxhash64(F.lit(kind.name), x["value"])).alias("hash"),
        ),
    )
    numbered = F.transform(rows, lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["hash"].alias("hash")))
    return F.when(F.regexp(text, pattern), numbered).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,hash:bigint>>"))


def candidates(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, id_col: str = "doc_id", text_col: str = "text", owner_cols: tuple[str, ...] = ()) -> DataFrame:
    """A narrow row per document: doc_id, key (of id and text), owner columns, found; materialized, so texts are scanned once."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    found = F.concat(*[_found(F.col("text"), k, i) for i, k in enumerate(kinds)])
    owners = [F.coalesce((quoted(c) if isinstance(c, str) else c).cast("string"), F.lit("")).alias(f"owner{i}") for i, c in enumerate(owner_cols)]
    rows = docs.select(quoted(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), *owners, text.alias("text"))
    return materialize(rows.select("doc_id", "key", *[f"owner{i}" for i in range(len(owner_cols))], found.alias("found")))


def spans(rows: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """key, kind, start, stop (code points, end exclusive) and hash of each candidate of the distinct documents of rows."""
    some = rows.where(F.size("found") > 0).groupBy("key").agg(F.first("found").alias("found"))
    each = some.select("key", F.explode("found").alias("x")).select("key", "x.*")
    upto = W.partitionBy("key", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    placed = each.withColumn("stop", F.sum(F.col("gap").cast("long") + F.col("size")).over(upto))
    return placed.where(F.col("hash").isNotNull()).select("key", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop", "hash")


def ownership(rows: DataFrame) -> DataFrame:
    """hash, repositories and owners: in how many distinct ones of each a candidate's value occurs."""
    each = rows.where(F.size("found") > 0).select("owner0", "owner1", F.explode("found.hash").alias("hash")).where("hash is not null")
    # Distinct within each task before anything is exchanged, so a value copied everywhere stays small.
    repos = each.select("hash", "owner0").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    owners = each.select("hash", "owner1").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    return repos.join(owners, "hash")


@dataclass(frozen=True)
class Owners:
    """Where a document's repository and owner stand, and how many distinct ones a live-looking value has at most.

    A table of documents alone has no repositories: each document then counts as one (repository=None), its source owns it.
    """

    repository: str | None = None
    owner: str = "source"
    most_owners: int = 3
    most_repositories: int = 100


def scan(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, owners: Owners = Owners(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_<kind> of each base kind, base_sha256, spans, n_live, n_shared.

    Null text is empty: no spans. A null repository or owner is one of its own. A candidate looks live if its value is
    in no more owners and repositories than Owners allows; n_live and n_shared count all candidates by that. Repeated
    rows have equal results and don't raise ownership. Other columns are ignored; an empty table gives no rows.
    """
    rows, marks = _marked(docs, kinds, owners, id_col, text_col)
    names = F.array(*[F.lit(k.name) for k in kinds])
    base = F.col("kind") < sum(k.base for k in kinds)
    said = F.struct("start", "kind", F.concat_ws(":", names[F.col("kind")], "start", "stop").alias("said"))
    # The spans of one document make one row by contract; nothing else is gathered.
    summary = marks.groupBy("key").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k.name}") for i, k in enumerate(kinds) if k.base],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(base, said))), lambda x: x["said"]), ",").alias("base"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(base | F.col("live"), said))), lambda x: x["said"]), ",").alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_shared"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("doc_id", "key").join(summary, "key", "left").select(
        "doc_id", *[zero(f"n_{k.name}") for k in kinds if k.base], F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_shared")
    )


def _marked(docs, kinds, owners, id_col, text_col) -> tuple[DataFrame, DataFrame]:
    rows = candidates(docs, kinds, id_col, text_col, (owners.repository or id_col, owners.owner))
    live = (F.col("owners") <= owners.most_owners) & (F.col("repositories") <= owners.most_repositories)
    known = materialize(ownership(rows).select("hash", live.alias("live")), small=True)
    # Both sides are plain tables, so Spark can split the rows of a value that many documents hold.
    return rows, materialize(spans(rows, kinds), small=True).join(checked_broadcast(known), "hash")


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, owners: Owners = Owners(), id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", mask: str = MASK) -> DataFrame:
    """docs with every reported span replaced by mask, all rows and columns kept; length_col follows the text.

    Spans that overlap or touch are replaced as one. Rows without spans pass as they are, null text included; rows
    that repeat are each replaced alike. An empty table stays empty.
    """
    rows, marks = _marked(docs, kinds, owners, id_col, text_col)
    told = marks.where((F.col("kind") < sum(k.base for k in kinds)) | F.col("live"))
    before = W.partitionBy("key").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("key").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, 0)
    apart = told.withColumn("far", F.max("stop").over(before)).withColumn("new", (F.col("far").isNull() | (F.col("start") > F.col("far"))).cast("long"))
    merged = apart.withColumn("part", F.sum("new").over(upto)).groupBy("key", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    # The stretch of text before each masked span, then the rest after the last.
    since = F.coalesce(F.lag("stop").over(W.partitionBy("key").orderBy("part")), F.lit(0).cast("long"))
    cuts = merged.withColumn("since", since).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "since"))).alias("cuts"), F.max("stop").alias("rest"))
    key, cut, rest = free_name(docs, "key"), free_name(docs, "cuts"), free_name(docs, "rest")
    cuts = materialize(cuts.toDF(key, cut, rest), small=True)
    places = cuts.agg(F.sum(F.size(cut) + 1)).first()[0] or 0  # a document may have very many
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(checked_broadcast(cuts, places), key, "left")
    whole = quoted(text_col)
    piece = F.transform(F.col(cut), lambda x: F.concat(F.substring(whole, (x["since"] + 1).cast("int"), (x["start"] - x["since"]).cast("int")), F.lit(mask)))
    new = F.when(F.col(cut).isNull(), whole).otherwise(F.concat(F.array_join(piece, ""), F.substring(whole, (F.col(rest) + 1).cast("int"), F.lit(2**31 - 1))))
    changed, marked = free_name(docs, "text"), F.col(cut).isNotNull()
    out = joined.withColumn(changed, new)
    size = lambda c: F.when(marked, F.char_length(changed).cast(docs.schema[c].dataType)).otherwise(quoted(c))
    return out.select(*[F.col(changed).alias(c) if c == text_col else size(c).alias(c) if c == length_col else quoted(c) for c in docs.columns])
