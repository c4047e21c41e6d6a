"""Exact deduplication: a tree merge of sorted digest runs, in DataFrame operations only.

Each input partition is a run: sorted and merged by digest before anything is exchanged (the map side of a sorted
aggregation). In round r the runs of fan_in neighbouring blocks exchange rows by digest and are merged, so that
after ceil(log(runs, fan_in)) rounds one block is left. However many copies a text has, a merge gets at most fan_in rows
of it from a level and passes one on. A row stands for equal texts only if SHA-256, byte length and a second hash
all agree; that is part of the key at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import checked_broadcast, columns_of, free_name, materialize, quoted, text_bytes, without

KEY = ["digest", "n_bytes", "witness"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A narrow row per document: doc_id, a row number, its run and the key of its text; materialized."""
    text = text_bytes(text_col)
    # Two steps, so that row and run are taken once each row's place is settled by the scan.
    key = [F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("witness")]
    place = [F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row")]
    return materialize(docs.select(quoted(id_col).alias("doc_id"), *key, *place))


def tree_merge(rows: DataFrame, runs: int, fan_in: int = 16, keep: str = "largest") -> DataFrame:
    """For each text the row that stays and how many rows have it: KEY, top (doc_id, row), n."""
    best = F.max if keep == "largest" else F.min
    level = rows.select("run", *KEY, F.struct("doc_id", "row").alias("top"), F.lit(1).cast("long").alias("n"))
    blocks = max(1, runs)
    while True:
        blocks = -(-blocks // fan_in)
        block = F.floor(F.col("run") / fan_in).cast("int") if blocks > 1 else F.lit(0)
        # A struct's maximum is aggregated over sorted rows: each task sorts and merges what it has before it sends it.
        level = level.groupBy(block.alias("run"), *KEY).agg(best("top").alias("top"), F.sum("n").alias("n"))
        if blocks == 1:
            return level.drop("run")


def exact_duplicates(docs: DataFrame, fan_in: int = 16, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical; null counts as empty. Of equal texts the row with the largest doc_id stays (with
    keep="smallest" the smallest); of repeated ids the last row, so that one row of each text stays. A null doc_id
    is below all others. An empty table gives no rows. Other columns are ignored.
    """
    rows = digests(docs, id_col, text_col)
    runs = 1 + (rows.agg(F.max("run")).first()[0] or 0)
    # Written first: both sides of the join are then plain tables, so that a hot text's rows can be split between tasks.
    groups = materialize(tree_merge(rows, runs, fan_in, keep).where("n > 1"), small=True)
    joined = rows.join(groups, KEY, "left")
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("top.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, fan_in: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, all columns kept: the row with the largest doc_id, any one of repeated ids.

    Only narrow rows take part in the search for copies; the dropped keys then meet the whole rows. Null texts are
    copies of the empty one; a row without an id goes before any that has one. An empty table stays empty.
    """
    sha, ident, tie = free_name(docs, "key"), free_name(docs, "id"), free_name(docs, "tie")
    verdict = exact_duplicates(docs, fan_in, id_col=id_col, text_col=text_col).where("group_size > 1")
    keys = verdict.select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha"), "kept")
    repeated = materialize(keys.groupBy("id", "sha").agg(F.count("*").alias("n"), F.max("kept").alias("stays")).where("n > 1 or not stays"), small=True)
    lost, tied = (repeated.where(c).select(F.col("id").alias(ident), F.col("sha").alias(sha)) for c in ("not stays", "stays"))
    keyed = docs.withColumn(sha, F.unhex(F.sha2(text_bytes(text_col), 256))).withColumn(ident, quoted(id_col))
    out = without(keyed, lost, [ident, sha])
    if tied.isEmpty():
        return out.select(*columns_of(docs))
    marks = checked_broadcast(tied.withColumn(tie, F.lit(True)))
    same = F.col(f"d.{sha}").eqNullSafe(F.col(f"l.{sha}")) & F.col(f"d.{ident}").eqNullSafe(F.col(f"l.{ident}"))
    marked = out.alias("d").join(marks.alias("l"), same, "left").select(*[F.col(f"d.`{c.replace('`', '``')}`") for c in [*docs.columns, ident, sha]], F.col(tie))
    # Rows that repeat both id and text, of which any one stays; each task sends one of each.
    once = marked.where(F.col(tie)).dropDuplicates([ident, sha])
    return marked.where(F.col(tie).isNull()).select(*columns_of(docs)).unionByName(once.select(*columns_of(docs)))
