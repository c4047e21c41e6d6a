"""Helpers that the corpus operators share: lineage cuts, checked broadcasts, Arrow slicing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of narrow rows (a key and a few numbers, under 200 bytes) that is broadcast.
BROADCAST_ROWS = 100_000
#: Shuffle partitions of a small result that are written as one file.
TOGETHER = 8
#: Bytes of an Arrow batch that is sent to Python (Spark's own default is 64 MB). A batch is held several times over,
#: on both sides, by every task of an executor.
ARROW_BYTES = 4 << 20
#: Bits of the largest filter of keys that is broadcast (32 MB), and those for each key: one of 16 other rows is let in.
FILTER_BITS, KEY_BITS = 1 << 28, 16
#: Bits of one row of bitmap_construct_agg.
MAP_BITS = 32768

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session (tests) gets one of its own."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(place or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir().get()


def materialize(df: DataFrame, small: bool = False) -> DataFrame:
    """df, computed once and written to the shared folder, so that a lost executor costs no recomputation.

    small: df has far fewer rows than the table it comes from (groups, keys, links), so TOGETHER shuffle partitions
    share a file; a folder of nearly empty files costs more than their rows. Row numbers drawn in df
    (monotonically_increasing_id, spark_partition_id) are fixed from here on.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if small:
        df = df.coalesce(max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // TOGETHER)))
    return df.checkpoint(eager=True)


def release() -> None:
    """Gives memory that Python no longer uses back to the system, where the C library can: workers wait between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(work):
    """A function for mapInArrow that releases its memory when a task ends."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return run


def mapped(df: DataFrame, work, schema: str) -> DataFrame:
    """df.mapInArrow(work, schema) with batches of at most ARROW_BYTES (or one longer row); memory is released after a task.

    The session's limit on a batch's bytes is lowered to that, as it is read when the plan runs; a lower one stays.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))
    return df.mapInArrow(released(work), schema)


def quoted(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in df.columns]


def scratch_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def checked_broadcast(small: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small with a broadcast hint if it has at most limit rows; else as it is, for a shuffled join.

    small should be materialized: it is counted here.
    """
    n = small.count() if rows is None else rows
    return F.broadcast(small) if n <= limit else small


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased and no other letter, unlike lower()."""
    return F.translate(column, UPPER, LOWER)


def text_bytes(name: str) -> Column:
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(quoted(name).cast("string").cast("binary"), F.lit(b"").cast("binary"))


def row_key(id_col: str, text_col: str) -> Column:
    """A digest of a row's id and text: the same for repeated rows, null and empty text alike."""
    head = F.coalesce(F.concat(F.lit("="), quoted(id_col).cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(head, F.lit("\n"), F.coalesce(quoted(text_col).cast("string"), F.lit(""))).cast("binary"), 256))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def key_filter(keys: DataFrame, place: Column) -> DataFrame:
    """The bits that the keys' places set: at (a row of MAP_BITS bits) and bits (binary). place counts from 0."""
    parts = keys.select(F.floor(place / MAP_BITS).alias("at"), (place % MAP_BITS).alias("bit"))
    return parts.groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits"))


def without(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """rows whose columns `names` are those of no row of keys (materialized; null equals null).

    Up to BROADCAST_ROWS keys are broadcast after a count. Of more, a filter of KEY_BITS bits a key is broadcast, so that most rows
    that stay are passed on where they are read, and only the others meet the keys in a shuffle. Beyond FILTER_BITS
    all rows do. The result is the same each way.
    """
    n = keys.count()
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in names]
    meet = lambda some, known: some.alias("r").join(known.alias("k"), same, "left_anti")
    if n <= BROADCAST_ROWS:
        return meet(rows, F.broadcast(keys))
    bits = KEY_BITS * n
    if bits > FILTER_BITS:
        return meet(rows, keys)
    place = F.pmod(F.xxhash64(*names), F.lit(bits))
    known = materialize(key_filter(keys, place), small=True)
    at, byte, found = free_name(rows, "at"), free_name(rows, "byte"), free_name(rows, "bits")
    marked = rows.withColumn(at, F.floor(place / MAP_BITS)).withColumn(byte, (place % MAP_BITS).cast("int"))
    marked = marked.join(F.broadcast(known.toDF(at, found)), at, "left")
    value = F.conv(F.hex(F.substring(found, F.floor(F.col(byte) / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(value, F.col(byte) % 8) == 1, F.lit(False))
    columns = columns_of(rows)
    return marked.where(~maybe).select(*columns).unionByName(meet(marked.where(maybe).select(*columns), keys))


def drop_keyed(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose row_key is in dropped (one binary column).

    Keys meet rows as in without(). A null id or text has a key like any other; rows that repeat have one key and go
    together. No rows, or no keys: docs as it is.
    """
    name = free_name(docs, "key")
    keys = materialize(dropped.toDF(name).distinct(), small=True)
    return without(docs.withColumn(name, row_key(id_col, text_col)), keys, [name]).select(*columns_of(docs))


def slices(batches, rows: int = 256):
    """Arrow batches in short slices, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def stretches(batches, column: int, most: int = 1 << 20):
    """Arrow batches in slices of about `most` bytes of the strings in a column, or of a longer one alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends, at = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def separators_to_space(keep) -> bytes:
    """A table for bytes.translate: A-Z to a-z, bytes that keep() refuses to a space."""
    return bytes(ord(" ") if not keep(b) else b + 32 if 65 <= b <= 90 else b for b in range(256))
