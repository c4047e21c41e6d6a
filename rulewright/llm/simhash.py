"""SimHash near-duplicates by covering locality-sensitive hashing.

Two fingerprints at most `radius` bits apart collide in at least one of 2^(radius+1)-1 tables: each bit gets a
non-zero vector of radius+1 bits, and table v compares the bits whose vector has an odd product with v. Some v is
orthogonal to the vectors of any `radius` bits, so table v ignores just the bits that differ. No pair is missed.

Only distinct fingerprints enter the tables, so exact copies cost one row. Within a bucket a breadth-first search
compares each fingerprint with those not yet reached, and gives one link for each that it reaches; never all pairs.

A fingerprint may have two words of 64 bits, each with tables of its own; a link then needs one word within the radius
and both together within `total` bits. All pairs within 2*radius+1 bits together are found, and chance meets are not.

drop_near_duplicates takes its candidates from the same tables, over fingerprints of shingle sets, and verifies each by
the shingles. At a Jaccard index of 0.8 fingerprints differ by more bits than tables can cover; bands of least hashes add
the pairs that are out of their reach, and leave out none that the tables find.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rulewright.llm.common import checked_broadcast, drop_keyed, mapped, materialize, quoted, row_key, separators_to_space, slices, text_bytes

BITS = 64
#: A bucket with more distinct fingerprints is dealt out to more tasks.
BUCKET = 20_000
#: Bits of each byte value, lowest first.
BIT_TABLE = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def folded(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint of shingle hashes (uint64): a bit is 1 if set in over half of them. None: zero."""
    octets = hashes.view(np.uint8).reshape(len(hashes), 8)  # little-endian: octet 0 has bits 0 to 7
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BIT_TABLE for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def simhash(data: bytes, shingle: int, seeds: tuple[int, ...] = (42,), table: bytes = separators_to_space(lambda b: True)) -> list[int]:
    """The signed 64-bit fingerprint of a text's UTF-8 bytes, for each seed."""
    import xxhash

    words = data.translate(table).split()
    if not words:
        return [0] * len(seeds)
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return [folded(np.array([digest(p, seed) for p in parts], np.uint64)) for seed in seeds]


def fingerprints(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (42,), id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """doc_id and fp0, fp1, ... (signed longs) of each row, by whole texts; materialized. Null text has no words: zero."""
    names = [f"fp{i}" for i in range(len(seeds))]

    def run(batches):
        for batch in slices(batches, 1024):
            values = zip(*(simhash(t.as_buffer().to_pybytes(), shingle, seeds) for t in batch.column(1)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in values), *batch.columns[2:]], names=["doc_id", *names, *(["key"] if with_key else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    extra = [row_key(id_col, text_col).alias("key")] if with_key else []
    rows = docs.select(quoted(id_col).alias("doc_id"), text_bytes(text_col).alias("text"), *extra)
    return materialize(rows.transform(mapped, run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", key binary" * with_key))


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """A mask for each table, as signed 64-bit numbers."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, size)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _chunks(mask: int, parts: int) -> list[int]:
    """mask with one of `parts` stretches of the bits that it ignores added, for each."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    out = [(mask & (1 << 64) - 1) | sum(1 << i for i in free[k::parts]) for k in range(parts)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _reach(fps: np.ndarray, nodes: np.ndarray, word: int, radius: int, total: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in a bucket: fps has a row for each of the nodes and a column for each word."""
    out: list[tuple[int, int]] = []
    rest = np.arange(1, len(nodes))
    queue = [0]
    while queue or len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        at = queue.pop()
        apart = np.bitwise_count((fps[rest] ^ fps[at]).view(np.uint64))
        near = (apart[:, word] <= radius) & (apart.sum(1) <= total)
        if near.any():
            found = rest[near].tolist()
            out += [(int(nodes[at]), int(nodes[k])) for k in found]
            queue += found
            rest = rest[~near]
    return out


def forest(pairs) -> list[tuple]:
    """Those of the pairs that join two parts not joined by earlier ones."""
    root: dict = {}

    def find(x):
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = root[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def links(classes: DataFrame, radius: int = 2, words: int = 1, total: int | None = None) -> DataFrame:
    """Links (a, b) between nodes of classes (node, fp0, ...; distinct) that connect just what all links connect."""
    if not 0 <= radius <= 6:
        raise ValueError("radius must be between 0 and 6: there are 2^(radius+1)-1 tables for a word")
    masks, names = covering_masks(radius), [f"fp{w}" for w in range(words)]
    total = radius if total is None else total
    tables = F.array(*[F.struct(F.lit(w * len(masks) + v).alias("v"), F.col(f"fp{w}").bitwiseAND(F.lit(m)).alias("bucket")) for w in range(words) for v, m in enumerate(masks)])
    keyed = classes.select("node", *names, F.explode(tables).alias("t")).select("t.v", "t.bucket", "node", *names)
    # Distinct fingerprints only: a bucket's size is bounded by the bits that its mask ignores, not by the rows.
    crowd = materialize(keyed.withColumn("n", F.count("*").over(W.partitionBy("v", "bucket"))).where("n > 1"))
    # Of radius+1 stretches of the ignored bits, two within the radius agree on one: large buckets are dealt out by those.
    chunks = [_chunks(m, radius + 1) for m in masks]
    choice = F.array(*[F.array(*[F.lit(c) for c in row]) for row in chunks])
    word = F.element_at(F.array(*names), F.floor(F.col("v") / len(masks)).cast("int") + 1)
    large = crowd.where(F.col("n") > BUCKET).select("v", F.posexplode(choice[F.col("v") % len(masks)]).alias("k", "m"), word.alias("w"), "node", *names)
    dealt = crowd.where(F.col("n") <= BUCKET).select("v", F.lit(-1).alias("k"), "bucket", "node", *names).unionByName(large.select("v", "k", F.col("w").bitwiseAND(F.col("m")).alias("bucket"), "node", *names))

    def search(batches):
        def table(pairs):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])

        at, held, out = None, [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4 + words)]
            for v, k, bucket, *row in zip(*columns, strict=True):
                if (v, k, bucket) != at:
                    if len(held) > 1:
                        both = np.array(held, np.int64)
                        out += _reach(both[:, 1:], both[:, 0], at[0] // len(masks), radius, total)
                    held, at = [], (v, k, bucket)
                held.append(row)
            if out:
                yield table(out)
                out = []
        if len(held) > 1:
            both = np.array(held, np.int64)
            out = _reach(both[:, 1:], both[:, 0], at[0] // len(masks), radius, total)
            if out:
                yield table(out)

    return dealt.repartition("v", "k", "bucket").sortWithinPartitions("v", "k", "bucket", "node").transform(mapped, search, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node and root (the least node that it reaches) for each end of the edges (a, b: long). No edges: no rows.

    Large-star and small-star rounds on Spark, each written out; parts are joined within tasks first. The least
    neighbours are written before nodes with very many are joined to them, so that their rows can be split.
    """

    def merge(batches):
        kept = forest((a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept, strict=True)], names=["a", "b"])

    now = materialize(edges.where("a != b").transform(mapped, merge, "a long, b long"), small=True)
    mark = None
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), small=True)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))  # here a > b always, so that no a has very many rows
        small = large.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"), F.col("a").alias("z"))
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("z").alias("a"), F.col("y").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        now = materialize(small, small=True)
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if seen == mark:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(now.select(F.col("b"), F.col("b"))).distinct()
        mark = seen
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, seeds: tuple[int, ...] = (42,), total: int | None = None, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits a word), component_id (least doc_id reachable).

    Words are runs without ASCII white space, A-Z lower-cased; fewer words than a shingle make one shingle; without
    words (null, empty) the fingerprint is zero, linked like any other. Repeated rows share a component. Null ids
    are passed over for component_id, which is null if no member has one. An empty table gives no rows.
    with_key adds row_key, by which the verdict meets the whole row again. Other columns are ignored.
    """
    names = [f"fp{i}" for i in range(len(seeds))]
    rows = fingerprints(docs, shingle, seeds, id_col, text_col, with_key)
    classes = materialize(rows.groupBy(*names).agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    roots = components(links(classes.select("node", *names), radius, len(seeds), total))
    linked = roots.join(classes, "node").select(*names, "root", "least")
    merged = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(*names, "component_id")
    # Written first: the last join is one of plain tables, so that the rows of a hot fingerprint can be split.
    every = materialize(classes.join(merged, names, "left").select(*names, F.coalesce("component_id", "least").alias("component_id")))
    shown = F.concat(*[F.lower(F.lpad(F.hex(n), 16, "0")) for n in names])
    return rows.join(every, names).select("doc_id", shown.alias("fingerprint"), "component_id", *(["key"] if with_key else []))


def shingle_set(data: bytes, shingle: int, table: bytes = separators_to_space(lambda b: True)) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted; none without words. Fewer words make one shingle."""
    import xxhash

    words = data.translate(table).split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64))


#: Equal least hashes of all a band's orders make two sets candidates: at a Jaccard index of 0.8 a pair has no equal
#: band in 3 of a million cases ((1 - 0.8^5)^32), at 0.85 and more in less than one of ten million.
BANDS, ORDERS = 32, 5
_DRAWN = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ORDERS), np.uint64)
#: Candidates of one bucket that are compared by one task; larger buckets are dealt out.
CROWD = 500


def bands_of(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit number for each band, from the least hashes of a set under ORDERS orders; none of an empty set."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(BANDS * ORDERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        mixed = (hashes[at : at + 512, None] ^ _DRAWN[0]) * (_DRAWN[1] << np.uint64(1) | np.uint64(1))
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, mixed.min(0), out=least)
    found = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ORDERS))]
    return np.array(found, np.uint64).view(np.int64).tolist()


def banded(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, digest of the shingle set, its fingerprint and its bands; materialized."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, 256):
            sets = [shingle_set(t.as_buffer().to_pybytes(), shingle) for t in batch.column(2)]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array([folded(s) for s in sets], pa.int64()), pa.array([bands_of(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "key", "digest", "fp", "bands"])

    rows = docs.select(quoted(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), text_bytes(text_col).alias("text"))
    return materialize(rows.transform(mapped, run, f"doc_id {kind}, key binary, digest binary, fp long, bands array<long>"))


def candidate_buckets(classes: DataFrame, radius: int) -> DataFrame:
    """node and bucket of classes (node, fp, bands): one for each covering table of the fingerprint, and the bands.

    Two nodes whose fingerprints are at most `radius` bits apart share a bucket, whatever their bands. Sets without
    shingles have no bands and get no bucket.
    """
    masks = F.array(*[F.lit(m) for m in covering_masks(radius)])
    tables = F.transform(masks, lambda mask, v: F.xxhash64(v, F.col("fp").bitwiseAND(mask)))  # numbered: tables don't meet
    return classes.where(F.size("bands") > 0).select("node", F.explode(F.concat(tables, "bands")).alias("bucket"))  # a band's number is in its hash


def similar_links(least: float):
    """A function for mapInArrow over rows (gid, part, node, set; sorted): a spanning forest of the similar pairs of each part."""

    def reach(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        sizes = np.array([len(s) for s in sets])
        place = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        mark, rest, queue, out = np.zeros(int(place.max()) + 1, bool), np.arange(1, len(nodes)), [0], []
        while len(rest):
            if not queue:
                queue, rest = [int(rest[0])], rest[1:]
                continue
            at = queue.pop()
            own = place[starts[at] : starts[at + 1]]
            mark[own] = True
            common = np.add.reduceat(mark[place], starts[:-1], dtype=np.int64)[rest]
            mark[own] = False
            near = common >= least * (sizes[rest] + sizes[at] - common) - 1e-9
            found = rest[near].tolist()
            out += [(nodes[at], nodes[k]) for k in found]
            queue += found
            rest = rest[~near]
        return out

    def run(batches):
        at, nodes, sets = None, [], []

        def table():
            pairs = reach(nodes, sets) if len(nodes) > 1 else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])

        for batch in batches:
            for gid, part, node, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                key = gid.as_py(), part.as_py()
                if key != at:
                    yield from table()
                    at, nodes, sets = key, [], []
                nodes.append(node.as_py())
                sets.append(np.frombuffer(data.as_buffer(), np.uint64).copy())
        yield from table()

    return run


def jaccard_links(docs: DataFrame, classes: DataFrame, shingle: int, least: float, radius: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between nodes of classes (node, key of one document, fp, bands) that connect what pairs at `least` connect.

    Candidates share a covering table's bucket or a band; each is verified by the shingles themselves. Buckets of the
    same members count once.
    A bucket over CROWD is dealt out in parts: first each part with part 0, which joins most; if that leaves its
    members unconnected, every two parts meet. No candidate pair is left out and no task holds more than two parts.
    """
    keyed = candidate_buckets(classes, radius)
    # Counted within each task before anything is sent, so a bucket that very many share stays small. Most have one member.
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mark")).where("n > 1")
    buckets = materialize(sizes.groupBy("n", "mark").agg(F.min("bucket").alias("bucket")).select("bucket", "n", F.monotonically_increasing_id().alias("gid")), small=True)
    members = materialize(keyed.join(checked_broadcast(buckets), "bucket").select("gid", "n", "node"), small=True)
    owners = materialize(members.select("node").distinct().join(classes.select("node", "key"), "node"), small=True)

    def run(batches):
        for batch in slices(batches, 256):
            sets = [shingle_set(t.as_buffer().to_pybytes(), shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    texts = docs.select(row_key(id_col, text_col).alias("key"), text_bytes(text_col).alias("text")).join(checked_broadcast(owners), "key").select("node", "text")
    # Repeated rows have the same key: one of them is enough.
    sets = materialize(texts.transform(mapped, run, "node long, set binary").dropDuplicates(["node"]))

    def verify(parts: DataFrame) -> DataFrame:
        full = parts.join(sets, "node").select("gid", "part", "node", "set")
        return materialize(full.repartition("gid", "part").sortWithinPartitions("gid", "part", "node").transform(mapped, similar_links(least), "a long, b long"), small=True)

    small = members.where(F.col("n") <= CROWD).select("gid", F.lit("").alias("part"), "node")
    count = F.ceil(F.col("n") / CROWD).cast("int")
    large = members.where(F.col("n") > CROWD).withColumn("count", count).withColumn("c", F.pmod(F.xxhash64("node"), F.col("count")).cast("int"))
    if large.isEmpty():
        return verify(small)
    with_first = F.when(F.col("c") == 0, F.expr("transform(sequence(1, count - 1), x -> concat('0 ', x))")).otherwise(F.array(F.concat(F.lit("0 "), F.col("c"))))
    found = verify(small.unionByName(large.select("gid", F.explode(with_first).alias("part"), "node")))
    roots = components(found)
    rooted = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = rooted.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("gid")
    rest = materialize(rooted.where("c > 0 and count > 2").join(open_, "gid", "left_semi").select("gid", "c", "count", "node"), small=True)
    if rest.isEmpty():
        return found
    pairs = F.expr("transform(filter(sequence(1, count - 1), x -> x != c), x -> concat(least(x, c), ' ', greatest(x, c)))")
    return found.unionByName(verify(rest.select("gid", F.explode(pairs).alias("part"), "node")))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the least doc_id; all columns kept.

    Documents are linked if the Jaccard index of their sets of shingles is at least `least` (0.8 or more). Candidates are
    those within `radius` bits by covering tables of the sets' fingerprints, and those that share a band. Words and
    short, empty or null texts are as in near_duplicates. Of repeated ids with different texts one stays, by row_key;
    a row without an id stays only where no other is in its component. Rows that repeat the one that stays in both id
    and text all stay. An empty table stays empty.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("least must be between 0.8 and 1: the bands miss pairs that are less similar")
    if not 0 <= radius <= 6:
        raise ValueError("radius must be between 0 and 6: there are 2^(radius+1)-1 tables")
    rows = banded(docs, shingle, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("least")
    grouped = rows.groupBy("digest").agg(first, F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = materialize(grouped.select("digest", "least", "least.key", "fp", "bands", F.monotonically_increasing_id().alias("node")))
    roots = components(jaccard_links(docs, classes, shingle, least, radius, id_col, text_col))
    linked = roots.join(classes.select("node", "digest", "least"), "node")
    merged = linked.join(linked.groupBy("root").agg(F.min("least").alias("best")), "root").select("digest", "best")
    every = materialize(classes.select("digest", "least").join(merged, "digest", "left").select("digest", F.coalesce("best", "least")["key"].alias("stays")))
    lost = rows.select("key", "digest").join(every, "digest").where("key != stays").select("key")
    return drop_keyed(docs, lost, id_col, text_col)
