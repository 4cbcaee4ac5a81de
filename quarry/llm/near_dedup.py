"""Near-duplicate documents by MinHash: one permutation, optimal densification, banded buckets, star-shaped candidates.

1. A document's set of two-word shingles gets an id; documents of one set (all copies) are one class. One hash of each
   shingle deals it to one of BANDS * ROWS bins, and each bin keeps its least value. An empty bin takes the value of the first
   filled one among bins that a hash of (bin, attempt) names, so every bin agrees with probability of the similarity.
2. Each band of ROWS bins names a bucket. A bucket's candidates are a star: its least set with each of the others. Stars
   that sizes or signatures rule out go; the rest are verified on the full sets, a centre's members dealt to many tasks.
3. Verified links connect sets to components. In most buckets all sets are of one component by then. Where some aren't, these
   *open* ones are compared with the rest of the bucket by signature, in blocks; pairs that may be links are chained to
   groups, in which all pairs are verified. So every pair that shares a bucket is verified, connected or ruled out, and pairs of a
   bucket are never rows.

A pair at the threshold shares a bucket with probability 1 - (1 - 0.8**6)**32 = 0.99994.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import storage
from quarry.llm.common import blocks, bounded_batches, join_heavy, materialise, mix, partitions, tidied
from quarry.llm.graph import components
from quarry.llm.jaccard_join import linked_in_groups, lowered, set_ids, shingle_sets, shingles_of

WORDS, BANDS, ROWS = 2, 32, 6
#: A pair is linked where 100 * shared >= PERCENT * all.
PERCENT = 80
#: Members of a star, and sets of a bucket, that one task compares at a time.
STAR, OPEN = 256, 512
#: A signature rules a pair out where it lies so many deviations below the threshold.
DEVIATIONS = 6.0


def densified(shingles: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """The bins' least values of each non-empty set, empty bins filled; rows of zeros for empty sets."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets)).astype(np.uint64)
    place = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    keyed = np.sort((owner * np.uint64(bins) + place) << np.uint64(32) | (shingles & np.uint64(0xFFFFFFFF)))
    cell = (keyed >> np.uint64(32)).astype(np.int64)
    first = np.r_[True, cell[1:] != cell[:-1]][: len(cell)]
    out, filled = np.zeros(n * bins, np.uint32), np.zeros(n * bins, bool)
    out[cell[first]] = (keyed[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    filled[cell[first]] = True
    has = np.diff(offsets) > 0
    left = np.flatnonzero(~filled & np.repeat(has, bins))
    attempt, bin_ = 0, left % bins
    while len(left):
        attempt += 1
        if attempt > 64 * bins:  # never seen; the next filled bin stands in
            raise AssertionError("a bin found no filled one")
        asked = left - bin_ + (mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B1) + np.uint64(attempt << 20)) % np.uint64(bins)).astype(np.int64)[bin_]
        got = filled[asked]
        out[left[got]] = out[asked[got]]
        left, bin_ = left[~got], bin_[~got]
    return out.reshape(n, bins)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band, its number included."""
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(parts.shape[2]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out


def _signed(bands: int, rows: int):
    @tidied
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, keys, brief = [], [], [], []
            for _, _, data, offsets in blocks(batch["text"]):
                shingles, cut = shingle_sets(lowered(data), offsets, WORDS)
                ids += set_ids(shingles, cut)
                size += np.diff(cut).tolist()
                signature = densified(shingles, cut, bands * rows)
                keys.append(band_keys(signature, bands).view(np.int64))
                brief += [row.tobytes() for row in (signature & np.uint32(255)).astype(np.uint8)]
            flat = np.concatenate(keys) if keys else np.zeros((0, bands), np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * bands, pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(ids, pa.binary()), pa.array(size, pa.int64()), lists, pa.array(brief, pa.binary())], ["id", "set_id", "n_shingles", "keys", "brief"])

    return signed


def may_link(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> np.ndarray:
    """Whether sizes and signatures (a byte a bin) leave a link possible; arrays that broadcast, bins last."""
    least, most = np.minimum(n_one, n_other), np.maximum(n_one, n_other)
    bins = one.shape[-1]
    lowest = PERCENT / 100 - DEVIATIONS * np.sqrt(0.16 / np.minimum(least, bins))
    return (100 * least >= PERCENT * most) & ((one == other).sum(axis=-1) >= lowest * bins)


def _ruled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            bins = len(batch["brief_a"][0].as_py())
            one, other = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, bins) for c in ("brief_a", "brief_b"))
            yield batch.select(["a", "b"]).filter(pa.array(may_link(one, other, batch["n_a"].to_numpy(), batch["n_b"].to_numpy())))


def shared(one: np.ndarray, other: np.ndarray) -> int:
    """Members in common of two sorted sets."""
    at = np.searchsorted(one, other)
    return int((one[np.minimum(at, len(one) - 1)] == other).sum())


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each centre (first) and its members, the members that are linked to it."""
    centre, own = None, None
    for batch in batches:
        out: dict[str, list] = {"a": [], "b": []}
        for a, role, b, shingles in zip(*(batch[c].to_pylist() for c in ("a", "role", "b", "shingles"))):
            members = np.frombuffer(shingles, np.uint64)
            if role == 0:
                centre, own = a, members
            elif centre == a:
                both = shared(own, members)
                if 100 * both >= PERCENT * (len(own) + len(members) - both):
                    out["a"].append(a)
                    out["b"].append(b)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("a", pa.binary()), ("b", pa.binary())]))


def verified(edges: DataFrame, shingles: DataFrame) -> DataFrame:
    """The edges (a, b) that are links. A centre's members are dealt to tasks in parts of about STAR; a task holds one centre's set."""
    spark = edges.sparkSession
    counts = edges.groupBy("a").agg(F.count("*").alias("n"))
    dealt = join_heavy(edges, counts, "a", "n", edges.count()).withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR)).cast("int"))
    dealt = materialise(dealt.select("a", "b", "part"), "stars")
    centres = dealt.select("a", "part").distinct().join(shingles.withColumnRenamed("set_id", "a"), "a").select("a", "part", F.lit(0).alias("role"), F.lit(None).cast("binary").alias("b"), "shingles")
    members = dealt.join(shingles.withColumnRenamed("set_id", "b"), "b").select("a", "part", F.lit(1).alias("role"), "b", "shingles")
    both = centres.unionByName(members).repartition(partitions(spark), "a", "part").sortWithinPartitions("a", "part", "role")
    return both.select("a", "role", "b", "shingles").mapInArrow(_stars, "a binary, b binary")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open sets of a bucket (first) against a part of it: pairs that may be links, chained."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    key, held, root = None, [], {}

    def top(x: bytes) -> bytes:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        out: list[tuple[bytes, bytes]] = []
        rows = list(zip(*(batch[c].to_pylist() for c in ("key", "i", "j", "role", "set_id", "root", "n_shingles", "brief"))))
        at = 0
        while at < len(rows):
            if rows[at][:3] != key:
                key, held, root = rows[at][:3], [], {}
            end = at
            while end < len(rows) and rows[end][:4] == rows[at][:4] and end - at < 256:
                end += 1
            some = rows[at:end]
            if some[0][3] == 0:
                held += some
            elif held:
                brief = lambda own: np.frombuffer(b"".join(r[7] for r in own), np.uint8).reshape(len(own), -1)
                size = lambda own: np.array([r[6] for r in own])
                left, n_left = brief(held), size(held)
                for r, row, n in zip(some, brief(some), size(some).tolist()):
                    for k in np.flatnonzero(may_link(left, row[None, :], n_left, np.array(n))).tolist():
                        if held[k][5] != r[5]:  # not of one component
                            a, b = top(held[k][4]), top(r[4])
                            if a != b:
                                root[a] = b
                                out.append((held[k][4], r[4]))
            at = end
        yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]}, schema)


def _open_pairs(buckets: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Chains (a, b) of sets of one bucket but not of one component whose signatures leave a link possible."""
    spark = buckets.sparkSession
    named = buckets.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = materialise(named, "members")
    parts = named.groupBy("key", "root").agg(F.count("*").alias("own"), F.bit_xor(F.xxhash64("set_id")).alias("mark"))
    kept = parts.groupBy("key").agg(F.max_by("root", F.struct("own", "root")).alias("base"), F.sum("own").alias("n"), F.max("own").alias("most"), F.bit_xor("mark").alias("mark"), F.count("*").alias("roots"))
    kept = kept.filter("roots > 1 AND n > 2")
    # buckets of the same sets are one
    kept = materialise(kept.groupBy("mark", "n", "most").agg(F.min(F.struct("key", "base")).alias("at")).select("at.key", "at.base", "n", (F.col("n") - F.col("most")).alias("open")), "open")
    rows = join_heavy(named, kept, "key", "n", max(1, named.count()))
    rows = rows.join(classes.select("set_id", "n_shingles", "brief"), "set_id")
    rows = rows.withColumns({"lefts": F.ceil(F.col("open") / OPEN).cast("int"), "rights": F.ceil(F.col("n") / OPEN).cast("int"), "hash": F.xxhash64("set_id", "key")})
    columns = ["key", "i", "j", "role", "set_id", "root", "n_shingles", "brief"]
    own = lambda n: F.pmod("hash", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.filter("root != base").withColumn("i", own("lefts")).withColumn("j", every("rights")).withColumn("role", F.lit(0)).select(columns)
    right = rows.withColumn("j", own("rights")).withColumn("i", every("lefts")).withColumn("role", F.lit(1)).select(columns)
    dealt = left.unionByName(right).repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "role")
    return dealt.mapInArrow(_chained, "a binary, b binary").distinct()


_RUN = pa.schema([("key", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64()), ("end", pa.int32()), ("part", pa.int32())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, set) to (key, centre, set) of the buckets with more than one row, the centre being the first; and the buckets that
    the task begins and ends with, whose other rows may be in the tasks before and after."""
    part = TaskContext.get().partitionId()
    rows = lambda key, a, b, n: pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64()), pa.nulls(len(key), pa.int32()), pa.array([part] * len(key), pa.int32())], schema=_RUN)
    end = lambda which, key, a: pa.RecordBatch.from_pydict({"key": [key], "a": [a], "b": [None], "n": [0], "end": [which], "part": [part]}, _RUN)
    held = None  # the last bucket: key, centre, whether the centre's own row is out
    many = np.iinfo(np.int64).max
    for batch in batches:
        if not len(batch):
            continue
        key, ids = batch["key"].to_numpy(), batch["set_id"]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        goes_on = held is not None and held[0] == key[0]
        if held is None:
            yield end(1, int(key[0]), ids[0].as_py())
        elif goes_on and not held[2]:
            yield rows([held[0]], [held[1]], [held[1]], [many])
        run = np.repeat(np.arange(len(first)), size)
        out = (size > 1)[run]
        if goes_on:
            out[run == 0] = True
        centre = ids.take(pa.array(first[run]))
        n = size[run].copy()
        n[(run == 0) | (run == len(first) - 1)] = many  # more of these may come
        at = np.flatnonzero(out)
        a = centre.take(pa.array(at)).to_pylist()
        if goes_on:
            a[: size[0]] = [held[1]] * int(size[0])
        if len(at):
            yield rows(key[at], a, ids.take(pa.array(at)), n[at])
        last = len(first) - 1
        if not (goes_on and last == 0):
            held = (int(key[-1]), ids[int(first[-1])].as_py(), bool(size[-1] > 1))
        else:
            held = (held[0], held[1], True)
    if held is not None:
        if not held[2]:
            yield rows([held[0]], [held[1]], [held[1]], [many])
        yield end(2, held[0], held[1])


def _starred(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, set_id, n) of buckets with more than one set, and their stars (a, b). Ranges of (key, set) are dealt, so a bucket with a
    large part of all rows is no task's alone: then it has a star in each task, and their centres are chained."""
    spark = classes.sparkSession
    filed = materialise(classes.select(F.explode("keys").alias("key"), "set_id"), "buckets")
    ranges = filed.repartitionByRange(partitions(spark), "key", "set_id").sortWithinPartitions("key", "set_id")
    runs = materialise(ranges.mapInArrow(_runs, "key long, a binary, b binary, n long, end int, part int"), "runs")
    ends = sorted(runs.filter("end IS NOT NULL").collect(), key=lambda r: (r["part"], r["end"]))  # two rows a task
    over = [(bytes(one["a"]), bytes(other["a"])) for one, other in zip(ends[1::2], ends[2::2]) if one["key"] == other["key"]]
    members = runs.filter("end IS NULL")
    edges = members.filter("a != b").select("a", "b").unionByName(spark.createDataFrame(over, "a binary, b binary")).distinct()
    return members.select("key", F.col("b").alias("set_id"), "n"), edges


def _connected(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root) of the sets that have links; roots have no row."""
    filed, edges = _starred(classes)
    brief = classes.select("set_id", F.col("n_shingles").alias("n"), "brief")
    edges = edges.join(brief.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("brief").alias("brief_b")), "b")
    edges = materialise(edges, "edges")
    centres = edges.groupBy("a").agg(F.count("*").alias("n")).join(brief.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("brief").alias("brief_a")), "a")
    edges = join_heavy(edges, materialise(centres, "centres"), "a", "n", max(1, edges.count())).select("a", "b", "n_a", "n_b", "brief_a", "brief_b")
    edges = materialise(edges.mapInArrow(_ruled_out, "a binary, b binary"), "candidates")
    ends = lambda df: df.select(F.col("a").alias("set_id")).unionByName(df.select(F.col("b").alias("set_id"))).distinct()
    wanted = lambda sets: materialise(shingles_of(rows, sets, WORDS, True).join(sets, "set_id", "left_semi"), "shingles")
    links = materialise(verified(edges, wanted(materialise(ends(edges), "wanted"))), "links")
    roots = components(links)
    more = materialise(_open_pairs(filed.filter("n > 2").select("key", "set_id"), roots, classes), "chains")
    if more.isEmpty():
        return roots
    found, _ = linked_in_groups(more, classes, wanted(materialise(ends(more), "wanted")), PERCENT / 100)
    found = found.filter("set_id != root").select(F.col("set_id").alias("a"), F.col("root").alias("b"))
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    A-Z count as lower case; words are runs of other than ASCII white space; a set holds the distinct pairs of successive
    words, or the one word there is. Documents are linked where 100 * shared >= 80 * all shingles of both; ``component_id`` is the least id
    that links reach, and ``kept`` whether that is the document's own. Null texts and texts without words have an empty set, no links
    and their own id. Repeated rows are copies: they are linked, and rows that agree in the id are kept or dropped alike. A null
    id names a component only if all of its ids are null, and is kept only then. An empty table gives an empty result. Only the two named
    columns are read.
    """
    spark, kind = bounded_batches(docs).sparkSession, docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kept = storage.shared_folder(spark)
    with storage.scope(spark):
        signed = materialise(texts.mapInArrow(_signed(bands, rows), f"id {kind}, set_id binary, n_shingles long, keys array<long>, brief binary"), "signed")
        every = storage.materialise(signed.select("id", "set_id", "n_shingles"), f"{kept}/every")
        classes = signed.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("brief").alias("brief"))
        classes = materialise(classes, "classes")
        roots = _connected(texts.select("text"), classes)
        named = materialise(classes.select("set_id", "copies", "least").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "named")
        least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
        answer = storage.materialise(join_heavy(named, least, "root", "n", max(1, named.count())).select("set_id", "copies", "component_id"), f"{kept}/components")
    some = join_heavy(every.filter("set_id IS NOT NULL"), answer, "set_id", "copies", max(1, every.count())).select("id", "n_shingles", "component_id")
    none = every.filter("set_id IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = some.unionByName(none).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("id", id_col)
