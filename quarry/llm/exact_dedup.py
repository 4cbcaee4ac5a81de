"""Exact deduplication through a log-structured merge index.

Memtables of (digest, rank, id) flush as sorted runs to the shared folder. A run's part for a shard
(a range of digests) is a segment with its own Bloom filter. Compaction merges a shard's segments in
tiers of a fixed fan-in: a digest that no other segment's filter knows passes unread, the others are
merged and the best entry stays (most code points, then smallest id). Digests held more than once are
hits; their normalised texts are compared byte for byte. Rows of a digest shared by different texts are read again and
grouped by their normalised bytes, whatever their digest.

A hot text gives one segment entry a run (two where a file of runs is read in two parts), however often it occurs
there, and its answer returns a run at a time, so no task ever holds a group of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import join_heavy, leading_filter, materialise, may_hold, partitions, text_buffer, tidied, without

#: Rows of a memtable, segments merged at a time, entries a shard should hold, bits of filter a digest.
MEMTABLE_ROWS, FAN_IN, SHARD_ENTRIES, FILTER_BITS = 1 << 17, 8, 200_000, 10
WHITE_SPACE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LAST = np.iinfo(np.int64).max


def digest_of(text: bytes) -> bytes:
    """32 bytes; tests take worse digests, so that different texts meet."""
    return hashlib.sha256(text).digest()


def _normalised(column: pa.Array) -> Iterator[bytes]:
    data, offsets = text_buffer(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b].tobytes().translate(None, WHITE_SPACE)


RUNS = "run long, row long, id long, n_points long, digest binary, sha binary"


def _flush(digest: Callable[[bytes], bytes], memtable_rows: int):
    @tidied
    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, rows = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            normal = list(_normalised(batch["text"]))
            sha = [hashlib.sha256(x).digest() for x in normal]
            keys = sha if digest is digest_of else [digest(x) for x in normal]
            points = pa.compute.utf8_length(batch["text"]).cast(pa.int64()).fill_null(0)
            held.append(pa.table({"id": batch["id"].cast(pa.int64()), "n_points": points, "digest": pa.array(keys, pa.binary()), "sha": pa.array(sha, pa.binary())}))
            rows += len(batch)
            while rows >= memtable_rows:
                table = pa.concat_tables(held)
                yield from _sorted_run(table.slice(0, memtable_rows), part, count)
                held, count = [table.slice(memtable_rows)], count + 1
                rows = held[0].num_rows
        if rows:
            yield from _sorted_run(pa.concat_tables(held), part, count)

    return flush


def _sorted_run(table: pa.Table, part: int, count: int) -> Iterator[pa.RecordBatch]:
    run = part << 24 | count
    table = table.sort_by([("digest", "ascending"), ("n_points", "descending"), ("id", "ascending")])
    row = np.arange(table.num_rows, dtype=np.int64) + (run << 17)
    table = pa.table({"run": np.full(table.num_rows, run, np.int64), "row": row, **{c: table[c] for c in ("id", "n_points", "digest", "sha")}})
    yield from table.to_batches()


ENTRY = [("key", "S32"), ("n_points", "<i8"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8"), ("null", "?")]


def _reduced(entries: np.ndarray) -> np.ndarray:
    """One entry a digest: the best one, with the group's size; in order of digest."""
    order = np.lexsort((entries["row"], entries["id"], entries["null"], -entries["n_points"], entries["key"]))
    entries = entries[order]
    first = np.flatnonzero(np.r_[True, entries["key"][1:] != entries["key"][:-1]])
    best = entries[first].copy()
    best["n"] = np.add.reduceat(entries["n"], first)
    return best


def _positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """Digests are uniform, so their own words serve as the hashes."""
    return np.ascontiguousarray(keys).view("<u8").reshape(-1, 4)[:, 1:] % np.uint64(bits)


def _filter(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(max(64, len(keys) * FILTER_BITS), bool)
    bits[_positions(keys, len(bits)).ravel()] = True
    return np.packbits(bits)


def _known(packed: np.ndarray, keys: np.ndarray, entries: int) -> np.ndarray:
    at = _positions(keys, max(64, entries * FILTER_BITS))
    return (packed[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).all(axis=1)


def merge_segments(segments: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Segments (entries by digest, filter) to one; only digests that another filter knows are merged."""
    alone, shared = [], []
    for i, (entries, _) in enumerate(segments):
        hit = np.zeros(len(entries), bool)
        for j, (other, packed) in enumerate(segments):
            if j != i:
                hit |= _known(packed, entries["key"], len(other))
        alone.append(entries[~hit])
        shared.append(entries[hit])
    shared = np.concatenate(shared)
    merged = np.concatenate([*alone, *([_reduced(shared)] if len(shared) else [])])
    merged = merged[np.argsort(merged["key"], kind="stable")]
    return merged, _filter(merged["key"])


def _segments(shards: int):
    schema = pa.schema([("shard", pa.int64()), ("run", pa.int64()), ("entries", pa.binary()), ("filter", pa.binary())])

    def segments(run: int, held: list[np.ndarray]) -> pa.RecordBatch:
        own = _reduced(np.concatenate(held))
        head = np.ascontiguousarray(own["key"]).view(">u4").reshape(-1, 8)[:, 0].astype(np.uint64)
        shard = (head * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        parts = [own[a:b] for a, b in zip(first, [*first[1:], len(own)])]
        return pa.RecordBatch.from_pydict({"shard": shard[first], "run": [run] * len(parts), "entries": [p.tobytes() for p in parts], "filter": [_filter(p["key"]).tobytes() for p in parts]}, schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            if not len(batch):
                continue
            runs = batch["run"].to_numpy()
            entries = np.zeros(len(batch), ENTRY)
            entries["key"] = np.frombuffer(b"".join(batch["digest"].to_pylist()), "S32")
            entries["n_points"], entries["row"], entries["n"] = batch["n_points"].to_numpy(), batch["row"].to_numpy(), 1
            entries["null"] = batch["id"].is_null().to_numpy(zero_copy_only=False)
            entries["id"] = batch["id"].fill_null(LAST).to_numpy()
            cuts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
            for a, b in zip(cuts, [*cuts[1:], len(runs)]):  # a run's rows follow each other
                if held and runs[a] != current:
                    yield segments(current, held)
                    held = []
                current = int(runs[a])
                held.append(entries[a:b])
        if held:
            yield segments(current, held)

    return pack


HITS = "run long, digest binary, keep_id long, keep_row long, group_size long"


def _compact(table: pa.Table) -> pa.Table:
    runs = table["run"].to_numpy()
    tier = [(np.frombuffer(e, ENTRY), np.frombuffer(f, np.uint8)) for e, f in zip(table["entries"].to_pylist(), table["filter"].to_pylist())]
    every = np.concatenate([e["key"] for e, _ in tier])
    run = np.repeat(runs, [len(e) for e, _ in tier])
    tier.sort(key=lambda s: len(s[0]))
    while len(tier) > 1:
        tier = [merge_segments(tier[k : k + FAN_IN]) for k in range(0, len(tier), FAN_IN)]
    index = tier[0][0]
    found = index[np.searchsorted(index["key"], every)]
    hit = found["n"] > 1
    found, run = found[hit], run[hit]
    order = np.lexsort((found["key"], run))
    found, run = found[order], run[order]
    once = np.r_[True, (run[1:] != run[:-1]) | (found["key"][1:] != found["key"][:-1])] if len(run) else np.zeros(0, bool)
    found, run = found[once], run[once]
    keys = np.ascontiguousarray(found["key"]).view("V32")
    return pa.table({
        "run": run, "digest": pa.array([k.tobytes() for k in keys], pa.binary()),
        "keep_id": pa.array(found["id"], mask=found["null"]), "keep_row": found["row"], "group_size": found["n"],
    })


def _hit_texts(wanted, bits: int, digest_of: Callable[[bytes], bytes]):
    """Normalised texts of the digests wanted, and by chance of some more."""

    @tidied
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        for batch in batches:
            out: dict[str, list] = {"id": [], "n_points": [], "digest": [], "normal": []}
            points = pa.compute.utf8_length(batch["text"]).cast(pa.int64()).fill_null(0)
            for i, normal in enumerate(_normalised(batch["text"])):
                digest = digest_of(normal)
                if may_hold(known, bits, digest):
                    for name, v in zip(out, (batch["id"][i].as_py(), points[i].as_py(), digest, normal)):
                        out[name].append(v)
            if out["digest"]:
                yield pa.RecordBatch.from_pydict(out, pa.schema([("id", pa.int64()), ("n_points", pa.int64()), ("digest", pa.binary()), ("normal", pa.binary())]))

    return texts


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = digest_of, memtable_rows: int = MEMTABLE_ROWS, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical without ASCII white space. Null and empty texts, and texts of white
    space only, form one group. A null id sorts last. Rows repeated with the same id and text are copies
    like any other: one of them is kept, ``keep_id`` names their common id. An empty table gives an
    empty result. Only the two named columns are read, so other columns and their names don't matter.
    Ids are integers. ``memtable_rows`` is at most 2**17.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    runs = materialise(rows.mapInArrow(_flush(digest, memtable_rows), RUNS), "runs")
    shards = max(partitions(spark), -(-runs.count() // shard_entries))
    segments = runs.select("run", "row", "id", "n_points", "digest").mapInArrow(_segments(shards), "shard long, run long, entries binary, filter binary")
    hits = materialise(segments.groupBy("shard").applyInArrow(_compact, HITS), "hits")

    texts = _texts_of(rows, hits.select("digest").distinct(), digest)
    differ = texts.groupBy("digest").agg(F.min("normal").alias("low"), F.max("normal").alias("high")).filter("low != high").select("digest")
    differ = materialise(differ, "differ")

    answer = runs.join(hits, ["run", "digest"], "left")
    found = answer.select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "digest",
    )
    if differ.isEmpty():
        return found.drop("digest")
    return found.join(differ, "digest", "left_anti").drop("digest").unionByName(_by_text(_texts_of(rows, differ, digest).join(differ, "digest", "left_semi"), id_col))


def _texts_of(rows: DataFrame, digests: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """(id, n_points, digest, normal) of the rows whose digest is wanted, and by chance of some more, from one more pass over the texts."""
    known, bits = leading_filter(digests, "digest")
    return rows.mapInArrow(_hit_texts(rows.sparkSession.sparkContext.broadcast(known), bits, digest), "id long, n_points long, digest binary, normal binary")


def _by_text(texts: DataFrame, id_col: str) -> DataFrame:
    """Where different texts share a digest: groups of equal normalised bytes, pre-aggregated before the shuffle."""
    texts = materialise(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    best = F.struct((-F.col("n_points")).alias("n"), F.col("id").isNull().alias("null"), "id", "row")
    groups = materialise(texts.groupBy("normal").agg(F.min(best).alias("best"), F.count("*").alias("group_size")), "groups")
    return join_heavy(texts, groups, "normal", "group_size", max(1, texts.count())).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.sha2("normal", 256).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, without the copies. Only texts of the ids that copies have are looked at again."""

    def mark(rows: DataFrame, name: str) -> DataFrame:
        normal = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+", "")
        return rows.withColumn(name, F.sha2(normal.cast("binary"), 256))

    found = exact_duplicates(docs, id_col, text_col)
    pairs = found.groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("mark")).agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    return without(docs, pairs, id_col, mark)


SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
       text_sha256
FROM d
"""
