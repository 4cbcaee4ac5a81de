"""What the operators share: the shared folder, and vectorised text primitives on Arrow buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import storage

#: The ASCII white space that separates words everywhere in this subpackage.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of text that the vectorised code looks at in one go; only bounds temporaries, never a document.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later jobs don't repeat its work, and no
    block of it is lost with an executor."""
    return storage.materialise(df, f"{storage.shared_folder(df.sparkSession)}/{name}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have."""
    tag = "_q"
    while any(c.lower().startswith(tag) for c in df.columns):
        tag += "q"
    return [f"{tag}_{n}" for n in names]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(df: DataFrame, size: int = 8 << 20) -> DataFrame:
    """``df``, with the session's batches for Python bounded by bytes, as some texts are very long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


#: Keys that hold more than one in SPREAD rows are broadcast (so at most SPREAD of them); bits of a broadcast filter, in words of 64.
SPREAD, FILTER_BITS = 1000, 1 << 24


def join_heavy(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join with a table of one row a key, which has the key's number of rows in ``count``, of ``total`` in all. No
    key's rows meet in one task: rows of heavy keys stay where they are."""
    heavy = F.broadcast(table.filter(F.col(count) * SPREAD > total))
    light = rows.join(F.broadcast(table.filter(F.col(count) * SPREAD > total).select(key)), key, "left_anti")
    return rows.join(heavy, key).unionByName(light.join(table.filter(F.col(count) * SPREAD <= total), key))


def divided(docs: DataFrame, keys: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose key may be among ``keys`` (one column), and those whose key surely isn't, without a shuffle of
    ``docs``: by a broadcast filter of at most FILTER_BITS. With very many keys all rows may be among them."""
    k_word, k_mask, k_place = fresh(docs, "word", "mask", "place")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    word = lambda c: F.shiftright(c, 6)
    bit = lambda c: F.expr(f"`{c}` & 63").cast("int")
    masks = keys.select(place(F.col(keys.columns[0])).alias(k_place)).groupBy(word(F.col(k_place)).alias(k_word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(k_place))).alias(k_mask))
    masks = F.broadcast(materialise(masks, "masks"))
    tagged = docs.withColumn(k_place, place(key)).withColumn(k_word, word(F.col(k_place))).join(masks, k_word, "left")
    hit = F.call_function("shiftright", F.coalesce(k_mask, F.lit(0).cast("long")), bit(k_place)).bitwiseAND(F.lit(1)) == 1
    return tagged.filter(hit).select(docs.columns), tagged.filter(~hit).select(docs.columns)


def without(docs: DataFrame, pairs: DataFrame, id_col: str, mark: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``docs`` less the rows of ``pairs`` (id, mark, stays, n): pairs that don't stay go, of those that stay n times one row stays.

    ``mark(docs, name)`` adds the column that tells texts under one id apart. Only rows whose id may be in ``pairs`` are
    marked and shuffled.
    """
    own, p_id, p_mark, p_stays, p_n = fresh(docs, "own", "p_id", "p_mark", "p_stays", "p_n")
    pairs = materialise(pairs.filter("NOT stays OR n > 1").select(F.col("id").alias(p_id), F.col("mark").alias(p_mark), F.col("stays").alias(p_stays), F.col("n").alias(p_n)), "pairs")
    may, rest = divided(docs, pairs.select(p_id).distinct(), F.col(id_col))
    joined = mark(may, own).join(pairs, F.col(id_col).eqNullSafe(F.col(p_id)) & (F.col(own) == F.col(p_mark)), "left")
    out = rest.unionByName(joined.filter(F.col(p_stays).isNull()).select(docs.columns))
    if pairs.filter(p_stays).isEmpty():
        return out
    return out.unionByName(joined.filter(p_stays).dropDuplicates([id_col, own]).select(docs.columns))


#: Most bits of a filter of leading bits that tasks hold (16 MB).
LEAD_BITS = 27


def leading_filter(found: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """Words of 64 bits in which the leading bits of each of the hashes are set, and how many bits lead: eight for each hash, up to
    2**LEAD_BITS. It is summed up to words before it comes to the driver."""
    bits = min(LEAD_BITS, max(10, (8 * found.count()).bit_length()))
    place = F.floor(F.conv(F.hex(F.substring(column, 1, 4)), 16, 10).cast("long") / 2 ** (32 - bits)).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.expr("place & 63").cast("int"))
    masks = found.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("mask")).toArrow()
    known = np.zeros((1 << bits) >> 6, np.uint64)
    known[masks["word"].to_numpy()] = masks["mask"].to_numpy().view(np.uint64)
    return known, bits


def may_hold(known: np.ndarray, bits: int, hashed: bytes) -> bool:
    place = int.from_bytes(hashed[:4], "big") >> 32 - bits
    return bool(known[place >> 6] >> np.uint64(place & 63) & np.uint64(1))


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that gives what it no longer uses back to the machine when its task ends, as Python workers live on."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim:
            trim(0)

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: first row, end row, bytes, offsets from 0."""
    if not len(column):
        return
    data, offsets = text_buffer(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word of ``[^\\x20\\x09-\\x0D]+``; no word crosses documents."""
    ink = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | cut[1:-1]
    last[:-1] &= ~ink[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(str(base))
    if table is None or len(table) < n:
        size = max(n, BLOCK_BYTES + 1)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        _powers[str(base)] = table = np.multiply.accumulate(table)
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes about half of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from the prefix sums of one polynomial."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=total[1:])
    return mix((total[end] - total[start]) * _power(_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of ``n`` successive values."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * _BASE + hashes[k : k + count]
    return mix(out)


def assemble(schema: pa.Schema, rows: int, columns: dict[str, np.ndarray | pa.Array | list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
