"""Language-model scores from a log-frequency Bloom filter.

The filter holds an n-gram of count c as the members (n-gram, 1), (n-gram, 2) ... up to its level, the
rounded logarithm of c; membership probes with rising numbers give the level back. A trigram model with
discounted counts, interpolated with bigrams and words, is scored from these levels.

Filter and vocabulary grow with the training texts, so neither is broadcast or sent to the driver: the filter is cut into
shards by n-gram, and n-grams travel to their shard. Texts are read once:

1. Chunks: each task turns its texts into rows of CHUNK_BYTES of text: the distinct tokens and the texts as
   positions among them. Everything after works on chunks.
2. Shards: a chunk sends each shard its distinct n-grams with their counts in training texts. The shard
   sums the counts, builds its part of the filter, and answers each n-gram with its level (single tokens
   with their exact count too). An n-gram is sent once a chunk, so no n-gram is hot.
3. Scores: a chunk's answers meet it again, and its texts are scored.

Tokens are told apart by 64-bit hashes, n-grams of a shard by 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import blocks, materialise, mix, partitions, span_hashes, tidied, words

#: Filter bits for a member, probes for a member (3 in 10,000 give a false hit), base of the levels.
MEMBER_BITS, PROBES, LEVEL_BASE = 20, 6, 1.5
#: Longest n-gram, what is taken off each count of two and more words, weight of the shorter n-grams beside a longer one.
ORDER, DISCOUNT, SHORTER = 3, 0.75, 0.4
#: Bytes of text of a chunk, n-grams that a shard should be sent. An n-gram's entries in its shard are at most one a chunk.
CHUNK_BYTES, SHARD_ENTRIES = 16 << 20, 1_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
ONE, TWO, THREE = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6D), np.uint64(0xC0AC29B7C97C50DD)

CHUNK = "chunk long, place long, held array<boolean>, cut binary, token binary, index binary, n_tokens long, n_train long"
ANSWER = "chunk long, place long, gram_order int, shard long, count binary, level binary, n_all long, n_kinds long"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block, each document closed by an end, and the documents' offsets."""
    data = LOWER[data]
    start, end, doc = words(data, offsets)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    cut = np.r_[0, np.cumsum(count + 1)]
    out = np.full(cut[-1], END, np.uint64)
    out[np.arange(len(start)) + doc] = span_hashes(data, start, end)
    return out, cut


def n_grams(token: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """Hashes of the word pair and the word triple that end at each token; before a text stand starts."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[cut[:-1]] = START
    earlier = np.empty_like(token)
    earlier[1:] = before[:-1]
    earlier[cut[:-1]] = START
    return [mix(before * TWO + token), mix(earlier * THREE + mix(before * TWO + token))]


def _chunks(id_type: str):
    @tidied
    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, size = TaskContext.get().partitionId(), 0, 0
        ids, held, token, length = [], [], [], []

        def close() -> pa.RecordBatch:
            distinct, index = np.unique(np.concatenate(token), return_inverse=True)
            out = np.concatenate(held)
            cut = np.r_[0, np.cumsum(np.concatenate(length))]
            row = {
                "ids": pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.concat_arrays(ids)), "chunk": pa.array([part << 32 | count], pa.int64()), "place": pa.array([part + count], pa.int64()),
                "held": pa.array([out.tolist()], pa.list_(pa.bool_())), "cut": pa.array([cut.astype("<i8").tobytes()]), "token": pa.array([distinct.astype("<u8").tobytes()]), "index": pa.array([packed(index)]),
                "n_tokens": pa.array([len(index)], pa.int64()), "n_train": pa.array([int((~out).sum())], pa.int64()),
            }
            for x in (ids, held, token, length):
                x.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for row, end, data, offsets in blocks(batch["text"]):
                own, cut = tokens(data, offsets)
                ids.append(batch["id"].slice(row, end - row))
                held.append(batch["held_out"].slice(row, end - row).to_numpy(zero_copy_only=False))
                token.append(own)
                length.append(np.diff(cut))
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield close()
                    size, count = 0, count + 1
        if ids:
            yield close()

    return cut_texts


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, each in as few bytes as the largest needs."""
    most = int(x.max(initial=0))
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "<u1").astype(np.int64)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, positions among them, and offsets of the texts."""
    cut = np.frombuffer(row["cut"], "<i8")
    return np.frombuffer(row["token"], "<u8"), unpacked(row["index"], int(cut[-1])), cut


def _requests(shards: int):
    schema = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("place", pa.int64()), ("gram_order", pa.int32()), ("gram", pa.binary()), ("n", pa.binary())])

    @tidied
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                distinct, index, cut = _unpacked(row)
                train = np.repeat(~np.array(row["held"], bool), np.diff(cut))
                for order in range(1, ORDER + 1):
                    if order == 1:
                        gram, at = distinct, index
                    else:
                        gram, at = np.unique(n_grams(distinct[index], cut)[order - 2], return_inverse=True)
                    n = np.bincount(at[train], minlength=len(gram))
                    shard = ((gram >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
                    key = gram.astype("<u8") if order == 1 else gram.astype("<u4")
                    own = [(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(gram)])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard[first]), pa.array(np.full(len(own), row["chunk"])), pa.array(np.full(len(own), row["place"])), pa.array(np.full(len(own), order, np.int32)),
                        pa.array([key[a:b].tobytes() for a, b in own], pa.binary()), pa.array([packed(n[a:b]) for a, b in own], pa.binary()),
                    ], schema=schema)

    return ask


def level_of(count: np.ndarray) -> np.ndarray:
    """0 for none, else 1 and the logarithm, rounded down."""
    return np.where(count > 0, 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(LEVEL_BASE) + 1e-9), 0).astype(np.uint8)


def estimate(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of the whole numbers of that level."""
    numbers = np.arange(256, dtype=np.float64)
    low, high = np.ceil(LEVEL_BASE ** (numbers - 1) - 1e-9), np.ceil(LEVEL_BASE**numbers - 1e-9) - 1
    return np.where(numbers > 0, np.maximum(low, (low + high) / 2), 0.0)[level]


class Filter:
    """A Bloom filter of (n-gram, level) for the n-grams of one shard and length."""

    def __init__(self, gram: np.ndarray, level: np.ndarray) -> None:
        self.size = np.uint64(max(64, int(level.sum(dtype=np.int64)) * MEMBER_BITS))
        bits = np.zeros(int(self.size), bool)
        for k in range(1, int(level.max(initial=0)) + 1):
            for probe in range(PROBES):
                bits[self._bit(gram[level >= k], k, probe)] = True
        self.bits = np.packbits(bits, bitorder="little")

    def _bit(self, gram: np.ndarray, level: int, probe: int) -> np.ndarray:
        step = (level * PROBES + probe) * 0x9E3779B97F4A7C15 % 2**64
        return (mix(gram.astype(np.uint64) + np.uint64(step)) % self.size).astype(np.int64)

    def levels(self, gram: np.ndarray) -> np.ndarray:
        """The highest level up to which all members are there; 0 where the n-gram is unknown."""
        out, live, level = np.zeros(len(gram), np.uint8), np.arange(len(gram)), 0
        while len(live):
            out[live] = level
            level += 1
            for probe in range(PROBES):
                bit = self._bit(gram[live], level, probe)
                live = live[(self.bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)]
        return out


def _answered(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Counts of one shard's n-grams, its part of the filter, and the answer to each chunk."""
    shard = rows[0][0]
    for order in range(1, ORDER + 1):
        own = [r for r in rows if r[3] == order]
        if not own:
            continue
        keys = [np.frombuffer(r[4], "<u8" if order == 1 else "<u4") for r in own]
        gram, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpacked(r[5], len(k)) for r, k in zip(own, keys)]), minlength=len(gram)).astype(np.int64)
        known = total > 0
        level = Filter(gram[known], level_of(total[known])).levels(gram)[at]
        cuts = np.r_[0, np.cumsum([len(k) for k in keys])]
        part = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        count = total[at] if order == 1 else total[:0]
        columns = {
            "chunk": [r[1] for r in own], "place": [r[2] for r in own], "gram_order": [order] * len(own), "shard": [shard] * len(own),
            "count": [packed(count[a:b]) for a, b in part], "level": [level[a:b].tobytes() for a, b in part], "n_all": [None] * len(own), "n_kinds": [None] * len(own),
        }
        if order == 1:
            for name, value in zip(columns, (None, None, 0, shard, None, None, int(total.sum()), int(known.sum()))):
                columns[name].append(value)
        yield pa.RecordBatch.from_pydict(columns, pa.schema([("chunk", pa.int64()), ("place", pa.int64()), ("gram_order", pa.int32()), ("shard", pa.int64()), ("count", pa.binary()), ("level", pa.binary()), ("n_all", pa.int64()), ("n_kinds", pa.int64())]))


@tidied
def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch[n].to_pylist() for n in ("shard", "chunk", "place", "gram_order", "gram", "n"))):
            if held and held[0][0] != row[0]:
                yield from _answered(held)
                held = []
            held.append(row)
    if held:
        yield from _answered(held)


def probabilities(counts: list[np.ndarray], before: list[np.ndarray], total: int, kinds: int) -> np.ndarray:
    """Probability of each token from the counts of the word, pair and triple that end there, and of what stands
    before it in the pair and the triple (0 where the triple would begin before the text)."""
    out = np.minimum((counts[0] + 0.5) / (total + 0.5 * (kinds + 1)), 1.0)
    for n, context in zip(counts[1:], before):
        longer = np.maximum(np.minimum(n, context) - DISCOUNT, 0) / np.maximum(context, 1)
        out = np.where(context > 0, (1 - SHORTER) * longer + SHORTER * out, out)
    return out


def _score(total: int, kinds: int, starts: int, id_type: pa.DataType):
    def scores(row: dict, answers: list[tuple]) -> pa.RecordBatch:
        distinct, index, cut = _unpacked(row)
        first = cut[:-1]
        levels = lambda order: np.frombuffer(b"".join(a[2] for a in answers if a[0] == order), np.uint8)
        count = np.concatenate([unpacked(a[1], len(a[2])) for a in answers if a[0] == 1])
        add = lambda x: np.add.reduceat(x[index], first)
        counts = [estimate(levels(1))[index]]
        for order, grams in enumerate(n_grams(distinct[index], cut), 2):
            at = np.unique(grams, return_inverse=True)[1]
            counts.append(estimate(levels(order))[at])
        before = []
        for own in counts[:-1]:
            context = np.empty_like(own)
            context[1:] = own[:-1]
            context[first] = 0 if before else starts
            before.append(context)
        chance = np.log10(probabilities(counts, before, total, kinds))
        base = np.log10(count + 0.5) - np.log10(total + 0.5 * (kinds + 1))
        ids = pa.array(row["ids"], id_type)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(row["held"], pa.bool_()), pa.array(np.diff(cut)), pa.array(add((count > 0).astype(np.int64))), pa.array(add(base)), pa.array(np.add.reduceat(chance, first))],
            ["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    @tidied
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, answers = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["gram_order"] == 0:
                    if row:
                        yield scores(row, answers)
                    row, answers = r, []
                else:
                    answers.append((r["gram_order"], r["count"], r["level"]))
        if row:
            yield scores(row, answers)

    return go


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts count as empty: one token, the end. Documents with a null id are training documents.
    Repeated rows count and are scored each alone. An empty table gives an empty result; a table with
    held-out rows only scores them against no counts. Only the two named columns are read. A chunk is held
    whole in one task, and a text is never cut, so a task needs memory for CHUNK_BYTES and its longest text.
    """
    spark = docs.sparkSession
    field = docs.schema[id_col]
    kind = field.dataType.simpleString()
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    chunks = materialise(rows.mapInArrow(_chunks(kind), f"ids array<{kind}>, {CHUNK}"), "chunks")
    n_tokens, starts = (x or 0 for x in chunks.agg(F.sum("n_tokens"), F.sum("n_train")).first())

    tasks = partitions(spark)
    shards = max(tasks, -(-n_tokens * ORDER // SHARD_ENTRIES))
    requests = chunks.select("chunk", "place", "held", "cut", "token", "index").mapInArrow(_requests(shards), "shard long, chunk long, place long, gram_order int, gram binary, n binary")
    dealt = requests.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard")
    answers = materialise(dealt.mapInArrow(_answer, ANSWER), "answers")
    total, kinds = (x or 0 for x in answers.agg(F.sum("n_all"), F.sum("n_kinds")).first())

    heads = chunks.drop("n_tokens", "n_train").withColumns({"gram_order": F.lit(0), "shard": F.lit(0).cast("long")})
    met = heads.unionByName(answers.filter("chunk IS NOT NULL").drop("n_all", "n_kinds"), allowMissingColumns=True)
    met = met.repartitionById(tasks, F.pmod("place", F.lit(tasks)).cast("int")).sortWithinPartitions("chunk", "gram_order", "shard")
    from pyspark.sql.pandas.types import to_arrow_type

    out = met.mapInArrow(_score(total, kinds, starts, to_arrow_type(field.dataType)), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
