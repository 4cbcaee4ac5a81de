"""Packing documents into sequences by exact-complement hashing, then best fit.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. There, the gaps
beside the longest lengths are looked up in an index of the sums of one, two and three lengths, in that order;
a combination that fills a gap exactly is consumed as often as its lengths are available. What no
combination completes goes by best fit, longest first, always many equal pieces at a time. So the plan
is a short list of patterns with multiplicities, and a piece finds its place from its number among
the pieces of its length.

Numbers: each task numbers the pieces of a length as it writes them; the counts of earlier tasks are
added. No sort and no task for all pieces of a common length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialise, tidied

CAPACITY, END_ID = 2048, 0
#: Words that a worker remembers, and the longest of them in bytes.
REMEMBERED, WORD = 600_000, 48
#: Letters of ASCII and Latin-1 in UTF-8. Of these alone, a word is one piece for the tokenizer's own splitting.
_ACCENTED = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
PLAIN = re.compile(rb"(?:[A-Za-z]|" + _ACCENTED + rb")+").fullmatch
_MORE = rb"[^\s.,;:!?]*(?:(?<![A-Za-z])(?<!" + _ACCENTED + rb")[.,;:!?]+[^\s.,;:!?]*)*"
PARTS = re.compile(rb"[^\s.,;:!?]" + _MORE + rb"|[.,;:!?]" + _MORE).findall


class WordEncoder:
    """Ids of whole texts, word by word: no token of the vocabulary crosses white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        last = json.loads(self.model.to_str())["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for t, i in self.model.get_vocab().items() if last and t.endswith(last)]] = True

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids. The library gets words: no token crosses ASCII white space,
        or goes from a plain letter to a stop. It lower-cases texts itself, but for special strings."""
        words, known = PARTS(text if b"<|" in text else text.lower()), self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                known = self.known = {}
        new = [w for w in dict.fromkeys(words) if w not in known]
        got = self._looked_up(new)
        out = b"".join([known[w] if w in known else got[w] for w in words])
        known.update((w, ids) for w, ids in got.items() if len(w) <= WORD)
        return out

    def _looked_up(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Plain words go to the library as one text, as the end of each shows in its last id."""
        plain = [w for w in words if PLAIN(w)]
        got = {}
        if plain:
            ids = np.array(self.model.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(plain):
                data = ids.tobytes()
                got = {w: data[4 * a : 4 * b] for w, a, b in zip(plain, [0, *ends[:-1].tolist()], ends.tolist())}
        rest = [w for w in words if w not in got]
        return got | {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rest, self.model.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False))}


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _cut(path: str, capacity: int, id_col: str, with_ids: bool):
    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            which, piece, start, length, crc, number, kept = [], [], [], [], [], [], []
            for row, text in enumerate(batch["text"].cast(pa.large_binary()).to_pylist()):
                ids = own.encode(text or b"") + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part_ids = ids[at : at + 4 * capacity]
                    n = len(part_ids) // 4
                    which.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part_ids))
                    number.append(int(seen[n]))
                    seen[n] += 1
                    if with_ids:
                        kept.append(np.frombuffer(part_ids, "<u4").astype(np.int64))
            columns = {id_col: batch[id_col].take(pa.array(which, pa.int64())), "piece": pa.array(piece, pa.int32()), **{n: pa.array(v, pa.int64()) for n, v in (("start", start), ("length", length), ("ids_crc32", crc), ("part", [part] * len(which)), ("number", number))}}
            if with_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    return cut


class SumIndex:
    """The sums of up to three of the lengths that are left, to those lengths.

    Pairs are filed by their sum, even ones first; a triple is a length and a filed pair of lengths that are no larger.
    What is no longer left in number is passed over.
    """

    def __init__(self, left: np.ndarray) -> None:
        self.left = left
        large, small = np.meshgrid(np.flatnonzero(left), np.flatnonzero(left), indexing="ij")
        filed = (large >= small) & (large + small < len(left))
        large, total = large[filed], (large + small)[filed]
        order = np.lexsort((large, total))
        self._large, self._cut = large[order], np.searchsorted(total[order], np.arange(len(left) + 1))

    def singles(self, total: int) -> Iterator[tuple[int, ...]]:
        if self.left[total]:
            yield (total,)

    def pairs(self, total: int, most: int | None = None) -> Iterator[tuple[int, ...]]:
        large = self._large[self._cut[total] : self._cut[total + 1]]
        large = large[: None if most is None else int(np.searchsorted(large, most, "right"))]
        small = total - large
        for a in large[(self.left[large] > 0) & (self.left[small] > (large == small))].tolist():
            yield a, total - a

    def triples(self, total: int) -> Iterator[tuple[int, ...]]:
        for a in np.flatnonzero(self.left[:total])[::-1].tolist():
            if 3 * a < total:
                return
            for pair in self.pairs(total - a, a) if self.left[a] else ():
                yield a, *pair


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) and how many sequences each stands for.

    Gaps beside the longest lengths are filled exactly by single lengths first, then by pairs, then by triples, as often as
    the lengths are available. Pairs and triples use up short lengths, of which each long one (over half of
    a sequence) needs one, so they are taken only from short lengths beyond the number of long ones.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = []
    half = capacity // 2

    def consume(pattern: tuple[int, ...]) -> int:
        times = min(int(left[x]) // k for x, k in Counter(pattern).items())
        short = sum(1 if x <= half else -1 for x in pattern)
        if len(pattern) > 2 and short > 0:
            times = min(times, max(0, int(left[: half + 1].sum() - left[half + 1 :].sum())) // short)
        if times:
            patterns.append((pattern, times))
            for x in pattern:
                left[x] -= times
        return times

    if left[capacity]:
        consume((capacity,))
    for size in (1, 2, 3):
        index = SumIndex(left)
        fillers = (index.singles, index.pairs, index.triples)[size - 1]
        for length in range(capacity - 1, 0, -1):
            if left[length]:
                for filler in fillers(capacity - length):
                    if not consume((length, *filler)) and size > 1 and left[: half + 1].sum() <= left[half + 1 :].sum():
                        break  # no short length to spare
                    if not left[length]:
                        break
    return patterns + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first into the fullest open sequence that has room; equal sequences go together."""
    open_by_gap: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n = int(left[length])
        gap = length
        while n:
            while gap <= capacity and not open_by_gap[gap]:
                gap += 1
            if gap > capacity:
                each = min(capacity // length, n)
                full, rest = divmod(n, each)
                for size, times in ((each, full), (rest, 1)):
                    if size and times:
                        open_by_gap[capacity - size * length].append(((length,) * size, times))
                break
            pattern, times = open_by_gap[gap].pop()
            each = min(gap // length, n)
            take = min(times, n // each)
            if take < times:
                open_by_gap[gap].append((pattern, times - take))
            open_by_gap[gap - each * length].append((pattern + (length,) * each, take))
            n -= take * each
            gap = length
    return [x for row in open_by_gap for x in row]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For runs of numbers within a length: where they start, their first sequence and their offset."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": table[:, 0] << 48 | table[:, 1], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def _placed(places):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            number = batch["number"].to_numpy()
            at = np.searchsorted(table["key"], batch["length"].to_numpy() << 48 | number, "right") - 1
            columns = {n: batch[n] for n in batch.schema.names if n != "number"}
            columns["sequence_id"] = pa.array(table["sequence"][at] + number - table["first"][at])
            columns["offset"] = pa.array(table["offset"][at])
            yield pa.RecordBatch.from_pydict(columns)

    return place


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (with ``with_ids``
    also the token ids).

    A document is its ids and then id 0, so null and empty texts are one token. Only documents over
    ``capacity`` are cut, into pieces of ``capacity`` tokens and one that may be shorter. Rows repeated
    with one id are packed each alone. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part long, number long" + ", ids array<long>" * with_ids
    pieces = docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(_cut(tokenizer_path, capacity, id_col, with_ids), schema)
    pieces = materialise(pieces, "pieces")
    counts = materialise(pieces.groupBy("length", "part").count(), "counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    places = spark.sparkContext.broadcast(_places(plan(totals, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0).cast("long")).alias("before"))
    columns = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    numbered = pieces.join(starts.hint("merge"), ["length", "part"])  # its rows grow with the tasks, so they are not broadcast
    numbered = numbered.select(*columns, (F.col("number") + F.col("before")).alias("number"))
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids + ", sequence_id long, offset long"
    return numbered.mapInArrow(_placed(places), schema)
