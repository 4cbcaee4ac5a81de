"""Quality rules: counts over the text, and perplexity bands under a modified Kneser-Ney model.

The model is of n-grams of characters as they stand (digits are one character), counted over every document and growing
with them. It is neither broadcast nor sent to the driver:

1. Counts: Spark sums the n-grams of full order, which each task counts for CHUNK_BYTES of text at a time.
2. Model: below the full order, kinds of what stands before are counted. Discounts, contexts and
   interpolated probabilities are joins of these tables, from single characters up.
3. Chunks: a second pass turns texts into rows of CHUNK_BYTES (compressed) with the texts' rule counts and the chunk's distinct
   n-grams; they are dealt by chunk once, and that one exchange serves the next two steps.
4. The model is dealt to shards by the n-gram's hash; a shard holds its part as a sorted array of hashes and looks up what
   chunks ask it for, each distinct n-gram once.
5. A chunk's answers meet it again and give the log perplexity of each text under each order.

A document is rejected if its log perplexity under any order of the model lies far outside the quartiles
of its language. A kind of junk that is counted looks usual to the highest order, which has learnt it;
the shorter orders rest on kinds of neighbours and learn less of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry import storage
from quarry.llm.common import blocks, materialise, mix, partitions, span_hashes, tidied, window_hashes, words

ORDER, WINDOW = 4, 5
#: Stands before a text, as often as the order needs; bytes of text of a chunk; n-grams of a shard; sizes up to which a table numbers keys.
START, CHUNK_BYTES, SHARD_GRAMS, TABLE = 2, 4 << 20, 500_000, 1 << 24
#: A band reaches REACH interquartile ranges (each at least WIDTH) beyond the quartiles, and further by
#: NOISE over the root of the text's length, as short texts spread more. ``calibrate`` gave both on sf0.1.
#: A language's quartiles are drawn towards those of all documents as by PRIOR further documents.
REACH, WIDTH, NOISE, PRIOR = 1.0, 0.01, 2.0, 50
#: What ``fit_bands`` tries, the share of good documents that it may reject, and the documents it reads.
REACHES, NOISES, SPARE, SAMPLE = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 7.0), (0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0), 0.0, 10_000
#: Languages whose bands are broadcast.
FEW = 10_000
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document of a block."""
    docs = len(offsets) - 1
    start, end, doc = words(data, offsets)
    per = lambda flag: np.diff(np.r_[0, np.cumsum(flag)][offsets])
    ink = np.zeros(len(data) + 1, np.int8)
    np.add.at(ink, start, 1)
    np.add.at(ink, end, -1)
    inside = np.cumsum(ink[:-1], dtype=np.int8).astype(bool)
    out = {"n_words": np.bincount(doc, minlength=docs), "word_chars": per(inside & ((data & 0xC0) != 0x80)), "n_symbols": per(SYMBOLS[data])}

    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.union1d(offsets[:-1], breaks + 1)
    line_end = np.r_[line_start[1:], len(data)]
    if len(line_start):
        line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end, 1) - 1] == 0x0A) if len(data) else 0)
        seen = np.r_[0, np.cumsum(inside)]
        full = seen[line_end] > seen[line_start]
        line_start, line_end = line_start[full], line_end[full]
    owner = np.searchsorted(offsets, line_start, "right") - 1
    hashes = span_hashes(data, line_start, line_end)
    order = np.lexsort((hashes, owner))
    same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out["n_dup_lines"] = np.bincount(owner[order][1:][same], minlength=docs) if len(order) else np.zeros(docs, np.int64)

    windows = window_hashes(span_hashes(data, start, end), WINDOW)
    at = np.flatnonzero(doc[: len(windows)] == doc[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    windows, owner = windows[at], doc[at]
    order = np.lexsort((windows, owner))
    same = (windows[order][1:] == windows[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=docs) if len(start) else np.zeros(docs, np.int64)
    return out


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ENTROPIES = [f"entropy_{k}" for k in range(1, ORDER + 1)]


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block (digits as 0; 0 and START as 1), and where each text begins."""
    place = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
    points[(points >= ord("0")) & (points <= ord("9"))] = ord("0")
    points[(points == 0) | (points == START)] = 1
    return points, place


def _numbered(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the number of each key among them."""
    if size > max(TABLE, 4 * len(keys)):
        return np.unique(keys, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[keys] = True
    distinct = np.flatnonzero(seen)
    number = np.zeros(size, np.int32)
    number[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, number[keys]


def n_grams(points: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of full order, one row of code points each, and the number of the one that ends at each character."""
    size, pad = np.diff(place), ORDER - 1
    padded = np.full(len(points) + pad * len(size), START, np.uint32)
    mine = np.arange(len(points)) + np.repeat(pad * np.arange(1, len(size) + 1), size)
    padded[mine] = points
    alphabet, letter = np.unique(padded, return_inverse=True) if len(padded) < 1000 else _alphabet(padded)
    distinct, index = _numbered(letter[mine], len(alphabet))
    rows = alphabet[distinct][:, None]
    for k in range(1, ORDER):  # one more character to the left
        distinct, index = _numbered(index.astype(np.int64) * len(alphabet) + letter[mine - k], len(rows) * len(alphabet))
        rows = np.concatenate([alphabet[distinct % len(alphabet)][:, None], rows[distinct // len(alphabet)]], axis=1)
    return rows.astype(np.uint32), index


def _alphabet(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, number = _numbered(points, 0x110000)
    return distinct.astype(np.uint32), number


def hashed(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k].astype(np.uint64))
    return out


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


CHUNK = "chunk long, language array<string>, base binary, text binary, cut binary, gram binary"


@tidied
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, count, size = TaskContext.get().partitionId(), 0, 0
    held: dict[str, list] = {n: [] for n in ("ids", "language", "data", "length", "base")}

    def close() -> pa.RecordBatch:
        data, length = np.concatenate(held["data"]), np.concatenate(held["length"])
        cut = np.r_[0, np.cumsum(length)].astype("<i8")
        rows, _ = n_grams(*characters(data, cut))
        base = np.concatenate(held["base"], axis=1).astype("<i8")
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(length)], pa.int32()), pa.concat_arrays(x))
        row = {
            "ids": listed(held["ids"]), "chunk": pa.array([part << 32 | count], pa.int64()), "language": listed(held["language"]), "base": pa.array([base.tobytes()]),
            "text": pa.array([pa.compress(data.tobytes(), codec="zstd", asbytes=True)]), "cut": pa.array([cut.tobytes()]), "gram": pa.array([rows.astype("<u4").tobytes()]),
        }
        for x in held.values():
            x.clear()
        return pa.RecordBatch.from_pydict(row)

    for batch in batches:
        for row, end, data, offsets in blocks(batch["text"]):
            held["ids"].append(batch["id"].slice(row, end - row))
            held["language"].append(batch["language"].slice(row, end - row))
            held["data"].append(data)
            held["length"].append(np.diff(offsets))
            held["base"].append(np.stack([base for _, base in sorted(base_counts(data, offsets).items(), key=lambda x: BASE.index(x[0]))]))
            size += len(data)
            if size >= CHUNK_BYTES:
                yield close()
                size, count = 0, count + 1
    if held["ids"]:
        yield close()


@tidied
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(data: list[np.ndarray], length: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, index = n_grams(*characters(np.concatenate(data), np.r_[0, np.cumsum(np.concatenate(length))]))
        text, n = np.ascontiguousarray(rows, "<u4").view(f"<U{ORDER}").ravel(), np.bincount(index, minlength=len(rows))
        for low in range(0, len(text), 100_000):
            yield pa.RecordBatch.from_pydict({"gram": pa.array(text[low : low + 100_000], pa.string()), "n": n[low : low + 100_000].astype(np.int64)})

    held, size = ([], []), 0
    for batch in batches:
        for _, _, data, offsets in blocks(batch["text"]):
            held[0].append(data)
            held[1].append(np.diff(offsets))
            size += len(data)
            if size >= CHUNK_BYTES:
                yield from counted(*held)
                held, size = ([], []), 0
    if held[0]:
        yield from counted(*held)


def discounts(kinds: list[int]) -> list[float]:
    """What is taken off counts of 0, 1, 2 and of 3 and more, from how many n-grams have a count of 1, 2, 3 and 4."""
    y = kinds[0] / (kinds[0] + 2 * kinds[1]) if kinds[0] else 0.5
    return [0.0, *(min(max(i - (i + 1) * y * kinds[i] / kinds[i - 1], 0.05), i - 0.05) if kinds[i - 1] else 0.5 * i for i in (1, 2, 3))]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(gram, n) of full order to (gram, p): the probability of its last character under each order, the shortest first.

    Sums and joins only. A context's rows are the characters that follow it, a suffix's rows those that stand before it.
    """
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):
        levels.insert(0, materialise(levels[0].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"grams_{k}"))
    found = None
    for k, level in enumerate(levels, 1):
        kinds = {r["n"]: r["count"] for r in level.filter("n <= 4").groupBy("n").count().collect()}  # four rows
        less = F.element_at(F.array(*map(F.lit, discounts([kinds.get(i, 0) for i in range(1, 5)]))), F.least(F.col("n"), F.lit(3)).cast("int") + 1)
        rows = level.select("gram", "n", less.alias("off"), F.substring("gram", 1, k - 1).alias("context"))
        if k == 1:
            total = level.agg(F.sum("n").alias("total"), F.sum(less).alias("off"), F.count("*").alias("kinds")).first()
            alone = (F.col("n") - F.col("off") + (total["off"] or 0.0) / ((total["kinds"] or 0) + 1)) / (total["total"] or 1)
            found = rows.select("gram", F.array(alone.cast("double")).alias("p"))
        else:
            contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("back"))
            below = found.withColumnsRenamed({"gram": "suffix", "p": "below"})
            joined = rows.withColumn("suffix", F.substring("gram", 2, k - 1)).join(contexts, "context").join(below, "suffix")
            here = (F.col("n") - F.col("off")) / F.col("total") + F.col("back") * F.element_at("below", -1)
            found = joined.select("gram", F.concat("below", F.array(here)).alias("p"))
        found = materialise(found, f"model_{k}")
    return found


DEALT = "shard long, kind int, chunk long, keys binary, logs binary"
_DEALT = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("logs", pa.binary())])


def _slices(key: np.ndarray, shards: int, kind: int, chunk: int | None, logs: np.ndarray | None) -> pa.RecordBatch:
    """Sorted hashes, cut by shard."""
    shard = _shard(key, shards)
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])[: len(key)]
    own = list(zip(first.tolist(), [*first[1:].tolist(), len(key)]))
    return pa.RecordBatch.from_pydict({
        "shard": shard[first], "kind": [kind] * len(own), "chunk": [chunk] * len(own), "keys": [key[a:b].tobytes() for a, b in own],
        "logs": [None if logs is None else np.ascontiguousarray(logs[a:b]).tobytes() for a, b in own],
    }, _DEALT)


def _model_parts(shards: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                key = hashed(np.array(batch["gram"].to_pylist(), f"<U{ORDER}").view("<u4").reshape(-1, ORDER))
                logs = np.log10(batch["p"].flatten().to_numpy().reshape(-1, ORDER)).astype("<f4")
                order = np.argsort(key)
                yield _slices(key[order], shards, 0, None, logs[order])

    return deal


def _requests(shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, gram in zip(*(batch[n].to_pylist() for n in ("chunk", "gram"))):
                if gram:
                    yield _slices(np.sort(hashed(np.frombuffer(gram, "<u4").reshape(-1, ORDER))), shards, 1, chunk, None)

    return ask


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, parts, keys, logs = None, [], np.zeros(0, "<u8"), np.zeros((0, ORDER), "<f4")
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("chunk", "shard", "logs")}
        for row in zip(*(batch[n].to_pylist() for n in _DEALT.names)):
            if row[0] != shard:
                shard, parts, keys = row[0], [], None
            if row[1] == 0:
                parts.append((np.frombuffer(row[3], "<u8"), np.frombuffer(row[4], "<f4").reshape(-1, ORDER)))
                continue
            if keys is None:  # the shard's part of the model has been read
                keys, logs = np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts])
                order = np.argsort(keys, kind="stable")
                keys, logs, parts = keys[order], logs[order], []
            for name, value in zip(out, (row[2], row[0], logs[np.searchsorted(keys, np.frombuffer(row[3], "<u8"))].tobytes())):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("logs", pa.binary())]))


def _perplexities(id_type: pa.DataType):
    def measured(row: dict, answers: list[bytes]) -> pa.RecordBatch:
        cut = np.frombuffer(row["cut"], "<i8")
        points, place = characters(np.frombuffer(pa.decompress(row["text"], int(cut[-1]), codec="zstd"), np.uint8), cut)
        rows, index = n_grams(points, place)
        logs = np.empty((len(rows), ORDER), np.float32)
        logs[np.argsort(hashed(rows))] = np.frombuffer(b"".join(answers), "<f4").reshape(-1, ORDER)
        size = np.diff(place)
        entropy = []
        for k in range(ORDER):
            total = np.r_[0.0, np.cumsum(logs[:, k][index], dtype=np.float64)]
            entropy.append(pa.array(-np.diff(total[place]) / np.maximum(size, 1)))
        base = np.frombuffer(row["base"], "<i8").reshape(len(BASE), -1)
        return pa.RecordBatch.from_arrays([pa.array(row["ids"], id_type), pa.array(row["language"], pa.string()), *map(pa.array, base), *entropy], ["id", "language", *BASE, *ENTROPIES])

    @tidied
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield measured(row, [x["logs"] for x in row["answers"] or ()])

    return go


def _measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id, language, counts, base_failed and the log perplexity under each order."""
    field, tasks = docs.schema[id_col], partitions(docs.sparkSession)
    kind = field.dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("language"), F.col(text_col).alias("text"))
    kept = storage.shared_folder(docs.sparkSession)
    with storage.scope(docs.sparkSession):  # chunks and model go when the texts are measured
        counts = materialise(rows.select("text").mapInArrow(_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
        model = kneser_ney(counts)
        shards = max(tasks, -(-counts.count() // SHARD_GRAMS))
        chunks = rows.mapInArrow(_chunks, f"ids array<{kind}>, {CHUNK}").repartition(tasks, "chunk")  # used twice with all columns: one exchange
        dealt = model.mapInArrow(_model_parts(shards), DEALT).unionByName(chunks.mapInArrow(_requests(shards), DEALT))
        dealt = dealt.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "kind")
        answers = dealt.mapInArrow(_look_up, "chunk long, shard long, logs binary")
        answers = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "logs"))).alias("answers"))  # a chunk's n-grams
        met = chunks.join(answers.hint("merge"), "chunk", "left")
        schema = f"id {kind}, language string, " + ", ".join([*(f"{n} long" for n in BASE), *(f"{n} double" for n in ENTROPIES)])
        measured = storage.materialise(met.mapInArrow(_perplexities(to_arrow_type(field.dataType)), schema), f"{kept}/measured")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def _with_quartiles(measured: DataFrame) -> DataFrame:
    """``measured`` with the quartiles of its language for each order, as q: the mean of the language's own,
    weighted by its documents, and those of all documents, weighted by PRIOR."""
    quartiles = F.array(*(F.percentile_approx(n, [0.25, 0.75], 10_000) for n in ENTROPIES)).alias("q")
    passed = measured.filter("NOT base_failed")
    own = passed.groupBy("language").agg(quartiles, F.count("*").alias("n"))
    (every,) = passed.agg(quartiles).select(F.transform("q", lambda q: F.coalesce(q, F.array(F.lit(0.0), F.lit(0.0)))).alias("q")).collect()
    if own.count() <= FEW:  # rows of one language need not meet in one task then
        own = F.broadcast(own)
    pooled = F.array(*(F.array(*map(F.lit, q)) for q in every["q"]))
    mean = lambda a, b: (F.col("n") * a + PRIOR * b) / (F.col("n") + PRIOR)
    drawn = F.zip_with("q", pooled, lambda a, b: F.array(mean(a[0], b[0]), mean(a[1], b[1])))
    return measured.join(own, "language", "left").withColumn("q", F.coalesce(drawn, pooled)).drop("n")


def fit_bands(entropy: np.ndarray, quartiles: np.ndarray, chars: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """The reach and noise that keep the least junk while at most SPARE of the good documents are rejected,
    and among these the widest; with rows a document, entropy by order and quartiles by order and side."""
    width = np.maximum(quartiles[:, :, 1] - quartiles[:, :, 0], WIDTH)
    beyond = np.maximum(quartiles[:, :, 0] - entropy, entropy - quartiles[:, :, 1])
    tried = []
    for reach in REACHES:
        for noise in NOISES:
            kept = (beyond <= reach * width + (noise / np.sqrt(np.maximum(chars, 1)))[:, None]).all(axis=1)
            if (~kept & good).sum() <= SPARE * good.sum():
                tried.append(((kept & ~good).sum(), -reach, -noise))
    _, reach, noise = min(tried, default=(0, -REACHES[-1], -NOISES[-1]))
    return -float(reach), -float(noise)


def calibrate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[float, float]:
    """``fit_bands`` on at most SAMPLE documents that pass the base rule, of even crc32 of the id, with a quality (0 or 1) in ``labels``."""
    even = F.crc32(F.col("id").cast("string").cast("binary")) % 2 == 0
    marked = labels.select(F.col(id_col).alias("id"), F.col("quality").alias("good")).filter(F.col("good").isNotNull() & even)
    rows = _with_quartiles(_measured(docs, id_col, text_col, lang_col)).filter("NOT base_failed").join(marked, "id")
    rows = rows.select(F.array(*ENTROPIES).alias("entropy"), "q", "word_chars", "good").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    return fit_bands(np.array([r["entropy"] for r in rows]), np.array([r["q"] for r in rows]), np.array([r["word_chars"] for r in rows]), np.array([r["good"] == 1 for r in rows]))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    entropy (log10 perplexity a character under the highest order), low and high (its language's band),
    orders_outside (orders of the model under which the text is outside of its language's band), kept.

    Null and empty texts have no words and fail the base rule. A null language is a language of its own.
    Ties at a band's edge stay. Repeated rows and ids are judged each alone, though they count in the
    model. An empty table gives an empty result. Only the three named columns are read; texts are whole.
    """
    rows = _with_quartiles(_measured(docs, id_col, text_col, lang_col))
    noise = F.lit(NOISE) / F.sqrt(F.greatest("word_chars", F.lit(1)))
    reach = lambda q: REACH * F.greatest(q[1] - q[0], F.lit(WIDTH)) + noise
    rows = rows.withColumn("band", F.transform("q", lambda q: F.array(q[0] - reach(q), q[1] + reach(q))))
    outside = sum((~F.col(n).between(F.col("band")[k][0], F.col("band")[k][1])).cast("int") for k, n in enumerate(ENTROPIES))
    last = F.col("band")[ORDER - 1]
    out = rows.withColumn("orders_outside", outside)
    return out.select(F.col("id").alias(id_col), *BASE, "base_failed", F.col(ENTROPIES[-1]).alias("entropy"), last[0].alias("low"), last[1].alias("high"), "orders_outside", (~F.col("base_failed") & (F.col("orders_outside") == 0)).alias("kept"))
