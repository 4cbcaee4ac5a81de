"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

1. Each document's set of five-word shingles gets an id and a MinHash signature. Documents of one set
   (all copies among them) are one class, joined by their set's id.
2. Forest: in each of TREES trees a set's label is a stretch of DEPTH minima of its signature. The labels of a tree are
   sorted, so sets below a trie's node follow each other, and the trie is known from how far each label agrees with the next
   one. Ranges of sorted labels are dealt to tasks, so a crowded node is no task's alone.
3. Sets that agree in the full depth in some tree are verified first. Each link's similarity says how likely a
   prefix of any length finds such a link, so the links found tell how many there are and what a shorter prefix
   would find. The prefix is shortened to the first length that is expected to find the share RECALL of all links, again
   until that holds; it need never be shorter than where pairs at the threshold themselves meet RECALL.
4. Verification: chains of sets that share a prefix are a group. Its sets meet in blocks of bounded size, and every pair
   of a group is counted exactly in one pair of blocks. Links are summed up for each set inside the block, so no pair is
   ever a row. Sets of verified links are connected to classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry import storage
from quarry.llm.common import blocks, join_heavy, leading_filter, materialise, may_hold, mix, partitions, span_hashes, tidied, window_hashes, without, words
from quarry.llm.graph import components

WORDS, THRESHOLD = 5, 0.8
#: Trees, the depth of their labels, and the share of links to be found.
TREES, DEPTH, RECALL = 24, 8, 0.999
#: Sets of a block in verification, and their members (eight bytes each) together, as far as hashing deals them evenly.
BLOCK_SETS, BLOCK_MEMBERS = 400, 1 << 23
#: Parts into which the similarities from the threshold to 1 are counted.
BINS = 40


def chance(similarity: np.ndarray | float, length: int, trees: int = TREES) -> np.ndarray | float:
    """How likely a pair agrees in a prefix of so many minima in some tree."""
    return 1 - (1 - similarity**length) ** trees


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix that still finds a pair at the threshold with the probability asked for."""
    while depth > 1 and chance(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def next_length(found: np.ndarray, length: int, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix up to ``length`` that is expected to find the share ``recall`` of all links, judged by the links
    that ``length`` found, counted by similarity."""
    least = prefix_depth(threshold, trees, length, recall)
    similarity = threshold + (np.arange(len(found)) + 0.5) * (1 - threshold) / len(found)
    every = found / chance(similarity, length, trees)
    if not every.sum():
        return least
    while length > least and (every * chance(similarity, length, trees)).sum() < recall * every.sum():
        length -= 1
    return length


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, in order, and the offsets of the documents.

    A document of fewer than ``n`` words has one shingle of all of them; without words it has none.
    """
    start, end, doc = words(data, offsets)
    docs = len(offsets) - 1
    hashes = span_hashes(data, start, end)
    count = np.bincount(doc, minlength=docs)
    shingles = window_hashes(hashes, n)
    inside = doc[: len(shingles)] == doc[n - 1 :] if len(shingles) else np.zeros(0, bool)
    shingles, owner = shingles[inside], doc[: len(inside)][inside]
    first = np.r_[0, np.cumsum(count)]
    short = [(d, mix(np.array([np.bitwise_xor.reduce(mix(hashes[first[d] : first[d + 1]] + np.arange(1, count[d] + 1, dtype=np.uint64))) + np.uint64(count[d])], np.uint64))[0]) for d in np.flatnonzero((count > 0) & (count < n))]
    if short:
        shingles = np.r_[shingles, np.array([h for _, h in short], np.uint64)]
        owner = np.r_[owner, np.array([d for d, _ in short], np.int64)]
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    once = np.r_[True, (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])][: len(shingles)]
    shingles, owner = shingles[once], owner[once]
    return shingles, np.r_[0, np.cumsum(np.bincount(owner, minlength=docs))]


def set_ids(shingles: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """128 bits for each set, from the sums of two hashes of its members; None for an empty set."""
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    out: list[bytes | None] = [None] * (len(offsets) - 1)
    if len(full):
        sums = [np.add.reduceat(mix(shingles ^ np.uint64(seed)), offsets[full]) for seed in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)]
        for i, a, b in zip(full.tolist(), *sums):
            out[i] = a.tobytes() + b.tobytes()
    return out


def signatures(shingles: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """``count`` minima a non-empty set, one row a set."""
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    out = np.zeros((len(offsets) - 1, count), np.uint32)
    if not len(full):
        return out
    rng = np.random.Generator(np.random.PCG64(20240229))
    halves = [(shingles >> np.uint64(32)).astype(np.uint32), shingles.astype(np.uint32)]
    for i in range(count):
        flip, times = np.uint32(rng.integers(1 << 32)), np.uint32(rng.integers(1 << 31) * 2 + 1)
        out[full, i] = np.minimum.reduceat((halves[i & 1] ^ flip) * times, offsets[full])
    return out


def _sets(depth: int, trees: int, id_col: str):
    @tidied
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, sig = [], [], []
            for _, _, data, offsets in blocks(batch["text"]):
                shingles, cut = shingle_sets(data, offsets)
                ids += set_ids(shingles, cut)
                size += np.diff(cut).tolist()
                sig += [row.tobytes() for row in signatures(shingles, cut, depth * trees)]
            yield pa.RecordBatch.from_arrays([batch[id_col], pa.array(ids, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())], [id_col, "set_id", "n_shingles", "sig"])

    return sets


def _tries(depth: int, least: int):
    """Neighbours of the sorted labels that agree in at least ``least`` minima; and each task's first and last row."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("shared", pa.int32()), ("part", pa.int32()), ("tree", pa.int32()), ("label", pa.binary())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        end = lambda which, row: pa.RecordBatch.from_pydict({"a": [row[2]], "b": [None], "shared": [which], "part": [part], "tree": [row[0]], "label": [row[1]]}, schema)
        for batch in batches:
            if not len(batch):
                continue
            tree, label, ids = batch["tree"].to_pylist(), batch["label"].to_pylist(), batch["set_id"].to_pylist()
            if last is None:
                yield end(-1, (tree[0], label[0], ids[0]))
                last = (tree[0], label[0], ids[0])
                shared = np.zeros(len(ids), np.int64)
            every = np.frombuffer(b"".join([last[1], *label]), "<u4").reshape(-1, depth)
            trees = np.array([last[0], *tree])
            shared = np.cumprod(every[1:] == every[:-1], axis=1).sum(axis=1) * (trees[1:] == trees[:-1])
            before = [last[2], *ids]
            at = [i for i in np.flatnonzero(shared >= least).tolist() if before[i] != ids[i]]
            yield pa.RecordBatch.from_pydict({"a": [before[i] for i in at], "b": [ids[i] for i in at], "shared": shared[at].tolist(), "part": [part] * len(at), "tree": [None] * len(at), "label": [None] * len(at)}, schema)
            last = (tree[-1], label[-1], ids[-1])
        if last is not None:
            yield end(-2, last)

    return walk


def _neighbours(classes: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """(a, b, shared): sets next to each other in some tree, and the longest prefix in which they agree."""
    spark = classes.sparkSession
    labels = [F.struct(F.lit(t).alias("tree"), F.substring("sig", t * depth * 4 + 1, depth * 4).alias("label")) for t in range(trees)]
    filed = classes.select("set_id", F.explode(F.array(*labels)).alias("at")).select("at.tree", "at.label", "set_id")
    filed = filed.repartitionByRange(partitions(spark), "tree", "label", "set_id").sortWithinPartitions("tree", "label", "set_id")
    walked = materialise(filed.mapInArrow(_tries(depth, least), "a binary, b binary, shared int, part int, tree int, label binary"), "tries")
    ends = sorted(walked.filter("shared < 0").collect(), key=lambda r: (r["part"], -r["shared"]))  # two rows a task
    over = []
    for one, other in zip(ends[1::2], ends[2::2]):
        x, y = (np.frombuffer(r["label"], "<u4") for r in (one, other))
        shared = int(np.cumprod(x == y).sum()) if one["tree"] == other["tree"] else 0
        if shared >= least and one["a"] != other["a"]:
            over.append((bytes(one["a"]), bytes(other["a"]), shared))
    found = walked.filter("shared > 0").select("a", "b", "shared").unionByName(spark.createDataFrame(over, "a binary, b binary, shared int"))
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("shared").alias("shared"))


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def _wanted_sets(wanted, bits: int, n: int, lower: bool):
    schema = pa.schema([("set_id", pa.binary()), ("shingles", pa.binary())])

    @tidied
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        for batch in batches:
            for _, _, data, offsets in blocks(batch["text"]):
                shingles, cut = shingle_sets(lowered(data) if lower else data, offsets, n)
                found = {}
                for i, x in enumerate(set_ids(shingles, cut)):
                    if x is not None and x not in found and may_hold(known, bits, x):
                        found[x] = shingles[cut[i] : cut[i + 1]].tobytes()
                if found:
                    yield pa.RecordBatch.from_pydict({"set_id": list(found), "shingles": list(found.values())}, schema)

    return texts


def shingles_of(rows: DataFrame, sets: DataFrame, n: int = WORDS, lower: bool = False) -> DataFrame:
    """(set_id, shingles) of the sets wanted, and by chance some more, from one more pass over the texts."""
    known, bits = leading_filter(sets, "set_id")
    found = rows.select("text").mapInArrow(_wanted_sets(rows.sparkSession.sparkContext.broadcast(known), bits, n, lower), "set_id binary, shingles binary")
    return found.groupBy("set_id").agg(F.first("shingles").alias("shingles"))


def _shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Members in common of each pair of a left and a right set."""
    sizes = [len(x) for x in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, member, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member, owner = member[common := count[member] > 1], owner[common]
    number = np.cumsum(count > 1) - 1
    member = number[member]
    order = np.argsort(member, kind="stable")
    member, owner = member[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    distinct = int(member[-1]) + 1 if len(member) else 0
    step = min(distinct, max(256, (2 << 20) // max(1, len(sets))))
    for low in range(0, distinct, max(1, step)):
        a, b = np.searchsorted(member, [low, low + step])
        table = np.zeros((len(sets), step), np.float32)
        table[owner[a:b], member[a:b] - low] = 1
        out += table[left] @ table[right].T
    return out


def _verified(rows: list[tuple], threshold: float, bins: np.ndarray) -> dict[str, list]:
    """Links of the sets of one pair of blocks, and the least set id that each is connected to here. Counts links by
    similarity in ``bins``."""
    low, high = rows[0][1], rows[0][2]
    sets = [np.frombuffer(r[5], np.uint64) for r in rows]
    copies, block = np.array([r[4] for r in rows], np.int64), np.array([r[6] for r in rows])
    left = np.flatnonzero(block == low)
    right = left if low == high else np.flatnonzero(block == high)
    links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
    if len(left) and len(right):
        n = np.array([len(x) for x in sets], np.float64)
        shared = _shared_counts(sets, left, right).astype(np.float64)
        near = shared * (1 + threshold) >= threshold * (n[left][:, None] + n[right][None, :]) - 1e-9
        if low == high:
            np.fill_diagonal(near, False)
        one, other = np.nonzero(near)
        some = one < other if low == high else slice(None)
        similarity = (shared[one, other] / (n[left[one]] + n[right[other]] - shared[one, other]))[some]
        bins += np.bincount(np.clip((similarity - threshold) / (1 - threshold) * BINS, 0, BINS - 1).astype(int), minlength=BINS)
        links[left] += (near * copies[right][None, :]).sum(axis=1)
        if low != high:
            links[right] += (near * copies[left][:, None]).sum(axis=0)
        while True:  # labels go along links to the least position
            down = np.where(near, root[right][None, :], len(rows)).min(axis=1)
            new = root.copy()
            new[left] = np.minimum(new[left], down)
            up = np.where(near, new[left][:, None], len(rows)).min(axis=0)
            new[right] = np.minimum(new[right], up)
            new = new[new]
            if (new == root).all():
                break
            root = new
    ids = [r[3] for r in rows]
    return {"set_id": ids, "links": links.tolist(), "root": [ids[i] for i in root.tolist()], "split": [r[7] > 1 for r in rows]}


LINKS = "set_id binary, links long, root binary, split boolean, bins array<long>"


def _verify(threshold: float):
    schema = pa.schema([("set_id", pa.binary()), ("links", pa.int64()), ("root", pa.binary()), ("split", pa.bool_()), ("bins", pa.list_(pa.int64()))])

    @tidied
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bins = np.zeros(BINS, np.int64)
        out: dict[str, list] = {n: [] for n in schema.names}

        def close() -> None:
            for name, values in _verified(held, threshold, bins).items():
                out[name] += values
            held.clear()

        def closed() -> pa.RecordBatch:
            out["bins"] = [None] * len(out["set_id"])
            return pa.RecordBatch.from_pydict(out, schema)

        for batch in batches:
            for row in zip(*(batch[n].to_pylist() for n in ("group", "low", "high", "set_id", "copies", "shingles", "block", "n_blocks"))):
                if held and held[0][:3] != row[:3]:
                    close()
                held.append(row)
            if len(out["set_id"]) > 10_000:
                yield closed()
                out = {n: [] for n in schema.names}
        if held:
            close()
        yield closed()
        yield pa.RecordBatch.from_pydict({"set_id": [None], "links": [0], "root": [None], "split": [False], "bins": [bins.tolist()]}, schema)

    return verify


def linked_in_groups(edges: DataFrame, classes: DataFrame, shingles: DataFrame, threshold: float) -> tuple[DataFrame, np.ndarray]:
    """Links within the groups that ``edges`` connect, and their numbers by similarity."""
    spark = edges.sparkSession
    roots = components(edges)
    members = materialise(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "nodes")
    members = materialise(members.withColumnRenamed("node", "set_id").join(classes.select("set_id", "copies", "n_shingles"), "set_id"), "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("all"))
    n_blocks = F.greatest(F.ceil(F.col("size") / BLOCK_SETS), F.ceil(F.col("all") / BLOCK_MEMBERS)).cast("int")
    members = join_heavy(members, sizes, "root", "size", members.count()).select("set_id", "copies", F.col("root").alias("group"), n_blocks.alias("n_blocks"))
    dealt = members.join(shingles, "set_id")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("n_blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    dealt = dealt.repartition(partitions(spark), "group", "low", "high").sortWithinPartitions("group", "low", "high")
    links = materialise(dealt.select("group", "low", "high", "set_id", "copies", "shingles", "block", "n_blocks").mapInArrow(_verify(threshold), LINKS), "links")
    counted = links.filter("bins IS NOT NULL").select(F.posexplode("bins").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS rows
    bins = np.zeros(BINS)
    for r in counted:
        bins[r["bin"]] = r["n"]
    return links.filter("set_id IS NOT NULL"), bins


def _classes(rows: DataFrame, full: DataFrame, classes: DataFrame, threshold: float, trees: int, depth: int, recall: float) -> DataFrame:
    """(set_id, links, class_id, class_key) of the sets that have candidates."""
    least = prefix_depth(threshold, trees, depth, recall)
    edges = materialise(_neighbours(full, trees, depth, least), "edges")
    candidates = materialise(edges.select(F.col("a").alias("set_id")).unionByName(edges.select(F.col("b").alias("set_id"))).distinct(), "candidates")
    shingles = materialise(shingles_of(rows, candidates).join(candidates, "set_id", "left_semi"), "shingles")
    length = depth
    while True:
        links, bins = linked_in_groups(edges.filter(F.col("shared") >= length).select("a", "b"), classes, shingles, threshold)
        shorter = next_length(bins, length, threshold, trees, recall)
        if shorter == length:
            break
        length = shorter

    roots = links.filter("NOT split AND set_id != root").select(F.col("set_id").alias("node"), "root")
    if not links.filter("split").isEmpty():
        roots = roots.unionByName(components(links.filter("split").select(F.col("set_id").alias("a"), F.col("root").alias("b"))))
    total = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    linked = total.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = materialise(linked.join(classes.select("set_id", "least"), "set_id"), "linked")
    names = named.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("n"))
    return join_heavy(named, names, "root", "n", named.count()).select("set_id", "links", "class_id", F.col("root").alias("class_key"))


def similar(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """One row per document: id, class_id, n_links, n_shingles, set_id, class_key.

    ``n_links`` is the number of other documents at a similarity of the threshold or more, copies
    included; ``class_id`` the least id of all documents connected by links (``class_key`` tells classes apart even
    where ids repeat). Words are runs of other than
    ASCII white space, as they stand. A document of one to four words has one shingle. Null texts and
    texts without words have no shingles, no links and their own id as class. Repeated rows are copies;
    null ids count as documents but name a class only if all of its ids are null. An empty table gives
    an empty result. Only the two named columns are read.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kept = storage.shared_folder(spark)
    with storage.scope(spark):  # signatures, tries and shingles go when the links are known
        signed = materialise(rows.mapInArrow(_sets(depth, trees, id_col), f"`{id_col}` {kind}, set_id binary, n_shingles long, sig binary"), "sets")
        every = storage.materialise(signed.drop("sig"), f"{kept}/every")
        full = signed.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.count("*").alias("copies"), F.min(id_col).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        full = materialise(full, "classes")
        classes = storage.materialise(full.drop("sig"), f"{kept}/classes")
        named = storage.materialise(_classes(rows, full, classes, threshold, trees, depth, recall), f"{kept}/named")
    answer = classes.select("set_id", "copies", "least").join(named, "set_id", "left").select(
        "set_id", "copies", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("class_key", "set_id").alias("class_key"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0).cast("long"))).alias("n_links")
    )
    own = every.select(id_col, "set_id", "n_shingles").filter("set_id IS NOT NULL")
    columns = [id_col, "class_id", "n_links", "n_shingles", "set_id", "class_key"]
    none = every.filter("set_id IS NULL").select(id_col, F.col(id_col).alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_shingles", "set_id", F.lit(None).cast("binary").alias("class_key"))
    return join_heavy(own, answer, "set_id", "copies", every.count()).select(columns).unionByName(none.select(columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, one document of each class; texts without words all stay. Only texts of the ids that go are
    looked at again."""

    def mark(rows: DataFrame, name: str) -> DataFrame:
        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [x for _, _, data, offsets in blocks(batch[text_col]) for x in set_ids(*shingle_sets(data, offsets))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*batch.schema.names, name])

        return rows.mapInArrow(marked, StructType(list(rows.schema.fields)).add(name, "binary"))

    found = similar(docs, id_col=id_col, text_col=text_col).filter("set_id IS NOT NULL").select(F.col(id_col).alias("id"), "set_id", "class_key", "class_id")
    pairs = materialise(found.groupBy("id", "set_id", "class_key", "class_id").agg(F.count("*").alias("n")), "documents")
    # of a class whose least id stands on several sets, one set stays
    stay = pairs.filter(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("class_key").agg(F.min("set_id").alias("set_id"), F.first("id").alias("kept_id"))
    stay = stay.select("set_id", "kept_id", F.lit(True).alias("stays"))
    match = (F.col("p.set_id") == F.col("s.set_id")) & F.col("p.id").eqNullSafe(F.col("s.kept_id"))
    pairs = pairs.alias("p").join(stay.alias("s"), match, "left").select("p.id", F.col("p.set_id").alias("mark"), F.coalesce("stays", F.lit(False)).alias("stays"), "n")
    return without(docs, pairs, id_col, mark)
