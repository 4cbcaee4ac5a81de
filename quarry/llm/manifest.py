"""Merkle manifest of a table: a root over all rows, and for each row the proof that it belongs to it.

1. A row's leaf is the digest of its columns. Leaves of a source are numbered in order of their id: rows are dealt by
   range, a partition's rows are numbered where they lie, and the counts of the partitions before are added.
2. Every FAN**LEVELS successive leaves of a source are one group, however many the source has, and become one
   node. Nodes are reduced alike until at most TOP are left.
3. The driver builds the top tree over these nodes (the rest of the sources' trees, and the tree of sources) and
   broadcasts each node's path to the root. Where the sources alone are more than TOP, their tree is reduced by Spark, too.
4. Tasks finish the proofs within their blocks and fold each row's leaf, or that of its tampered copy, up to the root.

A digest's hex text is what is hashed; between steps it travels as 32 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import storage
from quarry.llm.common import bounded_batches, join_heavy, materialise, partitions

#: Nodes of a run, levels in a block, and nodes that the driver may hold (a path of each: about 1 kB).
FAN, LEVELS, TOP = 3, 6, 1 << 14
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Path = list[tuple[int, list[bytes]]]


def hashed(parts: list[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def reduced(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes and so many levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([hashed(out[-1][i : i + FAN]) for i in range(0, len(out[-1]), FAN)])
    return out


def path_of(levels: list[list[bytes]], i: int) -> Path:
    """For each level below the last one the place of node ``i`` in its run, and the run's others."""
    out = []
    for level in levels[:-1]:
        first = i // FAN * FAN
        run = level[first : first + FAN]
        out.append((i - first, run[: i - first] + run[i - first + 1 :]))
        i //= FAN
    return out


def fold(digest: bytes, path: Path) -> bytes:
    for place, others in path:
        digest = hashed([*others[:place], digest, *others[place:]])
    return digest


def packed(path: Path) -> bytes:
    return b"".join(bytes([place, len(others)]) + bytes.fromhex(b"".join(others).decode()) for place, others in path)


def unpacked(data: bytes) -> Path:
    out, at = [], 0
    while at < len(data):
        place, count = data[at], data[at + 1]
        hexed = data[at + 2 : at + 2 + 32 * count].hex().encode()
        out.append((place, [hexed[64 * i : 64 * i + 64] for i in range(count)]))
        at += 2 + 32 * count
    return out


def digest_of(columns: list[Column]) -> Column:
    """Of each column ``-`` if it is null, else its UTF-8 bytes' number, a colon and the value."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (written) with ``idx``, their number from 0 within ``tree`` in order of ``keys``, and ``n``, the rows of the tree.

    A tree's rows are never gathered: ranges of (tree, keys) are dealt, rows that agree in all by a number of their own.
    """
    spread = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    order = ["tree", *keys, "tie"]
    dealt = spread.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = materialise(dealt.withColumns({"part": F.shiftright("at", 33).cast("int"), "row": F.expr("at & 8589934591")}).drop("at", "tie"), "ranges")
    runs = materialise(dealt.groupBy("part", "tree").agg(F.min("row").alias("first"), F.count("*").alias("rows")), "runs")
    # a tree has at most one run a partition, so its runs are few
    before = F.expr("coalesce(sum(rows) OVER (PARTITION BY tree ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    runs = runs.select("part", "tree", "first", before.alias("before"), F.expr("sum(rows) OVER (PARTITION BY tree)").alias("n"))
    return dealt.join(runs, ["part", "tree"]).withColumn("idx", F.col("row") - F.col("first") + F.col("before")).drop("part", "row", "first", "before")


def _blocks(nodes: DataFrame, carried: list[str], levels: int) -> DataFrame:
    """(tree, block, n, items): up to FAN**levels successive nodes, in order."""
    item = F.struct("idx", *carried)
    return nodes.groupBy("tree", F.floor(F.col("idx") / FAN**levels).cast("long").alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))


def _reduced_by_spark(blocks: DataFrame, levels: int) -> DataFrame:
    """(tree, idx, n, digest): the node of each block, among the n of its tree."""
    schema = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["n"].to_pylist()
            found = [reduced([d.hex().encode() for d in own], min(levels, height(n)))[-1][0] for n, own in zip(sizes, batch["digests"].to_pylist())]
            yield pa.RecordBatch.from_pydict({"tree": batch["tree"], "idx": batch["block"], "n": [-(-n // FAN**levels) for n in sizes], "digest": [bytes.fromhex(d.decode()) for d in found]}, schema)

    digests = F.transform("items", lambda x: x["digest"])
    return materialise(blocks.select("tree", "block", "n", digests.alias("digests")).mapInArrow(roots, "tree string, idx long, n long, digest binary"), "nodes")


PATHS = "tree string, idx long, path binary, subroot binary"


def _paths(levels: int):
    schema = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary())])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = reduced([x["digest"].hex().encode() for x in row["items"]], min(levels, height(row["n"])))
                own = [packed(path_of(tree, i)) + row["path"] for i in range(len(row["items"]))]
                yield pa.RecordBatch.from_pydict({"tree": [row["tree"]] * len(own), "idx": [x["idx"] for x in row["items"]], "path": own, "subroot": [row["subroot"]] * len(own)}, schema)

    return paths


def _climbed(nodes: DataFrame, top: int, levels: int) -> DataFrame:
    """(tree, idx, path, subroot): the path of each node to its tree's root."""
    count, most = nodes.agg(F.count("*"), F.max("n")).first()
    if count <= top:
        trees: dict[str, list[bytes]] = {}
        for r in sorted(nodes.collect(), key=lambda r: (r["tree"], r["idx"])):  # at most ``top`` rows
            trees.setdefault(r["tree"], []).append(bytes(r["digest"]).hex().encode())
        rows = []
        for tree, own in trees.items():
            grown = reduced(own, height(len(own)))
            root = bytes.fromhex(grown[-1][0].decode())
            rows += [(tree, i, bytearray(packed(path_of(grown, i))), bytearray(root)) for i in range(len(own))]
        return nodes.sparkSession.createDataFrame(rows, PATHS)
    if most == 1:
        return nodes.select("tree", "idx", F.lit(b"").alias("path"), F.col("digest").alias("subroot"))
    blocks = materialise(_blocks(nodes, ["digest"], levels), "upper")
    above = _climbed(_reduced_by_spark(blocks, levels), top, levels).withColumnRenamed("idx", "block")
    return blocks.join(above, ["tree", "block"]).mapInArrow(_paths(levels), PATHS)


def _suffixes(nodes: DataFrame, top: int, levels: int) -> DataFrame:
    """(tree, block, path, subroot, root): the path of each block's node to the root of all."""
    climbed = materialise(_climbed(nodes, top, levels), "climbed")
    roots = climbed.filter("idx = 0").select(F.col("tree").alias("name"), F.col("subroot").alias("digest"), F.lit("").alias("tree"))
    roots = materialise(numbered(roots, ["name"]), "sources")
    forest = roots.select("tree", "idx", "n", "digest")
    few = roots.count() <= top
    above = _climbed(forest, top, levels).select("idx", F.col("path").alias("rest"), F.col("subroot").alias("root"))
    sources = materialise(roots.select("name", "idx").join(above, "idx").select(F.col("name").alias("tree"), "rest", "root"), "rests")
    if few:
        joined = climbed.join(F.broadcast(sources), "tree")
    else:
        sources = sources.join(climbed.groupBy("tree").agg(F.count("*").alias("rows")), "tree")
        joined = join_heavy(climbed, sources, "tree", "rows", climbed.count())
    return materialise(joined.select("tree", F.col("idx").alias("block"), F.concat("path", "rest").alias("path"), "subroot", "root"), "suffixes")


def _proofs(levels: int):
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.select(["n", "path", "subroot", "root"]).to_pylist()):
                items = batch["items"][k].values
                leaves, others = [d.hex().encode() for d in items.field("digest").to_pylist()], items.field("tampered").to_pylist()
                tree, suffix = reduced(leaves, min(levels, height(row["n"]))), unpacked(row["path"])
                root, out = row["root"].hex(), {n: [] for n in names}
                for i, (leaf, other) in enumerate(zip(leaves, others)):
                    path = path_of(tree, i) + suffix
                    folded = fold(leaf if other is None else other.hex().encode(), path).decode()
                    for name, value in zip(names, (leaf.decode(), row["subroot"].hex(), root, hashed([d for _, run in path for d in run]).decode(), folded, folded == root)):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays([items.field("id"), *(pa.array(out[n], pa.bool_() if n == "verified" else pa.string()) for n in names)], ["id", *names])

    return proofs


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", top: int = TOP, levels: int = LEVELS) -> DataFrame:
    """One row per document: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaf covers ``fields``. ``folded_root`` is computed from the leaf of the text with all line feeds deleted where the
    CRC-32 of the decimal id is even, else from the leaf as it is, and the row's siblings; ``verified`` is whether it is the
    root, so a text without a line feed is verified in any case. Null columns are ``-`` in the leaf; a null source is a source
    of its own before all others, a null id comes first in its source and isn't tampered with. Rows of one id are ordered by
    their leaves, and rows that agree in both have a place each. Empty texts are values, not nulls. A single row is subroot
    and root, with the proof of no siblings. An empty table gives an empty result. Further columns are not read.
    """
    spark = docs.sparkSession
    tamper = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(2)) == 0
    shorn = F.translate(F.col(text_col), "\n", "")
    columns = {name: F.col(name) for name in fields}
    changed = F.when(tamper & F.col(text_col).contains("\n"), digest_of([*(columns | {text_col: shorn}).values()]))
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("tree"), F.col(id_col).alias("id"), digest_of([*columns.values()]).alias("digest"), changed.alias("tampered"))
    kept = storage.shared_folder(spark)
    with storage.scope(spark):
        leaves = materialise(rows, "leaves")
        blocks = storage.materialise(_blocks(numbered(leaves, ["id", "digest"]), ["id", "digest", "tampered"], levels), f"{kept}/blocks")
        suffixes = storage.materialise(_suffixes(_reduced_by_spark(blocks, levels), top, levels), f"{kept}/suffixes")
        few = suffixes.count() <= top
    joined = bounded_batches(blocks).join(F.broadcast(suffixes) if few else suffixes, ["tree", "block"])
    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.select("n", "path", "subroot", "root", "items").mapInArrow(_proofs(levels), f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_col)


def _sql() -> str:
    """DuckDB SQL for ``manifest``: the trees level by level, then each row's way up its own."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in FIELDS) + ")"
    table = "list_transform(range(256), lambda b: list_reduce(list_concat([b::BIGINT], list_transform(range(8), lambda i: i::BIGINT)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)))"
    crc = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))"
    grown = f"SELECT tree, l + 1, i // {FAN}, sha256(string_agg(h, '' ORDER BY i)), CAST(ceil(any_value(n) / {FAN}) AS BIGINT) FROM %s WHERE n > 1 GROUP BY tree, l, i // {FAN}"
    siblings = f"(SELECT string_agg(CASE WHEN o.i = s.j THEN '' ELSE o.h END, '' ORDER BY o.i) FROM %s o WHERE o.tree IS NOT DISTINCT FROM s.tree AND o.l = s.l AND o.i // {FAN} = s.j // {FAN})"
    whole = f"(SELECT sha256(string_agg(CASE WHEN o.i = s.j THEN s.d ELSE o.h END, '' ORDER BY o.i)) FROM %s o WHERE o.tree IS NOT DISTINCT FROM s.tree AND o.l = s.l AND o.i // {FAN} = s.j // {FAN})"
    climb = lambda name, start, tree: f"{name} AS (SELECT 0 AS l, * FROM ({start}) UNION ALL SELECT l + 1, k, tree, j // {FAN}, up, d2, proof FROM (SELECT s.*, {whole % tree} AS d2, s.p || {siblings % tree} AS proof FROM {name} s WHERE s.up > s.l))"
    return (
        f"WITH RECURSIVE crcs AS MATERIALIZED (SELECT {table} AS t), base AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, source AS tree, {leaf('text')} AS leaf, text, lang, n_chars, source, "
        f"coalesce(xor({crc}, 4294967295) % 2 = 0, false) AS tamper FROM documents, crcs), "
        f"leaves AS MATERIALIZED (SELECT k, doc_id, tree, leaf, CASE WHEN tamper THEN {leaf(chr(40) + 'replace(text, chr(10), ' + chr(39) * 2 + ')' + chr(41))} ELSE leaf END AS other, "
        "row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM base), "
        f"trees AS (SELECT tree, 0 AS l, i, leaf AS h, n FROM leaves UNION ALL ({grown % 'trees'})), "
        "subroots AS MATERIALIZED (SELECT tree, l AS top, h FROM trees WHERE n = 1), "
        "ranked AS MATERIALIZED (SELECT tree AS name, '' AS tree, h, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM subroots), "
        f"upper AS (SELECT tree, 0 AS l, i, h, n FROM ranked UNION ALL ({grown % 'upper'})), "
        "top AS MATERIALIZED (SELECT l AS top, h FROM upper WHERE n = 1), "
        "done AS MATERIALIZED (SELECT * FROM trees), done_upper AS MATERIALIZED (SELECT * FROM upper), "
        f"{climb('one', 'SELECT k, s.tree, i AS j, r.top AS up, other AS d, CAST(' + chr(39) * 2 + ' AS VARCHAR) AS p FROM leaves s JOIN subroots r ON r.tree IS NOT DISTINCT FROM s.tree', 'done')}, "
        "below AS MATERIALIZED (SELECT * FROM one WHERE l = up), "
        f"{climb('two', 'SELECT k, CAST(' + chr(39) * 2 + ' AS VARCHAR) AS tree, r.i AS j, t.top AS up, d, p FROM below b JOIN ranked r ON r.name IS NOT DISTINCT FROM b.tree, top t', 'done_upper')} "
        "SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(w.p) AS proof_sha256, w.d AS folded_root, w.d = t.h AS verified "
        "FROM leaves a JOIN two w ON w.k = a.k AND w.l = w.up JOIN subroots s ON s.tree IS NOT DISTINCT FROM a.tree, top t"
    )


SQL = _sql()
