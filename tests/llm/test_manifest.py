"""The Merkle manifest against trees built in plain Python."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quarry.llm import manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def tree(nodes):
    """Root, and for each node the runs it is in on its way up."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            ways[k].append((i % 3, nodes[i // 3 * 3 : i // 3 * 3 + 3]))
        nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], ways


def by_force(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(sources[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"], leaf(r)))
        trees[s] = (own, *tree([leaf(r) for r in own]))
    root, above = tree([trees[s][1] for s in order])
    out = []
    for s, up in zip(order, above):
        own, subroot, ways = trees[s]
        for r, way in zip(own, ways):
            cut = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            d = leaf(r | {"text": r["text"].replace("\n", "")}) if cut else leaf(r)
            for place, run in way + up:
                d = h(*run[:place], d, *run[place + 1 :])
            proof = h(*(x for place, run in way + up for x in run[:place] + run[place + 1 :]))
            out.append((r["doc_id"], leaf(r), subroot, root, proof, d, d == root))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("top, levels", [(manifest.TOP, 6), (2, 1), (40, 2)])
def test_manifest(spark, docs, top, levels):
    """All levels at the driver, all by Spark (more sources than the driver may hold, too), and some of both."""
    want = by_force([r.asDict() for r in docs.collect()])
    assert found(manifest.manifest(docs, top=top, levels=levels)) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_manifest_of_clashing_columns_and_few_rows(spark, clashing, docs, none):
    assert found(manifest.manifest(clashing)) == found(manifest.manifest(docs))
    assert manifest.manifest(none).count() == 0
    one = docs.filter("doc_id = 7")
    row = manifest.manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == h()


def test_equal_rows_are_dealt_to_many_tasks(spark, docs):
    same = docs.filter("doc_id = 7").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(900)))).drop("k")
    assert found(manifest.manifest(same)) == by_force([r.asDict() for r in same.collect()])
