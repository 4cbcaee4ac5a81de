"""Near duplicates against brute force over all pairs of documents."""

import random
import re
from collections import defaultdict

import numpy as np
from quarry.llm import near_dedup
from quarry.llm.common import read


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if len(words) == 1 else set(zip(words, words[1:]))


def by_force(rows):
    """(id, size, component) by an inverted index of all shingles."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, s in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < k:
                    both[j] += 1
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[top(k)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        own = least.get(top(k))
        least[top(k)] = i if own is None else own if i is None else min(own, i)
    return sorted(((i, len(sets[k]), least[top(k)], i == least[top(k)]) for k, (i, _) in enumerate(rows)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_near_duplicates(spark, docs, clashing, none):
    want = by_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found(near_dedup.near_duplicates(docs)) == want
    assert found(near_dedup.near_duplicates(clashing)) == want
    assert near_dedup.near_duplicates(none).count() == 0
    assert any(i != c for i, _, c, _ in want)


def test_near_duplicates_of_the_smallest_table(spark, sf_dir):
    table = read(spark, sf_dir, "documents")
    assert found(near_dedup.near_duplicates(table)) == by_force([(r["doc_id"], r["text"]) for r in table.collect()])


def test_links_that_no_star_has(spark):
    """Chains: each text is near the next one but not those further on; and families with some members on the edge."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, i = [], 0
    for _ in range(12):
        text = [word() for _ in range(80)]
        for _ in range(25):
            rows.append((i, " ".join(text)))
            i += 1
            for _ in range(3):
                text[rng.randrange(80)] = word()
    for size in (60, 120):
        text = [word() for _ in range(size)]
        for _ in range(60):
            own = list(text)
            for _ in range(rng.randrange(size // 10)):
                own[rng.randrange(size)] = word()
            rows.append((i, " ".join(own)))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = by_force(rows)
    got = found(near_dedup.near_duplicates(df))
    assert len({c for _, _, c, _ in want}) < len(rows) / 2
    assert got == want
    few = found(near_dedup.near_duplicates(df, bands=40, rows=4))  # buckets of many unlike sets
    assert few == want


def test_bins_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    some = lambda n: np.frombuffer(rng.bytes(8 * n), np.uint64)
    for size in (5, 40, 2000):
        rate = []
        for _ in range(200):
            both = some(size)
            one, two = np.unique(np.r_[both, some(size // 4)]), np.unique(np.r_[both, some(size // 5)])
            s = near_dedup.densified(np.r_[one, two], np.array([0, len(one), len(one) + len(two)]), 192)
            rate.append((s[0] == s[1]).mean() - size / (size + size // 4 + size // 5))
        assert abs(np.mean(rate)) < 0.03


def test_a_hot_family(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[: k % 50] + [f"x{k}"] + base[k % 50 + 1 :])) for k in range(900)] + [(5000 + k, f"other text number {k} of its own {k * k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(near_dedup.near_duplicates(df)) == by_force(rows)


def test_a_bucket_over_many_tasks_is_chained(spark):
    rows = [(1, [7, 8], b"a" * 16), (2, [7, 9], b"b" * 16)] + [(3, [7, 100 + k], bytes([c + 1]) * 16) for k, c in enumerate(range(98, 240))]
    classes = spark.createDataFrame([(k, i) for _, k, i in rows], "keys array<long>, set_id binary")
    members, edges = near_dedup._starred(classes)
    assert members.filter("key = 7").count() == len(rows) and edges.count() == len(rows) - 1
    seen, root = set(), {}
    for r in edges.collect():
        root[bytes(r["b"])] = bytes(r["a"])
        seen |= {bytes(r["a"]), bytes(r["b"])}
    for x in seen:
        while x in root:
            x = root[x]
        assert x == b"a" * 16
