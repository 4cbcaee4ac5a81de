"""Very long near copies in one group: blocks are bounded by members, too."""

import random

from quarry.llm import jaccard_join

from test_operators import links_by_force


def test_long_sets_are_dealt_to_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    rows = []
    for i in range(10):
        own = list(base)
        for _ in range(60):
            own[rng.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, f"some other text of its own {i} with words {i * i}") for i in range(20)]
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 20_000)  # read where the plan is made
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: (c, n) for i, c, n, _ in links_by_force(rows)}
    assert got[9] == (0, 9)
