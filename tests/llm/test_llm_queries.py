"""The registered queries against their SQL, and the pipeline's stages."""

import os
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarry import storage
from quarry.llm import language, mixing, queries
from quarry.llm.common import materialise, read

from test_operators import links_by_force


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{sf_dir}/{table}'")
    want = con.sql(queries.SQL[name]).df()
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == columns
    assert got[columns].sort_values(columns).values.tolist() == want[columns].sort_values(columns).values.tolist()


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_query_gives_a_row_for_each_row(spark, sf_dir, name):
    table = "pages" if name.startswith("op5_") else "documents"
    rows = queries.QUERIES[name](spark, sf_dir).count()
    assert rows >= read(spark, sf_dir, table).count() if name.startswith("op10_") else rows == read(spark, sf_dir, table).count()


def test_pipeline(spark, sf_dir):
    """Every stage against brute force on what its predecessor kept."""
    docs = read(spark, sf_dir, "documents")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        kept.append(docs.collect())
    first = read(spark, sf_dir, "documents")
    judged = language.predict(first, language.fit(first)).collect()
    assert ids(kept[0]) == sorted(r["doc_id"] for r in judged if r["lang_pred"] != "und" and r["score"] >= language.REJECT)
    assert len(kept[0]) >= 0.99 * len(judged)

    groups = defaultdict(list)
    for r in kept[0]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"]))
    assert ids(kept[1]) == sorted(min(g)[1] for g in groups.values())

    rows = [(r["doc_id"], r["text"]) for r in kept[1]]
    assert ids(kept[2]) == sorted(i for i, c, _, n in links_by_force(rows) if i == c or not n)

    drawn = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(kept[2], first.schema)).collect()})
    assert Counter(r["doc_id"] for r in kept[3]) == +drawn and all(r["text"] == dict(rows)[r["doc_id"]] for r in kept[3])

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in kept[3]:
        own = np.array([*model.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((r["doc_id"], k // 2048, k, len(p := own[k : k + 2048]), zlib.crc32(p.tobytes())) for k in range(0, len(own), 2048))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in kept[4]) == want
    filled = defaultdict(list)
    for r in kept[4]:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) <= 2048 and [o for o, _ in sorted(own)] == list(np.cumsum([0, *(n for _, n in sorted(own)[:-1])])) for own in filled.values())


def test_pipeline_of_no_documents(spark, tmp_path, sf_dir):
    read(spark, sf_dir, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_removes_its_intermediate_tables(spark, sf_dir):
    made = Path(storage.shared_folder(spark).removeprefix("file:")).parent
    before = set(made.glob("quarry-*"))
    docs = corpus_pipeline.run(spark, sf_dir)
    assert docs.count() > 0 and len(set(made.glob("quarry-*")) - before) == 1


def ids(rows):
    return sorted(r["doc_id"] for r in rows)
