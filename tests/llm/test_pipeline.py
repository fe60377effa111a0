"""The pipeline's stages on a small table, each against a plain version of its own input."""

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from quotecast.llm.queries import ORACLES
from quotecast.llm.tables import written

from test_operators import WORDS, plain_components

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def told(sql, frame, columns):
    con = duckdb.connect()
    con.register("documents", frame)
    return con.execute(f"SELECT {columns} FROM ({sql})").fetchall()


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, pieces = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = written(stage(spark, docs, FOLDER))
        after = docs.toPandas()
        if name == "packing":
            pieces = after
            tokens = after.groupby("sequence_id").length.sum()
            assert tokens.max() <= 1024 and tokens.mean() > 900
            assert Counter(after[after.start == 0].doc_id) == Counter(before.doc_id)
            whole = after[after.start == 0].doc_tokens.sum()
            assert after.length.sum() == whole
            continue
        assert list(after.columns) == columns
        kept = Counter(after.doc_id)
        if name == "quality_rules":
            want = Counter(d for d, k in told(ORACLES["op2_quality"], before, "doc_id, kept") if k)
        elif name == "exact_dedup":
            want = Counter(d for d, k in told(ORACLES["op3_exact_dedup"], before, "doc_id, kept") if k)
        elif name == "minhash_near_dedup":
            want = Counter(c for d, _, c in plain_components(list(zip(before.doc_id.tolist(), before.text)), 5, 80) if d == c)
        else:
            plan = {d: (s, t) for d, s, t in told(ORACLES["op10_mixing"], before, "doc_id, size, taken")}
            want = Counter({d: -(-t // s) for d, (s, t) in plan.items() if t})
            words = Counter()
            for d, text in zip(after.doc_id, after.text):
                words[d] += len(WORDS.findall(text))
            assert words == Counter({d: t for d, (_, t) in plan.items() if t})
        assert kept == want, name
    run = corpus_pipeline.run(spark, FOLDER).toPandas()
    parts = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(map(tuple, run[parts].to_numpy())) == Counter(map(tuple, pieces[parts].to_numpy()))
