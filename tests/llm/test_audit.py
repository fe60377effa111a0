"""Filter audit against a run of every order, row by row."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

import quotecast.llm.audit as module
from quotecast.llm import queries
from quotecast.llm.audit import audit, possible_repeats

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, key string, n int, id string"


def prose(seed, n, vocabulary):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, vocabulary, n))


LONG = prose(1, 40_000, 30_000)
DOCS = [
    (1, prose(2, 300, 200), "a"),
    (2, prose(2, 300, 200), "b"),
    (2, prose(2, 300, 200), "b"),
    (3, prose(3, 300, 20), "a"),
    (4, None, "a"),
    (5, "", None),
    (6, " \t\n", ""),
    (7, LONG, "b"),
    (8, LONG + " #", "b"),
    (9, LONG, None),
    (None, LONG, "b"),
    (None, "only null ids", "c"),
    (None, "only null ids", "c"),
    (10, "SHOUT " * 250, "a"),
    (11, "Ünï É" * 90, "b"),
    (12, prose(2, 300, 200) + " ", "a"),
    (12, prose(2, 300, 200) + " $", "a"),
    (0, "later text, smaller id", "d"),
    (13, "later text, smaller id", "d"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (7, 1, 1), (9, None, None), (None, 1, 1), (99, 1, 1), (13, 1, 0), (0, 0, 0)]
FILTERS = {
    "A": lambda t, ws: len(ws) < 200,
    "B": lambda t, ws: 100 * len(set(ws)) < 50 * len(ws),
    "C": lambda t, ws: 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
    "D": lambda t, ws: bool(re.search(r"[#$%&*|]", t)),
}


def plain(docs, labels):
    ids = defaultdict(set)
    for i, t, _ in docs:
        ids[t or ""].add(i)
    good, toxic = ({i for i, *q in labels if i is not None and q[k] == 1} for k in (0, 1))
    rows = []
    for i, t, p in docs:
        t = t or ""
        ws = WORDS.findall(t)
        fails = {x for x, f in FILTERS.items() if f(t, ws)}
        if any(o is not None and (i is None or o < i) for o in ids[t]):
            fails.add("E")
        rows.append((p or "", fails, i in good, i in toxic))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            all_of, removed_before = left, []
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                shapley[part, x] += len(gone)
                out.append([
                    part, order, step, len(left), len(gone), sum(x in r[1] for r in removed_before),
                    sum(r[1] == {x} for r in all_of), sum(r[2] for r in gone), sum(r[3] for r in gone)])
                removed_before += gone
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, "en", s, 1, "p", 2, "k", 3, "i") for i, t, s in DOCS], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def run(spark, docs, labels, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return sorted(map(tuple, queries.QUERIES["op12_filter_audit"](spark, str(tmp_path)).collect()))


def test_every_order_row_by_row(spark, table, labels, tmp_path):
    assert run(spark, table, labels, tmp_path) == plain(DOCS, LABELS)


@pytest.mark.parametrize("keys", [0, 10**6])
def test_both_joins_of_the_texts(spark, table, labels, tmp_path, keys, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_KEYS", keys)
    assert run(spark, table, labels, tmp_path) == plain(DOCS, LABELS)


def test_a_third_of_all_rows_equal(spark, labels, tmp_path):
    docs = [(i, "same" if i % 3 == 0 else f"text {i}", "a" if i % 2 else "b") for i in range(1, 1501)]
    df = spark.createDataFrame([(i, t, "en", s, 1, "p", 2, "k", 3, "i") for i, t, s in docs], SCHEMA).repartition(7)
    assert run(spark, df, labels, tmp_path) == plain(docs, LABELS)


def test_empty_tables(spark, table, labels, tmp_path):
    assert run(spark, table.where("false"), labels.where("false"), tmp_path) == []


def test_own_filters_without_labels(spark, table):
    got = audit(table, {"x": F.col("doc_id") > 5, "y": F.col("text").isNull()}, repeat="z").collect()
    assert len(got) == 6 * 3 * len({s or "" for *_, s in DOCS})
    assert {r["good_lost"] for r in got} == {0}
    for r in got:
        if r["step"] == 3:
            fails = sum((s or "") == r["part"] and ((i or 0) > 5 or t is None) for i, t, s in DOCS)
            assert r["kept"] <= sum((s or "") == r["part"] for *_, s in DOCS) - fails
    with pytest.raises(ValueError):
        audit(table, {x: F.lit(True) for x in "abcdef"})


def test_sketch_never_clears_a_repeat(spark):
    keys = [f"k{i}" for i in range(20_000)] + [f"k{i}" for i in range(0, 20_000, 10)] * 2 + ["hot"] * 7000
    got = possible_repeats(spark.createDataFrame([(k,) for k in keys], "key string").repartition(6), "key")
    flags = {r["key"]: r["possible"] for r in got.distinct().collect()}
    often = Counter(keys)
    assert len(flags) == len(often) and all(flags[k] for k, n in often.items() if n > 1)
    once = [k for k, n in often.items() if n == 1]
    assert sum(flags[k] for k in once) < 0.02 * len(once)
    assert got.count() == len(keys)
