"""Operators on hand-made rows against plain versions: nulls, empty and long texts, ties, repeats, clashes."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import quotecast.llm.licenses as licenses
import quotecast.llm.minhash as minhash
from quotecast.llm.components import components
from quotecast.llm.exact import drop_exact_copies, exact_groups
from quotecast.llm.licenses import NOTICES, edits_allowed, scan
from quotecast.llm.lines import line_dedup
from quotecast.llm.lm import score
from quotecast.llm.mixing import mix, mixed, source_targets
from quotecast.llm.packing import Encoder, differencing, pieces, windows
from quotecast.llm.quality import keep_good, rate
from quotecast.llm.substrings import substring_dedup
from quotecast.llm.tables import numbered, running
from quotecast.llm.urls import canonical, judge, parts
from quotecast.llm.words import batches

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
# Extra columns carry names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, row long, n long, key string, _doc int, prefix string, size int"


def prose(seed, n, vocabulary=400):
    draw = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in draw.integers(0, vocabulary, n))


LONG = prose(1, 30_000, 5_000)
ODD = [
    (1, prose(2, 120), "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "a"),
    (4, " \t\n\x0b\x0c\r ", "en", None),
    (5, "é", "fr", "b"),
    (6, LONG, "en", "b"),
    (7, LONG + " tail", "en", "b"),
    (8, prose(2, 120) + " ", "en", "c"),
    (8, prose(2, 120) + " ", "en", "c"),
    (9, prose(2, 120) + "  ", None, None),
    (9, prose(3, 60), "de", "c"),
    (None, prose(3, 60), "de", "c"),
    (10, "a b c\na b c\n\nx\u00a0y\u2028z", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 2, "k", 3, "p", 4) for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(x) for x in r))


def test_words_in_batches():
    texts = [r[1] for r in ODD] + ["Ünï CODE x", "X x"]
    seen = {}
    for at, to, numbers, bounds in batches(pa.array(texts).slice(0), lower=True):
        for i in range(at, to):
            words = WORDS.findall((texts[i] or "").translate({c: c + 32 for c in range(65, 91)}))
            got = numbers[bounds[i - at] : bounds[i - at + 1]].tolist()
            assert len(got) == len(words)
            for w, number in zip(words, got):
                assert seen.setdefault(w, number) == number
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("lead", [None, "sum"])
def test_numbered_names_follow_sorted_keys(spark, lead):
    draw = np.random.default_rng(5)
    data = [(None if x % 17 == 0 else f"k{x % 40}", i) for i, x in enumerate(draw.integers(0, 300, 2_000).tolist())]
    data += [("hot", i) for i in range(2_000, 4_000)]
    df = spark.createDataFrame(data, "k string, i long").withColumn("sum", F.xxhash64("k"))
    got = {r.i: r.name for r in numbered(df if lead else df.drop("sum"), ["k"], ["i"], "name", lead=lead).collect()}
    names = {}
    for k, i in data:
        assert names.setdefault(k, got[i]) == got[i]
    assert sorted(names.values()) == list(range(1, len(names) + 1))
    if not lead:
        assert [k for k in sorted(names, key=names.get)] == sorted(names, key=lambda k: (k is not None, k))


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_numbered_where_leads_clash(spark, bits):
    """Keys that share a lead, repeated over many tasks, still get one name each."""
    keys = [f"k{i % 37}" for i in range(3000)] + ["hot"] * 1500
    df = spark.createDataFrame([(x, i) for i, x in enumerate(keys)], "k string, i long").repartition(6)
    df = df.withColumn("sum", F.pmod(F.xxhash64("k"), F.lit(1 << bits)))
    got = numbered(df.withColumn("key", F.col("k")), ["k"], ["i"], "name", lead="sum").collect()
    assert len(got) == len(keys) and len({r["name"] for r in got}) == 38 == len({(r["key"], r["name"]) for r in got})


def test_numbered_raises_where_both_hashes_clash(spark, monkeypatch):
    df = spark.createDataFrame([(x, i) for i, x in enumerate("abab")], "k string, i long").withColumn("sum", F.lit(1).cast("long"))
    monkeypatch.setattr("quotecast.llm.tables.F.xxhash64", lambda *_: F.lit(1).cast("long"))
    with pytest.raises(Exception, match="share both hashes"):
        numbered(df.coalesce(1), ["k"], ["i"], "name", lead="sum").collect()


def doubled(n):
    """A word of n letters and its swap: sums of letters times powers cannot tell them apart."""
    word = "a"
    while len(word) < n:
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_long_words_are_told_apart(spark, n):
    a, b = doubled(n)
    lists = [numbers.tolist() for *_, numbers, _ in batches(pa.array([a, b, a + " " + b]))]
    assert len(set(sum(lists, []))) == 2
    few = prose(4, 19)
    df = spark.createDataFrame([(1, f"{few} {a}"), (2, f"{few} {b}"), (3, a), (4, b), (5, a)], "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in substring_dedup(df).collect()}
    assert set(removed.values()) == {0}
    found = {r.doc_id: r.component_id for r in minhash.near_groups(df, size=2).collect()}
    assert (found[3], found[4], found[5]) == (3, 4, 3)


def test_words_that_differ_in_little(spark):
    words = ["", "x", "x" * 7, "x" * 8, "x" * 9, "x" * 16, "y" + "x" * 15, "x" * 15 + "y", "x\x00", "x\x00\x00", "x" * 8 + "y" * 8, "y" * 8 + "x" * 8]
    got = [int(numbers[0]) for w in words[1:] for *_, numbers, _ in batches(pa.array([w]))]
    assert len(set(got)) == len(words) - 1


def test_running_sums(spark):
    data = [(None if i % 5 == 0 else f"s{i % 3}" if i % 2 else "hot", (i * 7919) % 1009, i % 4) for i in range(3_000)]
    df = spark.createDataFrame([(g, o, i, v) for i, (g, o, v) in enumerate(data)], "g string, o long, i long, v long")
    got = {r.i: r.b for r in running(df, "g", ["o", "i"], "v", "b").collect()}
    total = Counter()
    for i in sorted(range(len(data)), key=lambda i: (data[i][1], i)):
        assert got[i] == total[data[i][0]]
        total[data[i][0]] += data[i][2]


# 1: runs of lines


def plain_lines(docs, run):
    """By id: number of lines and kept lines; ids are distinct and not null."""
    lines = {d: [x for x in (t or "").split("\n") if WORDS.search(x)] for d, t in docs}
    seen, gone = set(), {d: set() for d in lines}
    for d in sorted(lines):
        for i in range(len(lines[d]) - run + 1):
            w = tuple(lines[d][i : i + run])
            if w in seen:
                gone[d] |= set(range(i, i + run))
            seen.add(w)
    return {d: (len(x), [y for i, y in enumerate(x) if i not in gone[d]]) for d, x in lines.items()}


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_line_runs(spark, run):
    draw = np.random.default_rng(run)
    docs = [(i, "\n".join(f"l{x}" if x else " " for x in draw.integers(0, 4, draw.integers(0, 25)))) for i in range(40)]
    docs += [(50, None), (51, "")]
    got = line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), run=run).collect()
    assert {r.doc_id: (r.n_lines, r.kept_lines) for r in got} == plain_lines(docs, run)


def test_line_runs_of_odd_rows(odd, none):
    got = line_dedup(odd, run=1).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got if r.doc_id not in (8, 9, None)}
    assert by_id[2].n_lines == by_id[4].n_lines == 0 and by_id[10].kept_lines == ["a b c", "x\u00a0y\u2028z"]
    eight = [r for r in got if r.doc_id == 8]
    assert eight[0] == eight[1]  # repeated rows are one document, told twice
    assert line_dedup(none).count() == 0


def plain_line_copies(docs, run, words):
    """As plain_lines; shorter runs of so many words and texts equal to an earlier one go too."""
    lines = {d: [x for x in (t or "").split("\n") if WORDS.search(x)] for d, t in docs}
    seen, out = set(), {}
    for d, told in sorted(lines.items()):
        gone = set(range(len(told))) if ("whole", *told) in seen else set()
        for i in range(len(told)):
            for n in range(1, min(run, len(told) - i) + 1):
                w = tuple(told[i : i + n])
                if w in seen and (n == run or len(WORDS.findall(" ".join(w))) >= words):
                    gone |= set(range(i, i + n))
                seen.add(w)
        seen.add(("whole", *told))
        out[d] = (len(told), [y for i, y in enumerate(told) if i not in gone])
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_line_copies_of_few_lines(spark, run):
    draw = np.random.default_rng(40 + run)
    some = ["a", "b", "c d", "e " * 4, "f " * 9, "g " * 12]
    docs = [(i, "\n".join(some[x] for x in draw.integers(0, 6, draw.integers(0, 7)))) for i in range(60)]
    docs += [(70, "only"), (71, "only\n"), (72, "only\nonly two"), (73, "\nonly\nonly two"), (74, None), (75, ""), (76, "h " * 12), (77, "x\n" + "h " * 12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.kept_lines) for r in line_dedup(df, run=run, words=10, whole=True).collect()}
    assert got == plain_line_copies(docs, run, 10)
    assert got[71][1] == got[73][1] == [] and got[77][1] == ["x"]


# 2: quality


def plain_measures(text):
    words, told = WORDS.findall(text or ""), [x for x in (text or "").split("\n") if WORDS.search(x)]
    found = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if found[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(told) - len(set(told)), len(covered))


def test_quality_counts(spark, odd):
    texts = [r[1] for r in ODD] + ["a b a b a b", "x x x x", "# < > | a\na\n a\n#", "p q r s p q r"]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rate(df).collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(texts)}


def test_quality_fences_follow_their_group(spark, odd, none):
    clean = [(i, prose(100 + i, 80), "en", "web") for i in range(40)]
    loud = [(100 + i, prose(200 + i, 80) + " ***" * (20 + i % 3), "en", "wiki") for i in range(40)]
    strange = [(200, prose(300, 80) + " ***" * 20, "en", "web"), (201, "x" * 4_000 + " " + prose(301, 80), "en", "web")]
    df = spark.createDataFrame(clean + loud + strange, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in rate(df).where("kept").collect()}
    assert kept == {r[0] for r in clean + loud}
    out = keep_good(odd)
    assert out.columns == odd.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 6, 7, 8, 8, 9, 9, None])
    assert keep_good(none).count() == 0


# 3: exact copies


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_exact_groups(spark, block):
    draw = np.random.default_rng(block)
    texts = ["".join(draw.choice(list("ab \n"), draw.integers(0, 9))) for _ in range(60)] + [None, "", "\x00a", "é" * 30, "é" * 30 + " "]
    docs = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[6]), (3, texts[6])]
    got = exact_groups(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect()
    groups = {}
    for d, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0))
    want = Counter()
    for d, t in docs:
        g = groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")]
        want[(d, None if min(g)[1] else min(g)[2], len(g))] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_copies_go(odd, none):
    out = drop_exact_copies(odd)
    assert out.columns == odd.columns
    kept = Counter(r.doc_id for r in out.collect())
    # of 1, 8, 8 and 9 the longest stays, of the blank ones the one with most characters
    assert kept == Counter([4, 5, 6, 7, 9, 9, 10])
    assert drop_exact_copies(none).count() == 0


# 4: license notices


def test_license_scan_against_every_area(spark):
    base = list(NOTICES)
    draw = np.random.default_rng(3)

    def bent(text, edits):
        for _ in range(edits):
            i = int(draw.integers(0, len(text)))
            kind = draw.integers(0, 3)
            text = text[:i] + ("q" if kind else "") + text[i + (kind != 2) :]
        return text

    texts = [f"{prose(i, 12)} {bent(base[i % len(base)], i % 9)}, {prose(50 + i, 9)}" for i in range(60)]
    texts += ["All Rights Reserved. CC-BY 4.0 cc by", "general public license general public license", None, "", "é all rights reservéd"]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        flat = f" {' '.join(words)} "
        want = {label for n, label in NOTICES.items() if regex.search(rf"(?:{regex.escape(n)}){{e<={edits_allowed(n)}}}", flat)}
        assert {h.label for h in got[i].hits} == want, text
        assert got[i].n_words == len(words)
        for h in got[i].hits:
            assert h.span in " ".join(words[h.first : h.last + 1]) or h.span.replace(" ", "") in "".join(words)
            assert h.edits <= edits_allowed(h.notice)
    assert [(b.phrase, b.word) for b in got[60].base] == [("cc by", 3), ("cc by", 7), ("all rights reserved", 0)]
    assert [b.word for b in got[61].base] == [0, 3] and got[62].n_words == 0


def test_license_notices_back_to_back(spark):
    exact, bent, worse = "released under the mit license", "relesed under the mit licence", "relesed undr the mit licence"
    stacks = [[bent] * 3 + [exact], [exact] + [bent] * 3, [bent, exact, worse, bent, exact, bent], [worse, bent, exact], [worse] * 4, [exact] * 3]
    edits = {exact: 0, bent: 2, worse: 3}
    texts = [f"{prose(i, 8)} {' '.join(s)} {prose(9 + i, 8)}" for i, s in enumerate(stacks)]
    got = {r.doc_id: r.hits for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, stack in enumerate(stacks):
        assert [h.edits for h in got[i]] == [edits[x] for x in stack]
        assert [(h.first, h.last) for h in got[i]] == [(8 + 5 * k, 12 + 5 * k) for k in range(len(stack))]


def test_license_work_grows_with_the_text(monkeypatch):
    """Stacked notices: the characters searched with edits grow as the text does."""
    known = [licenses.Notice(text, label, licenses.RATE) for text, label in NOTICES.items()]
    automaton = licenses.seeded(known)
    searched = {}
    for often in (200, 1600):
        flat, places = " " + "relesed under the mit licence " * often, {}
        for end, where in automaton.iter(flat):
            for i, at in where:
                places.setdefault(i, []).append(end - at)
        sizes, best = [], licenses.Notice.best
        with monkeypatch.context() as m:
            m.setattr(licenses.Notice, "best", lambda self, f, a, b: (sizes.append(b - a), best(self, f, a, b))[1])
            hits = [h for i, p in places.items() for h in known[i].spans(flat, p)]
        assert [(a, b) for a, b, _ in sorted(hits)] == [(1 + 30 * k, 30 + 30 * k) for k in range(often)]
        searched[often] = sum(sizes)
    assert searched[1600] < 9 * searched[200]


def test_license_scan_of_odd_rows(odd, none):
    assert scan(odd).count() == len(ODD) and scan(none).count() == 0


# 5: near copies


def plain_components(docs, size, share):
    def shingles(t):
        w = WORDS.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = [shingles(t) for _, t in docs]
    top = list(range(len(docs)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= share * (len(a) + len(sets[j]) - both) and sets[j]:
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return Counter((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs))


@pytest.mark.parametrize("size,block", [(2, 256), (5, 4)])
def test_near_groups(spark, monkeypatch, size, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    draw = np.random.default_rng(size)
    docs = []
    for i in range(150):
        words = prose(1_000 + i % 12, 90 + i % 12, 150).split()
        for _ in range(int(draw.integers(0, 7))):
            words[int(draw.integers(0, len(words)))] = f"new{draw.integers(0, 99)}"
        docs.append((int(draw.integers(0, 500)), " ".join(words)))
    docs += [(r[0], r[1]) for r in ODD] + [(700, "one"), (701, "One"), (702, "one two"), (None, "one two")]
    got = minhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), size=size).collect()
    assert Counter((r.doc_id, r.n, r.component_id) for r in got) == plain_components(docs, size, 80)


def test_block_links_join_all_components():
    texts = [prose(9, 100)] * 3 + [prose(9, 99)] * 2 + [prose(10, 50)]
    table = pa.RecordBatch.from_pylist(
        [{"group": 1, "node": i, "component": i, "side": 0, "text": t} for i, t in enumerate(texts)])
    found = [x for b in minhash.block_links(iter([table]), 2, 80, True) for x in b.to_pylist()]
    assert len(found) == 4 and {x["u"] for x in found} | {x["v"] for x in found} == {0, 1, 2, 3, 4}


def test_screen_keeps_nodes_with_near_signatures():
    draw = np.random.default_rng(3)
    one, two = draw.integers(0, 2**16, (2, 160)).astype(np.uint16)
    near = np.where(np.arange(160) < 120, one, two)

    def found(sides, components, first=(1, 2, 3, 4)):
        block = {"c": -1, "i": 0}
        rows = [
            {"group": {"bucket": 9, "a": block, "b": block}, "node": i, "component": c, "side": x, "signature": sign.tobytes(), "marks": np.array([f, 9, 0]).tobytes()}
            for i, (sign, x, c, f) in enumerate(zip([one, two, near, near], sides, components, first))]
        return [r["node"] for b in minhash.block_screen(iter([pa.RecordBatch.from_pylist(rows)]), 0.64) for r in b.to_pylist()]

    # two has no partner; where the first bucket is shared, the pair is compared there
    assert found([0] * 4, [0, 1, 2, 3]) == [0, 2, 3]
    assert found([0] * 4, [0, 1, 2, 3], [1, 2, 1, 1]) == []
    assert found([0] * 4, [0, 1, 2, 2], [1, 2, 1, 4]) == [0, 3]
    assert found([0, 0, 0, 1], [0, 1, 0, 0]) == []
    assert found([0, 0, 1, 0], [0, 1, 2, 0]) == [0, 2, 3]
    assert found([0, 0, 1, 1], [0, 1, 2, 0]) == [0, 2]


def test_texts_of_one_template_stay_where_they_are(spark, monkeypatch):
    tables = []
    written = minhash.written
    monkeypatch.setattr(minhash, "written", lambda df: tables.append(written(df)) or tables[-1])
    shared = prose(1, 60)
    docs = [(i, f"{shared} {' '.join(f'own{i}x{k}' for k in range(40))}") for i in range(2_000)]
    docs += [(5_000 + i, docs[i][1] + f" more{i}") for i in range(0, 2_000, 100)]
    found = {r.doc_id: r.component_id for r in minhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), size=2).collect()}
    assert found == {d: d - 5_000 if d >= 5_000 else d for d, _ in docs}
    screened = [t for t in tables if "side" in t.columns]
    assert len(screened) == 1 and screened[0].count() < 100


def test_near_copies_go(odd, none):
    out = minhash.drop_near_copies(odd)
    assert out.columns == odd.columns
    # 3-word-60 texts of 9 and null are one group, as are 1, 8, 8 and 9, and 6 and 7; texts without words stay
    kept = Counter(r.doc_id for r in out.collect())
    assert kept == Counter([1, 2, 3, 4, 5, 6, 9, 10]) or kept == Counter([1, 2, 3, 4, 5, 6, None, 10])
    assert minhash.drop_near_copies(none).count() == 0


def test_rows_without_words_all_stay(spark):
    rows_in = [(1, None, "x"), (1, None, "y"), (1, None, "y"), (2, "", "z"), (2, "", "z"), (3, "a b c", "q"), (3, "a b c", "p"), (4, "a b c", "a"), (None, " ", "w")]
    want = [r for r in rows_in if not (r[1] or "").strip()] + [(3, "a b c", "p")]
    for n in (1, 5):
        df = spark.createDataFrame(rows_in, "doc_id long, text string, source string").repartition(n)
        assert rows(minhash.drop_near_copies(df)) == sorted(want, key=lambda r: tuple(map(str, r)))


def test_components_of_paths_and_hubs(spark):
    draw = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(300, 300)]
    order = draw.permutation(400)
    edges = [(int(order[a]), int(order[b])) for a, b in edges]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    path, hub = {int(order[i]) for i in range(61)}, {int(order[i]) for i in range(100, 160)}
    assert got == {x: min(path) for x in path} | {x: min(hub) for x in hub}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 6: packing


def test_windows_hold_everything_once():
    draw = np.random.default_rng(4)
    for _ in range(20):
        sizes = draw.integers(1, 257, draw.integers(1, 200)).tolist()
        bins = windows(sizes, 1024)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert max(sum(sizes[i] for i in b) for b in bins) <= 1024
    assert [sorted(sum(x) for x in ([s[i] for i in b] for b in differencing(s, 2))) for s in ([8, 7, 6, 5, 4],)] == [[14, 16]]


def test_fast_ids_are_the_tokenizers_own():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, encoder = Tokenizer.from_file(path), Encoder(path, public_tokenizers.PATTERN)
    assert encoder.fast is not None
    texts = ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)}b" for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(0, 0x30000, 64)]
    for text, code in zip(texts, model.encode_batch(texts, add_special_tokens=False)):
        assert encoder.encode(text) == np.array(code.ids, "<u4").tobytes()
    word = Encoder(public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.PATTERN)
    assert word.fast is None and word.encode("One two")


def test_packing_round_trip(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    texts = [(i, t) for i, t in enumerate([r[1] for r in ODD] + ["a  b", " a", "a\n b", "a <|endoftext|> b", "don't 've\t x "])]
    df = odd.sparkSession.createDataFrame(texts, "doc_id long, text string")
    got = pieces(df, path, public_tokenizers.PATTERN).toPandas()
    for i, text in texts:
        mine = got[got.doc_id == i].sort_values("start")
        want = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(map(bytes, mine.ids)) == want.tobytes()
        assert mine.start.tolist() == (mine.length.cumsum() - mine.length).tolist()
        assert set(mine.doc_tokens) == {len(want)}
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 1024
    first = pieces(df, path, public_tokenizers.PATTERN).select(F.crc32("ids").alias("c"), "ids").first()
    assert first.c == zlib.crc32(bytes(first.ids))
    assert pieces(odd, path, public_tokenizers.PATTERN).select("doc_id").distinct().count() == 11 and pieces(none, path, public_tokenizers.PATTERN).count() == 0


# 7: language-model scores


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order):
    docs = [(i, prose(i, int(5 + 7 * i), 12)) for i in range(15)] + [(20, None), (21, "unseen"), (22, prose(1, 12, 12)), (22, prose(1, 12, 12))]
    got = score(spark.createDataFrame(docs, "doc_id long, text string"), order=order, parts=3).collect()
    lists = [WORDS.findall(t or "") for _, t in docs]

    def grams(ws):
        return Counter(tuple(ws[i - n : i]) for n in range(1, order + 1) for i in range(n, len(ws) + 1))

    every = sum((grams(x) for x in lists), Counter())
    n_all = sum(map(len, lists))
    want = []
    for (d, _), ws in zip(docs, lists):
        others, logs = every - grams(ws), []
        for i, w in enumerate(ws):
            value = max(others[(w,)], 1) / max(n_all - len(ws), 1)
            for n in range(2, min(order, i + 1) + 1):
                g = tuple(ws[i - n + 1 : i + 1])
                value = others[g] / others[g[:-1]] if others[g] else 0.4 * value
            logs.append(np.log10(value))
        want.append((d, len(ws), round(float(np.mean(logs)), 9) if logs else None))
    assert Counter((r.doc_id, r.n_words, None if r.score is None else round(r.score, 9)) for r in got) == Counter(want)


def test_scores_of_odd_rows(odd, none):
    assert score(odd, parts=4).count() == len(ODD) and score(none, parts=4).count() == 0


# 8: URLs


def test_urls(spark):
    urls = ["HTTP://WWW.Example.COM/de/x?b=2&utm_source=f&a=1#t", "x://example.com/de/", "no scheme", None, "", "://", "a://net/",
            "a://net", "a://sub.example.net/en/", "a://sub.example.net/fr/", "a://x.org/fr/://y", "a://badexample.com/de/", "a://H\u00c4.net/"]
    df = spark.createDataFrame([(i, u, "p", 0) for i, u in enumerate(urls)], "page_id long, url string, path string, block int")
    host, path = parts(F.col("url"))
    got = {r[0]: (r[1], r[2], r[3]) for r in df.select("page_id", host, path, canonical(F.col("url"))).collect()}
    assert got[0] == ("www.example.com", "/de/x", "example.com/de/x?a=1&b=2")
    assert got[2] == got[3] == got[4] == got[5] == ("", "", None)
    assert got[10][:2] == ("x.org", "/fr/://y") and got[12][0] == "h\u00c4.net"
    rules = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
    listed = spark.createDataFrame([("http://badexample.com/de",), (None,), ("http://badexample.com/de/#x",)], "url string")
    told = {r.page_id: (r.rule, r.verdict) for r in judge(df, rules, listed).collect()}
    assert len(told) == len(urls)
    assert told[0] == told[1] == ("example.com/de/", "block") and told[6] == ("net/", "block") and told[7] == (None, "allow")
    assert told[8] == ("example.net/en/", "allow") and told[9] == ("net/", "block") and told[10] == ("org/fr/", "allow")
    assert told[11] == (None, "block") and told[3] == (None, "allow")
    assert judge(df.limit(0), rules, listed.limit(0)).count() == 0


def test_bloom_has_no_false_negatives(spark):
    pages = spark.range(3_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".com/")).alias("url"))
    listed = pages.where("page_id % 3 = 0").select("url")
    got = judge(pages, (), listed).where("verdict = 'block'").select("page_id").collect()
    assert {r[0] for r in got} == set(range(0, 3_000, 3))


# 9: substrings


def plain_substrings(docs, window):
    seen, out = set(), {}
    for d, text in sorted(docs):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        out[d] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return out


@pytest.mark.parametrize("large", [2, 10_000])
def test_substrings(spark, large):
    draw = np.random.default_rng(large)
    shared = [prose(500 + i, 30).split() for i in range(4)]
    docs = []
    for i in range(60):
        parts_ = [prose(600 + i, 15).split(), shared[int(draw.integers(0, 4))], prose(700 + i, 9).split(), shared[int(draw.integers(0, 4))][3:]]
        docs.append((i, " \n".join(w for p in parts_ for w in p)))
    docs += [(100, "x " * 70), (101, "x " * 19), (102, None), (103, ""), (104, "x\u00a0x " * 25), (105, LONG), (106, LONG[500:])]
    got = substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), large=large).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == plain_substrings(docs, 20)
    for r in got:
        assert sum(s["last"] - s["first"] + 1 for s in r.removed_spans) == r.n_removed


def test_substrings_of_odd_rows(odd, none):
    got = substring_dedup(odd).collect()
    assert len(got) == len(ODD)
    gone = {r.doc_id: r.n_removed for r in got if r.doc_id not in (8, 9)}
    assert gone[1] == 0 and gone[6] == 0 and gone[7] == 30_000 and gone[None] == 60
    assert {r.n_removed for r in got if r.doc_id == 8} == {120}
    assert substring_dedup(none).count() == 0


def test_substrings_of_texts_that_share_hash_bits(spark):
    """Two texts of one (null) id whose hashes agree in the last 23 bits; one is a copy of an earlier text."""
    copy, other = (" ".join(f"t{n}w{k}" for k in range(40)) for n in (9013, 11043))
    df = spark.createDataFrame([(1, copy + " end"), (None, copy), (None, other)], "doc_id long, text string")
    assert df.where("doc_id is null").select(F.xxhash64("text").bitwiseAND(F.lit((1 << 23) - 1))).distinct().count() == 1
    for large in (1, 10_000):
        got = {(r.doc_id, r.n_removed, r.kept) for r in substring_dedup(df, large=large).collect()}
        assert got == {(1, 0, copy + " end"), (None, 40, ""), (None, 0, other)}


# 10: mixing


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = total - sum(stopped.values())
        left = sum(weight[s] for s in names if s not in stopped)
        new = {s: epochs * sizes[s] for s in names if s not in stopped and rest * weight[s] >= epochs * sizes[s] * left}
        if not new:
            return {s: stopped.get(s, rest * weight[s] / left if left else 0) for s in names}
        stopped |= new


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    draw = np.random.default_rng(seed)
    sizes = {None if i == 0 else f"s{i}": int(draw.integers(0, 10 ** draw.integers(1, 6))) for i in range(int(draw.integers(1, 9)))}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_is_exact_and_repeatable(spark, odd, none):
    docs = [(i, prose(i, 1 + i % 50), "hot" if i % 3 else f"s{i % 4}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mix(df).collect()
    assert Counter(got) == Counter(mix(df.repartition(7)).collect())
    taken = Counter()
    for r in got:
        taken[(r.source, r.target)] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert all(n == int(target) for (_, target), n in taken.items())
    out = mixed(df)
    assert sum(len(r.text.split()) for r in out.collect()) == sum(taken.values())
    assert mixed(odd).columns == odd.columns
    assert sum(len(WORDS.findall(r.text)) for r in mixed(odd).collect()) == mix(odd).agg(F.sum("taken")).first()[0]
    assert mixed(none).count() == 0 and mix(none).count() == 0
