"""Fill-in-middle: cuts, frames and exact round trips."""

import hashlib

import pytest
import zstandard

from quotecast.llm import queries
from quotecast.llm.middle import digests, fill_in_middle, framed, restored

SCHEMA = "doc_id long, text string, lang string, source string, n long, form string, draw string, frames int"
LONG = "Ünï 😀 text\n" * 9000
TEXTS = ["", None, "x", "😀", "ab", " ", "has <P> inside", "<S>", "a<M>b", "<P", "P><S <M", "plain words here", LONG, LONG[:8192], LONG[:4096] + "é", "\x00\r\n"]
ROWS = [(k * 100 + i, t) for k in range(12) for i, t in enumerate(TEXTS)] + [(None, "null id"), (None, "null id"), (5, "same id"), (5, "same id"), (-3, "minus")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en", "a", 1, "f", "d", 2) for r in ROWS], SCHEMA).repartition(3)


def plain(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("frame", [1, 3, 4096])
def test_outputs_are_the_texts_rearranged(spark, docs, frame):
    some = docs.where("length(text) < 100 or text is null") if frame < 10 else docs
    out = fill_in_middle(some, frame=frame).collect()
    got = []
    for r in out:
        # frames one after another are one stream
        stream = b"".join(bytes(f["data"]) for f in r["output"])
        text = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(stream) if stream else b""
        ends = [f["until"] for f in r["output"]]
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(text.decode())
        got.append((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], text.decode()))
    want = [plain(*r) for r in ROWS if frame > 10 or len(r[1] or "") < 100]
    assert ordered(got) == ordered(want)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_digests_and_round_trip(spark, docs):
    got = digests(fill_in_middle(docs)).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(*plain(i, t)[:5], sha(plain(i, t)[5]), sha(t)) for i, t in ROWS]
    assert ordered(map(tuple, got)) == ordered(want)


def test_whole_frames_are_reused(spark, docs):
    one = docs.where("doc_id is not null and length(text) > 50000")
    stored = {r["doc_id"]: {bytes(f["data"]) for f in r["frames"]} for r in framed(one).collect()}
    for r in fill_in_middle(one).where("form <> 'plain'").collect():
        anew = [f for f in r["output"] if bytes(f["data"]) not in stored[r["doc_id"]]]
        assert len(anew) <= 3 + 4  # the markers, and two pieces of each cut frame


def test_the_query_and_the_empty_table(spark, docs, tmp_path):
    docs.where("false").select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_fill_middle"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert got.count() == 0


def test_restored_needs_only_output_and_form():
    assert restored([b"<P>a", b"b<S>", b"c<M>d"], "psm") == b"abdc"
    assert restored([b"<S>c<P>ab<M>d"], "spm") == b"abdc"
    assert restored([b"<P>"], "plain") == b"<P>"
