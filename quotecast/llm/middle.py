"""Fill-in-middle: texts as seekable compressed frames, rearranged around a middle."""

import hashlib
from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from quotecast.llm.tables import written

FRAME = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FRAMES = pa.list_(pa.struct([("until", pa.int64()), ("data", pa.binary())]))
FRAMES_DDL = "array<struct<until:long,data:binary>>"


def framed(docs, id_col="doc_id", text_col="text", frame=FRAME):
    """doc_id, n (code points), marked (holds a marker) and frames of every row.

    A text is stored as independent zstandard frames of ``frame`` code points, each
    with the number of code points up to its end, so any place can be reached by one
    frame. Frames one after another are a valid zstandard stream of the text. Null
    and empty texts have no frames.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(stream):
        press = zstandard.ZstdCompressor()
        for batch in stream:
            size, marked, frames = [], [], []
            for text in batch.column("text").to_pylist():
                size.append(len(text))
                marked.append(any(m in text for m in (PREFIX, SUFFIX, MIDDLE)))
                frames.append([
                    {"until": min(a + frame, len(text)), "data": press.compress(text[a : a + frame].encode())}
                    for a in range(0, len(text), frame)
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(marked, pa.bool_()), pa.array(frames, FRAMES)],
                ["doc_id", "n", "marked", "frames"])

    held = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return held.mapInArrow(cut, f"doc_id {kind}, n long, marked boolean, frames {FRAMES_DDL}")


def _between(frames, ends, a, b, press, expand):
    """(units, frame) for code points a to b: whole frames as they are, the cut ones cut anew."""
    i = bisect_right(ends, a)
    while a < b:
        start, end = ends[i - 1] if i else 0, ends[i]
        data = frames[i]["data"]
        if a > start or b < end:
            text = expand.decompress(data).decode()[a - start : b - start]
            yield len(text), press.compress(text.encode())
        else:
            yield end - start, data
        a, i = min(b, end), i + 1


def _arranged(stream):
    press, expand = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    marker = {m: (len(m), press.compress(m.encode())) for m in (PREFIX, SUFFIX, MIDDLE)}
    for batch in stream:
        out = []
        for row in batch.select(["n", "form", "low", "high", "frames"]).to_pylist():
            frames = row["frames"]
            if row["form"] == "plain":
                out.append(frames)
                continue
            ends = [f["until"] for f in frames]
            spans = {PREFIX: (0, row["low"]), MIDDLE: (row["low"], row["high"]), SUFFIX: (row["high"], row["n"])}
            until, made = 0, []
            for m in (PREFIX, SUFFIX, MIDDLE) if row["form"] == "psm" else (SUFFIX, PREFIX, MIDDLE):
                for size, data in (marker[m], *_between(frames, ends, *spans[m], press, expand)):
                    until += size
                    made.append({"until": until, "data": data})
            out.append(made)
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")] + [pa.array(out, FRAMES)],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs, id_col="doc_id", text_col="text", seed=1, moved=90, spm=20, frame=FRAME):
    """A row for each row of docs: doc_id, n, form, prefix_chars, middle_chars and output (frames).

    Two places drawn by hash cut a text of n code points into prefix, middle and
    suffix. Of 100 texts ``moved`` are rearranged, of those ``spm`` of 100 to suffix, prefix, middle
    (form spm), the others to prefix, suffix, middle (psm), a marker before each part.
    The rest stays plain, as do empty texts (null counts as empty) and texts that hold a marker, so
    that every output can be undone (``restored``). Draws depend on seed and id alone (null: no
    digits): reruns agree, and rows of one id share their draws.

    Texts are first stored as frames in the shared folder. Only the frames that hold
    a cut are decompressed; all others go into the output as they are.
    """
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("draw", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    n = F.col("n")
    plain = (n == 0) | F.col("marked") | (h[2] % 100 >= moved)
    stored = written(framed(docs, id_col, text_col, frame)).withColumn("draw", draw)
    placed = stored.select(
        "doc_id", "n", "frames", F.least(h[0] % (n + 1), h[1] % (n + 1)).alias("low"), F.greatest(h[0] % (n + 1), h[1] % (n + 1)).alias("high"),
        F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm").alias("form"))
    moves = F.col("form") != "plain"
    placed = placed.withColumns({
        "prefix_chars": F.when(moves, F.col("low")), "middle_chars": F.when(moves, F.col("high") - F.col("low"))})
    kind = stored.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(
        _arranged, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output {FRAMES_DDL}")


def restored(pieces, form):
    """The text behind an output, given as its pieces in order, and its form (bytes)."""
    data = b"".join(pieces)
    if form == "plain":
        return data
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, rest = data[len(first) :].split(second.encode(), 1)
    b, middle = rest.split(MIDDLE.encode(), 1)
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return prefix + middle + suffix


def digests(arranged):
    """The rows of ``fill_in_middle`` with output_sha256 and restored_sha256 instead of the output.

    Frames are decompressed in order, each once.
    """
    kinds = [(f.name, f.dataType.simpleString()) for f in arranged.schema.fields if f.name != "output"]
    names = [name for name, _ in kinds]

    def digest(stream):
        expand = zstandard.ZstdDecompressor()
        for batch in stream:
            told, back = [], []
            for frames, form in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist()):
                sha, pieces = hashlib.sha256(), []
                for f in frames:
                    pieces.append(expand.decompress(f["data"]))
                    sha.update(pieces[-1])
                told.append(sha.hexdigest())
                back.append(hashlib.sha256(restored(pieces, form)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(told, pa.string()), pa.array(back, pa.string())],
                [*names, "output_sha256", "restored_sha256"])

    schema = ", ".join(f"{a} {b}" for a, b in kinds) + ", output_sha256 string, restored_sha256 string"
    return arranged.mapInArrow(digest, schema)
