"""Near-duplicate documents: MinHash bands, signature and full-set checks, components."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quotecast.llm.components import components
from quotecast.llm.exact import matching, rows_repeat
from quotecast.llm.tables import SPACES, written
from quotecast.llm.words import batches, mix, powers, runs, sums, window_numbers

BANDS, ROWS = 32, 5
BLOCK = 256
_BLOCK_ID = pa.struct([("c", pa.int64()), ("i", pa.int64())])
SCREENED = pa.schema([("group", pa.struct([("bucket", pa.int64()), ("a", _BLOCK_ID), ("b", _BLOCK_ID)])),
                      ("node", pa.int64()), ("component", pa.int64()), ("side", pa.int32())])
FEATURES = "doc_id {id}, text_key long, n long, digest binary, bands array<long>, marks binary, signature binary"


def shingle_sets(column, size, lower=True):
    """For every row of a text column its sorted distinct shingle numbers (64 bits)."""
    for at, to, words, rows in batches(column, lower):
        windows = window_numbers(words, size)
        short = None
        for i in range(to - at):
            a, b = rows[i], rows[i + 1]
            if b - a >= size:
                yield np.unique(windows[a : b - size + 1])
            elif b > a:
                short = sums(words) if short is None else short
                yield runs(short, np.array([a]), np.array([b]))
            else:
                yield words[:0]


def _minima(values, scale, shift):
    """The smallest of (scale * value + shift) modulo 2**64 for each hash function."""
    least = np.full(len(scale), ~np.uint64(0))
    for k in range(0, len(values), 512):
        np.minimum(least, (scale * values[k : k + 512] + shift).min(1), out=least)
    return least


def features(docs, id_col, text_col, size, bands, rows, lower):
    """Shingle count, digest of the set, band keys and signature of every row."""
    held = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    id_type = held.schema["doc_id"].dataType.simpleString()

    def compute(stream):
        draw = np.random.default_rng(811)
        scale = (draw.integers(0, 2**63, (bands * rows, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        shift = draw.integers(0, 2**63, (bands * rows, 1), dtype=np.uint64)
        for batch in stream:
            n, digest, keys, marks, signs = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), size, lower):
                n.append(len(s))
                if not len(s):
                    digest.append(None), keys.append(None), marks.append(None), signs.append(None)
                    continue
                least = _minima(s, scale, shift)
                band = (least.reshape(bands, rows) * powers(rows)).sum(1) + np.arange(1, bands + 1, dtype=np.uint64)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(mix(band).view(np.int64))
                marks.append(keys[-1].tobytes())
                signs.append((mix(least) >> np.uint64(48)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(signs, pa.binary())],
                ["doc_id", "text_key", "n", "digest", "bands", "marks", "signature"],
            )

    return held.mapInArrow(compute, FEATURES.format(id=id_type))


def _alike(a, b, share):
    """100 * intersection >= share * union, for two sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < share * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= share * (len(a) + len(b) - both)


def _groups(stream, key):
    """Runs of rows with equal key in sorted batches, as lists of row dicts."""
    now, rows = None, []
    for batch in stream:
        for row in batch.to_pylist():
            if row[key] != now and rows:
                yield rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield rows


def _sets(rows, size, lower):
    return list(shingle_sets(pa.array([r["text"] for r in rows], pa.string()), size, lower))


def _links(u, v):
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def star_links(stream, size, share, lower):
    """Check each group's members against its centre, a batch of members at a time."""
    now, centre = None, None
    for batch in stream:
        rows = batch.to_pylist()
        u, v = [], []
        for row, own in zip(rows, _sets(rows, size, lower)):
            if row["is_centre"]:
                now, centre = row["group"], own
            elif row["group"] == now and _alike(own, centre, share):
                u.append(row["node"]), v.append(row["centre"])
        yield _links(u, v)


def _near(sign, left, right, least):
    """Pairs (place in left, place in right) whose signatures agree in ``least`` places."""
    if len(left) * len(right) <= 4096:
        return np.nonzero((sign[left][:, None] == sign[right]).sum(2) >= least)
    agree = np.zeros((len(left), len(right)), np.uint16)
    for mine, theirs in zip(sign[left].T, np.ascontiguousarray(sign[right].T)):
        agree += mine[:, None] == theirs
    return np.nonzero(agree >= least)


def block_screen(stream, least):
    """The nodes of a group's one or two blocks that have a partner of another component whose
    signature agrees in a share of at least ``least``; a pair that shares several buckets counts
    in the first of them alone."""
    for rows in _groups(stream, "group"):
        parts, side = (np.array([r[c] for r in rows]) for c in ("component", "side"))
        if (parts == parts[0]).all():
            continue
        sign = np.frombuffer(b"".join(r["signature"] for r in rows), np.uint16).reshape(len(rows), -1)
        marks = np.frombuffer(b"".join(r["marks"] for r in rows), np.int64).reshape(len(rows), -1)
        band = int((marks[0] == rows[0]["group"]["bucket"]).argmax())
        one = side.max() == side.min()
        left, right = (np.arange(len(rows)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        x, y = _near(sign, left, right, least * sign.shape[1])
        x, y = left[x], right[y]
        new = parts[x] != parts[y]
        if one:
            new &= x < y
        x, y = x[new], y[new]
        seen = np.zeros(len(x), bool)
        for m in marks[:, :band].T:
            seen |= m[x] == m[y]
        who = np.union1d(x[~seen], y[~seen])
        if len(who):
            yield pa.RecordBatch.from_pylist([{c: rows[i][c] for c in ("group", "node", "component", "side")} for i in who], SCREENED)


def block_links(stream, size, share, lower):
    """Check all pairs of different components between the two blocks of a group."""
    for rows in _groups(stream, "group"):
        parts = np.array([r["component"] for r in rows])
        side = np.array([r["side"] for r in rows])
        if (parts == parts[0]).all():
            continue
        sets = _sets(rows, size, lower)
        length = np.array([len(s) for s in sets])
        flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), length)
        _, place, often = np.unique(flat, return_inverse=True, return_counts=True)
        shared = often[place] > 1
        place, who = place[shared], who[shared]
        order = np.argsort(place, kind="stable")
        place, who = place[order], who[order]
        column = np.cumsum(np.r_[0, place[1:] != place[:-1]]) if len(place) else place
        both = np.zeros((len(sets), len(sets)), np.float32)
        width = int(column[-1]) + 1 if len(column) else 0
        for k in range(0, width, 4096):
            a, b = np.searchsorted(column, [k, k + 4096])
            has = np.zeros((len(sets), min(4096, width - k)), np.float32)
            has[who[a:b], column[a:b] - k] = 1
            both += has @ has.T
        both = np.rint(both).astype(np.int64)
        union = length[:, None] + length[None, :] - both
        ok = (100 * both >= share * union) & (parts[:, None] != parts[None, :])
        ok &= (side[:, None] == side[None, :]) if side.max() == side.min() else (side[:, None] < side[None, :])
        kept = _spanning(*np.nonzero(np.triu(ok, 1) if side.max() == side.min() else ok), parts)
        yield _links([rows[x]["node"] for x, _ in kept], [rows[y]["node"] for _, y in kept])


def _spanning(i, j, parts):
    """Of links (i, j) those that join components not joined by the links before: enough for connectivity."""
    top, kept = {}, []

    def root(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for x, y in zip(i.tolist(), j.tolist()):
        a, b = root(parts[x]), root(parts[y])
        if a != b:
            top[max(a, b)] = min(a, b)
            kept.append((x, y))
    return kept


def _signed(pairs, nodes, least):
    """Pairs whose signatures agree in a share of at least ``least`` of their places."""
    sign = nodes.select("node", "signature")
    both = pairs.join(sign.select(F.col("node").alias("u"), F.col("signature").alias("a")), "u").join(
        sign.select(F.col("node").alias("v"), F.col("signature").alias("b")), "v"
    )

    def agree(stream):
        for batch in stream:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in "ab"
            )
            keep = (a == b).mean(1) >= least
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return both.select("u", "v", "a", "b").mapInArrow(agree, "u long, v long")


def near_groups(docs, id_col="doc_id", text_col="text", size=5, share=80, bands=BANDS, rows=ROWS, lower=True):
    """One row per row of docs: doc_id, text_key, n (shingles), component_id and group (a long).

    A document's set holds its distinct shingles of ``size`` words (A-Z lower-cased
    unless ``lower`` is false); with fewer words, the whole sequence as one; null,
    empty and blank texts have empty sets and are linked with nothing. Documents
    with 100 * intersection >= share * union are linked; component_id is the
    smallest doc_id reachable (a document's own where it has no links).

    Rows with equal sets are one node. ``bands`` * ``rows`` universal hash minima
    put nodes into buckets (at a similarity of 0.8 a linked pair shares none of 32
    buckets of 5 minima once in 3 * 10^5 times). In every bucket the smallest node
    is the centre: members whose signature comes near are checked against it on
    full sets, and links form components. Then buckets that still hold several
    components are checked exhaustively between these, in blocks of at most ``BLOCK`` nodes,
    inside tasks: on signatures, then on full sets, to which only nodes go that have a partner of near signature there (a linked pair's signature is that far off once
    in 3 * 10^6 times); a pair is compared in the first bucket it shares. So texts of one template that are not alike are not moved, no pair of
    a bucket is skipped, and neither pairs nor anything but links leave the last task. Repeated rows and repeated ids are further members of their
    node's component. Nodes, candidates and texts stay in tables; the driver sees
    counts alone.
    """
    table = written(features(docs, id_col, text_col, size, bands, rows, lower))
    some = table.where("n > 0")
    nodes = written(
        some.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "rep.doc_id", "rep.text_key")
    )
    first = some.withColumnRenamed("doc_id", "_d").withColumnRenamed("text_key", "_k").join(nodes, "digest").where(
        F.col("_d").eqNullSafe(F.col("doc_id")) & F.col("_k").eqNullSafe(F.col("text_key"))
    )
    keys = first.select(F.explode("bands").alias("bucket"), "node")
    multi = keys.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("other")).where("centre < other")
    members = written(keys.join(multi.select("bucket", "centre"), "bucket"))
    wanted = members.select("node").distinct()
    held = docs.select(F.col(id_col).alias("_d"), F.xxhash64(F.col(text_col)).alias("_k"), F.col(text_col).alias("text"))
    reps = nodes.join(wanted, "node", "left_semi").select("node", "digest", "doc_id", "text_key")
    texts = written(
        held.join(reps, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_k") == F.col("text_key"))).select("node", "text")
    )
    signs = written(first.select("node", "signature", "marks").join(wanted, "node", "left_semi"))

    # Stars: members against their buckets' centres, large groups of a centre in parts.
    stars = members.where("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()
    margin = 5 * (share / 100 * (1 - share / 100) / (bands * rows)) ** 0.5
    stars = written(_signed(stars, signs, share / 100 - margin))
    parts = stars.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts"))
    asked = (
        stars.join(parts, "v")
        .select(F.col("u").alias("node"), F.col("v").alias("centre"), F.pmod(F.xxhash64("u"), F.col("parts")).alias("part"), F.lit(False).alias("is_centre"))
        .unionByName(parts.select(F.col("v").alias("node"), F.col("v").alias("centre"),
                                  F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_centre")))
        .withColumn("group", F.xxhash64("centre", "part"))
    )
    with_text = asked.join(texts, "node").select("group", "centre", "node", "is_centre", "text")
    found = written(
        with_text.repartition("group").sortWithinPartitions("centre", "group", F.col("is_centre").desc())
        .mapInArrow(lambda s: star_links(s, size, share, lower), "u long, v long")
    )
    labels = written(components(found))

    # The rest: buckets that still hold several components, block by block.
    placed = members.select("bucket", "node").distinct().join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")
    )
    counts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
    large = F.col("m") >= BLOCK
    open_buckets = counts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.ceil(F.sum(F.when(large, 0).otherwise(F.col("m"))) / BLOCK).cast("long").alias("mixed"),
        F.collect_list(F.when(large, F.struct("component", F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks")))).alias("large"),
    ).where("n > 1")
    # a block: (-1, i) holds members of small components, (c, i) members of the large component c
    mixed = F.when(F.col("mixed") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("mixed")), lambda i: F.struct(F.lit(-1).cast("long").alias("c"), (i - 1).alias("i"))))
    blocks = F.concat(
        F.coalesce(mixed, F.array().cast("array<struct<c:bigint,i:bigint>>")),
        F.flatten(F.transform("large", lambda x: F.transform(F.sequence(F.lit(1).cast("long"), x["blocks"]), lambda i: F.struct(x["component"].alias("c"), (i - 1).alias("i"))))),
    )
    own = F.when(large, F.struct(F.col("component").alias("c"), F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK).cast("long")).alias("i"))).otherwise(
        F.struct(F.lit(-1).cast("long").alias("c"), F.pmod(F.xxhash64("node"), F.col("mixed")).alias("i")))
    paired = (
        placed.join(counts, ["bucket", "component"]).join(open_buckets, "bucket")
        .select("bucket", "node", "component", own.alias("own"), blocks.alias("blocks"))
        .select("*", F.explode(F.filter("blocks", lambda b: (b["c"] != F.col("own")["c"]) | (b["c"] == -1))).alias("with"))
        .select(
            "node", "component", (F.col("own") > F.col("with")).cast("int").alias("side"),
            F.struct("bucket", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b")).alias("group"),
        )
    )
    screened = written(
        paired.join(signs, "node").select("group", "node", "component", "side", "signature", "marks")
        .repartition("group").sortWithinPartitions("group")
        .mapInArrow(lambda s: block_screen(s, share / 100 - margin), paired.select("group", "node", "component", "side").schema)
    )
    more = written(
        screened.join(texts, "node").select("group", "node", "component", "side", "text")
        .repartition("group").sortWithinPartitions("group")
        .mapInArrow(lambda s: block_links(s, size, share, lower), "u long, v long")
    )
    if more.limit(1).count():
        old = labels.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        labels = written(components(old.unionByName(more)))
    linked = nodes.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("group"))
    rows_ = table.select("doc_id", "text_key", "n", "digest").join(linked, "digest", "left")
    rows_ = rows_.where("group is not null")
    least = rows_.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    alone = table.where("n = 0").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    return rows_.join(least, "group").select("doc_id", "text_key", "n", "component_id", "group").unionByName(alone)


def drop_near_copies(docs, id_col="doc_id", text_col="text", **options):
    """The rows of docs, all columns, with one row of each near group: that of the
    smallest (doc_id, hash of text). Rows without words are in no group and all stay."""
    groups = written(near_groups(docs, id_col, text_col, **options))
    best = groups.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("best"))
    alone = groups.where("group is null").select("doc_id", "text_key").distinct()
    wordless = F.trim(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACES)) == ""
    return matching(docs, best.select("best.*").unionByName(alone), rows_repeat(groups), id_col, text_col, wordless)
