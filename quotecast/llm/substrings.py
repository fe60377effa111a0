"""Removal of word sequences that occur earlier, by prefix-partitioned suffix trees."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quotecast.llm.words import SPACE, batches, window_numbers

WINDOW = 20
PREFIX = 4
LARGE = 32768


def _least_places(values, width):
    """Place of the (leftmost) smallest of the ``width`` values from every place on."""
    n = len(values) - width + 1
    place, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        have += step
    return place[:n]


def _anchored(words, rows, window, prefix):
    """Starts of all windows inside rows, and for each the place of its chosen prefix."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = window_numbers(words, prefix)
    ends = np.repeat(rows[1:], np.diff(rows))[:n]
    starts = np.flatnonzero(np.arange(n) + window <= ends)
    chosen = _least_places(grams, window - prefix + 1)[:n][starts]
    return starts, chosen, grams


def prefixes(stream, window, prefix):
    """A row for each chosen prefix of each text: its number, the text's id and hash and its place."""
    for batch in stream:
        ids, keys = batch.column("doc_id"), batch.column("key")
        for at, to, words, rows in batches(batch.column("text")):
            _, chosen, grams = _anchored(words, rows, window, prefix)
            if not len(chosen):
                continue
            chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
            row = np.searchsorted(rows, chosen, "right") - 1
            text = pa.array(at + row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[chosen].view(np.int64)), ids.take(text), keys.take(text), pa.array((chosen - rows[row]).astype(np.int32))],
                ["prefix", "doc_id", "key", "place"],
            )


def suffixes(stream, window, prefix):
    """For each prefix that is not unique: the windows it stands for, as numbers, first one first."""
    for batch in stream:
        ids, keys = batch.column("doc_id"), batch.column("key")
        live = batch.column("live")
        bounds = live.offsets.to_numpy()
        spots = live.values.field("place").to_numpy(zero_copy_only=False)
        salts = live.values.field("salt").to_numpy(zero_copy_only=False)
        for at, to, words, rows in batches(batch.column("text")):
            starts, chosen, grams = _anchored(words, rows, window, prefix)
            if not len(chosen):
                continue
            numbers = window_numbers(words, window)[starts]
            cuts = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
            ends = np.r_[cuts[1:], len(chosen)]
            heads = chosen[cuts]
            row = np.searchsorted(rows, heads, "right") - 1
            place = heads - rows[row]
            # the live places of the batch's rows, in the order of heads
            a, b = bounds[at], bounds[to]
            owner = np.repeat(np.arange(to - at), np.diff(bounds[at : to + 1]))
            order = np.lexsort((spots[a:b], owner))
            flat = rows[owner[order]] + spots[a:b][order]
            i = np.searchsorted(flat, heads)
            i[i == len(flat)] = 0
            keep = np.flatnonzero(flat[i] == heads) if len(flat) else np.zeros(0, np.int64)
            if not len(keep):
                continue
            salt = salts[a:b][order][i[keep]]
            lists = pa.array([numbers[x:y].tobytes() for x, y in zip(cuts[keep], ends[keep])], pa.binary())
            first = (starts[cuts[keep]] - rows[row[keep]]).astype(np.int32)
            text = pa.array(at + row[keep])
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[heads[keep]].view(np.int64)), ids.take(text), keys.take(text), pa.array(first), lists, pa.array(salt)],
                ["prefix", "doc_id", "key", "place", "windows", "salt"],
            )


def subtrees(stream):
    """Leaves below deep internal nodes that are not the node's first; and the first ones of split groups.

    Rows come sorted by group (prefix and salt) and then in document order. Each
    group's subtree is its leaves sorted by the rest of their windows; equal
    neighbours meet in an internal node at the full depth. All its leaves but the
    first (in document order) are marked: rows with a mask of windows from place on.
    Where a prefix was split by salt (0 or more; -1: not split), the first leaf may have an earlier
    one in another part: it goes out as a row with its window. Whole groups are taken
    together; none has many more than ``LARGE`` rows.
    """
    def flagged(table):
        table = table.combine_chunks()
        lists = table.column("windows").to_pylist()
        numbers = np.frombuffer(b"".join(lists), np.uint64)
        size = np.array([len(x) // 8 for x in lists], np.int64)
        leaf = np.repeat(np.arange(len(size)), size)
        prefix, salt = (table.column(c).to_numpy()[leaf] for c in ("prefix", "salt"))
        order = np.lexsort((numbers, salt, prefix))  # stable: document order within a node
        number, group, part = numbers[order], prefix[order], salt[order]
        same = np.r_[False, (number[1:] == number[:-1]) & (group[1:] == group[:-1]) & (part[1:] == part[:-1])]
        nth = np.arange(len(leaf)) - (np.cumsum(size) - size)[leaf]
        again = np.sort(order[same])
        row, first = np.unique(leaf[again], return_index=True)
        if len(row):
            mask = np.add.reduceat(np.int64(1) << nth[again], first)
            none = pa.nulls(len(row), pa.int64())
            yield from out(table, row, np.zeros(len(row), np.int64), mask, none, none)
        heads = order[~same & (part >= 0)]
        if len(heads):
            yield from out(table, leaf[heads], nth[heads], np.ones(len(heads), np.int64),
                           pa.array(prefix[heads]), pa.array(numbers[heads].view(np.int64)))

    def out(table, row, shift, mask, prefix, window):
        place = (table.column("place").to_numpy()[row] + shift).astype(np.int32)
        made = pa.Table.from_arrays(
            [*(table.column(c).take(pa.array(row)) for c in ("doc_id", "key")), pa.array(place), pa.array(mask), prefix, window],
            ["doc_id", "key", "place", "mask", "prefix", "window"])
        yield from made.combine_chunks().to_batches(10_000)

    waiting, n = [], 0
    for batch in stream:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        n += batch.num_rows
        if n < 2 * LARGE:
            continue
        table = pa.Table.from_batches(waiting)
        group, part = table.column("prefix").to_numpy(), table.column("salt").to_numpy()
        before = np.flatnonzero((group != group[-1]) | (part != part[-1]))
        if len(before):  # the last group may go on
            cut = int(before[-1]) + 1
            yield from flagged(table.slice(0, cut))
            waiting, n = table.slice(cut).to_batches(), n - cut
    if waiting:
        yield from flagged(pa.Table.from_batches(waiting))


def cut_texts(stream, window):
    """Texts without the words covered by the marked windows."""
    for batch in stream:
        texts, marks = batch.column("text").to_pylist(), batch.column("marks").to_pylist()
        n, removed, kept, spans = [], [], [], []
        for text, found in zip(texts, marks):
            words = text.encode().split(None)
            n.append(len(words))
            if not found:
                removed.append(0), kept.append(b" ".join(words)), spans.append([])
                continue
            change = np.zeros(len(words) + 1, np.int32)
            for m in found:
                first = m["place"]
                bits = m["mask"]
                while bits:
                    low = bits & -bits
                    start = first + low.bit_length() - 1
                    change[start] += 1
                    change[start + window] -= 1
                    bits ^= low
            gone = np.cumsum(change[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
            removed.append(int(gone.sum()))
            kept.append(b" ".join(w for w, g in zip(words, gone) if not g))
            spans.append([{"first": int(a), "last": int(b) - 1} for a, b in edge.reshape(-1, 2)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, SPANS)],
            ["doc_id", "n_words", "n_removed", "kept", "removed_spans"],
        )


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
assert SPACE[[9, 10, 11, 12, 13, 32]].all()  # what bytes.split() splits at


def substring_dedup(docs, id_col="doc_id", text_col="text", window=WINDOW, prefix=PREFIX, large=LARGE):
    """A row for each row of docs: doc_id, n_words, n_removed, kept (words joined by a
    space) and removed_spans (maximal runs of removed words, from 0).

    A word goes if a window of ``window`` consecutive words covers it whose words
    also start earlier: at a smaller doc_id (null last) or earlier in the same text.
    Windows are judged on the input.

    Windows are truncated suffixes. Each is filed under one prefix of ``prefix``
    words inside it, the one with the smallest number, so equal windows share their
    prefix and neighbours mostly do too. Prefixes that occur once lead to leaves
    without branches and are dropped after one count. The others split the suffixes
    into groups; each group is one subtree in memory, whose internal nodes at full
    depth are the repeats (see ``subtrees``). A prefix with more than ``large``
    members is split by a salt; the first leaves of its parts' nodes then meet under
    the longest prefix, the whole window, where all but the first are marked too. Numbers have 64 bits and are compared within
    a prefix only.

    Null texts have no words. Rows repeated with id and text are one document
    reported as often; different texts under one id are ordered by a hash.
    """
    if window - prefix > 62:
        raise ValueError("a mask holds the windows of one prefix: window - prefix must not exceed 62")
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    kind = held.schema["doc_id"].dataType.simpleString()
    chosen = held.mapInArrow(lambda s: prefixes(s, window, prefix), f"prefix long, doc_id {kind}, key long, place int")
    often = chosen.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = chosen.join(often, "prefix").select(
        "doc_id", "key",
        F.struct("place", F.when(F.col("n") <= large, -1).otherwise(
            F.pmod(F.xxhash64("doc_id", "key", "place"), F.ceil(F.col("n") / large))).cast("int").alias("salt")).alias("at"))
    by_text = live.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list("at").alias("live"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    leaves = held.join(by_text, same).select("doc_id", "key", "text", "live").mapInArrow(
        lambda s: suffixes(s, window, prefix), f"prefix long, doc_id {kind}, key long, place int, windows binary, salt int")
    found = (
        leaves.repartition("prefix", "salt")
        .sortWithinPartitions("prefix", "salt", F.col("doc_id").asc_nulls_last(), "key", "place")
        .mapInArrow(subtrees, f"doc_id {kind}, key long, place int, mask long, prefix long, window long")
    )
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("place").alias("p"))
    heads = found.where("window is not null")
    first = heads.groupBy("prefix", "window").agg(F.min(place).alias("first"))
    again = heads.join(first, ["prefix", "window"]).where(~place.eqNullSafe(F.col("first")))
    marks = (
        found.where("window is null").select("doc_id", "key", "place", "mask")
        .unionByName(again.select("doc_id", "key", "place", "mask"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .agg(F.collect_list(F.struct("place", "mask")).alias("marks"))
    )
    joined = held.join(marks, same, "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(
        lambda s: cut_texts(s, window),
        f"doc_id {kind}, n_words long, n_removed long, kept string, removed_spans array<struct<first:long,last:long>>",
    )
