"""Stupid-backoff scores of documents under an n-gram model of all other documents."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quotecast.llm.words import batches, mix, window_numbers

ORDER = 2
BACKOFF = 0.4
ALL = np.uint64(0)  # the key that counts every word


def _grams(words, rows, order):
    """For n = 1 ... order the number of the n-gram that ends at each word, and whether it lies inside its row."""
    at = np.arange(len(words)) - np.repeat(rows[:-1], np.diff(rows))
    out = []
    for n in range(1, order + 1):
        keys = np.zeros(len(words), np.uint64)
        if len(words) >= n:
            keys[n - 1 :] = mix(window_numbers(words, n) + np.uint64(n))
        out.append((keys, at >= n - 1))
    return out


def _read(texts, order):
    """Rows of a batch part by part: (from, to, word bounds, n-grams)."""
    texts = texts.combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    return [(at, to, rows, _grams(words, rows, order)) for at, to, words, rows in batches(texts)]


def _distinct(read):
    """A batch's distinct keys, how often each occurs, and where each key of each part stands among them."""
    lists = [k[inside] for *_, grams in read for k, inside in grams]
    n = sum(len(grams[0][0]) for *_, grams in read)
    keys, where, counts = np.unique(np.concatenate([[ALL], *lists]).astype(np.uint64), return_inverse=True, return_counts=True)
    counts[0] = n  # the smallest key is ALL
    return keys, where[1:], counts


def _dealt(keys, parts):
    """Positions of the keys of each hash partition: order and bounds."""
    part = (mix(keys + np.uint64(1)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _own(keys, inside, rows):
    """How often each n-gram occurs in its own row."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((keys, row))
    k, r, use = keys[order], row[order], inside[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])] if len(k) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    counts = np.bincount(group, weights=use).astype(np.int64) if len(k) else np.zeros(0, np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = counts[group]
    return out


def _pack(numbers):
    """64-bit numbers as bytes, all lowest bytes first, all highest last: high bytes of
    small numbers are runs of zeros, which the shuffle's compression removes."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data, kind):
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def ask(table, order, parts):
    """The count tables' input: a batch's keys (ascending, as differences) and counts for each hash partition."""
    keys, _, counts = _distinct(_read(table.column("text"), order))
    at, cuts = _dealt(keys, parts)
    batch = table.column("batch")[0].as_py()
    rows = [(p, batch, _pack(np.diff(keys[at[a:b]], prepend=ALL)), _pack(counts[at[a:b]].astype("<i8")))
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                ["part", "batch", "keys", "counts"])


def answer(table):
    """One hash partition of the count table, joined back to the batches that asked."""
    lists = [np.cumsum(_unpack(x, "<u8")) for x in table.column("keys").to_pylist()]
    counts = [_unpack(x, "<i8") for x in table.column("counts").to_pylist()]
    _, where = np.unique(np.concatenate(lists), return_inverse=True)
    totals = np.bincount(where, weights=np.concatenate(counts)).astype("<i8")[where]
    ends = np.cumsum([len(x) for x in lists])
    found = [_pack(totals[e - len(x) : e]) for x, e in zip(lists, ends)]
    return pa.Table.from_arrays([table.column("part"), table.column("batch"), pa.array(found, pa.binary())], ["part", "batch", "totals"])


def judge(texts, answers, order, parts, backoff):
    """Mean log10 score of each text of a batch."""
    read = _read(texts.column("text"), order)
    keys, where, _ = _distinct(read)
    at, cuts = _dealt(keys, parts)
    totals = np.zeros(len(keys), np.int64)
    for p, found in zip(answers.column("part").to_pylist(), answers.column("totals").to_pylist()):
        totals[at[cuts[p] : cuts[p + 1]]] = _unpack(found, "<i8")
    everything = int(totals[0])
    n_words, score, used = [], [], 0
    for *_, rows, grams in read:
        size = np.diff(rows)
        total, own = [], []
        for k, inside in grams:
            c = np.zeros(len(k), np.int64)
            m = int(inside.sum())
            c[inside] = totals[where[used : used + m]]
            used += m
            total.append(c)
            own.append(_own(k, inside, rows))
        rest = everything - np.repeat(size, size)
        value = np.maximum(total[0] - own[0], 1) / np.maximum(rest, 1)
        for n in range(2, order + 1):
            inside = grams[n - 1][1]
            seen = total[n - 1] - own[n - 1]
            before = np.r_[1, (total[n - 2] - own[n - 2])[:-1]] if len(seen) else seen
            value = np.where(inside, np.where(seen > 0, seen / np.maximum(before, 1), backoff * value), value)
        logs = np.log10(value)
        n_words += size.tolist()
        score += [float(logs[a:b].sum() / (b - a)) if b > a else None for a, b in zip(rows[:-1], rows[1:])]
    return pa.Table.from_arrays(
        [texts.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_words", "score"])


def score(docs, id_col="doc_id", text_col="text", order=ORDER, backoff=BACKOFF, parts=None, groups=None):
    """A row for each row of docs: doc_id, n_words and score, the mean log10 stupid-backoff
    score of its words.

    The model holds the counts of all n-grams up to ``order`` over all rows; a row
    is scored with its own counts taken off, so it never testifies for itself. A
    word after its context scores count(context word) / count(context) where that
    is seen, else ``backoff`` times its score after the shorter context; a word
    alone scores max(1, count) / words of all others. Null and blank texts have no
    words and a null score. Repeated rows count as further documents.

    Rows are dealt into batches by hash. Each batch sends every distinct n-gram once,
    with its count, to the n-gram's hash partition of the count table (map-side
    aggregation, so the most frequent n-gram has a row per batch, not per text);
    the partition sums them and joins the totals back to the batches that asked,
    where they meet the exploded n-grams again and are summed per document. Memory
    holds one batch or one partition: there are ``groups`` batches and ``parts``
    partitions (unless given, two and one for every shuffle partition), and a message
    for each of their pairs. N-grams are compared by 64-bit numbers.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = groups or 2 * parts
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn(
        "batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    kind = held.schema["doc_id"].dataType.simpleString()
    asked = held.groupBy("batch").applyInArrow(
        lambda t: ask(t, order, parts), "part int, batch int, keys binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(answer, "part int, batch int, totals binary")
    return held.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        lambda t, a: judge(t, a, order, parts, backoff), f"doc_id {kind}, n_words long, score double")
