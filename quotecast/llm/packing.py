"""Packing token sequences into windows by multiway differencing."""

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

WINDOW = 1024
PIECE = 256
GROUP = 64


def _byte_alphabet():
    """The character that stands for each byte in vocabularies of this kind."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The tokenizer is a file of the ``tokenizers`` library, whose ids these are.
    Where it is plain byte-level BPE with ids in order of its merges, ``tiktoken``
    computes the same ids from the same vocabulary several times faster; texts with
    one of its special tokens, and other tokenizers, take the library itself.
    """

    def __init__(self, path, pattern):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"] for t in told.get("added_tokens") or ()]
        vocab, merges = told["model"].get("vocab"), told["model"].get("merges")
        split, normal = told.get("pre_tokenizer") or {}, told.get("normalizer")
        if told["model"].get("type") not in (None, "BPE") or split.get("type") != "ByteLevel" or normal or split.get("add_prefix_space"):
            return
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if [vocab[a + b] for a, b in pairs] != list(range(256, 256 + len(pairs))):
            return
        import tiktoken

        back = {c: b for b, c in _byte_alphabet().items()}
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text):
        if self.fast is None or any(x in text for x in self.special):
            ids = self.model.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def differencing(sizes, k):
    """Deal sizes into k bins of near-equal sums: lists of positions.

    Every size starts as a partial partition (itself and k - 1 empty bins). The two
    partitions with the largest imbalance are merged, the fullest bin of one with
    the emptiest of the other, until one is left. A partition lists its filled bins
    (sum, number, positions) from the fullest down; the empty ones are implied.
    """
    heap = [(-size, i, [(-size, i, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, bins = heapq.heappop(heap)
        _, _, other = heapq.heappop(heap)
        if len(bins) < len(other):
            bins, other = other, bins
        filled = len(bins)
        for j, (total, number, members) in enumerate(other):
            at = k - 1 - j  # the fullest of the other meets the emptiest here
            if at < filled:
                bins[at] = (bins[at][0] + total, bins[at][1], bins[at][2] + members)
            else:
                bins.append((total, number, members))
        bins.sort()
        least = bins[-1][0] if len(bins) == k else 0
        heapq.heappush(heap, (bins[0][0] - least, i, bins))
    return [members for _, _, members in heap[0][2]] if heap else []


def windows(sizes, capacity):
    """Near-equal windows of at most ``capacity``; one more window whenever it is exceeded."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        bins = differencing(sizes, k)
        if max((sum(sizes[i] for i in b) for b in bins), default=0) <= capacity:
            return bins
        k += 1


def pieces(docs, tokenizer, pattern, id_col="doc_id", text_col="text", end_id=0, window=WINDOW, piece=PIECE, group=GROUP):
    """Pack every row's tokens into sequences of at most ``window`` tokens.

    Columns, one row per piece: doc_id, start (the document's ids before it), ids
    (little-endian unsigned 32-bit), length, doc_tokens, sequence_id, offset (place
    in the sequence, gapless from 0). A text's ids end with ``end_id``; null counts
    as empty. Whole windows are cut off first and are sequences by themselves; the
    rest, in pieces of at most ``piece`` ids, waits until about ``group`` windows
    are together and is dealt out by multiway differencing. Every task packs its
    own rows as they stream by, so nothing is shuffled and memory is bounded by a
    group and one text. ``tokenizer`` is a path that every worker can read and
    ``pattern`` what splits text before its merges; repeated rows are further documents.
    """
    held = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = held.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, ids binary, length long, doc_tokens long, sequence_id long, offset long"
    end = np.array([end_id], "<u4").tobytes()

    def pack(stream):
        encoder, made = Encoder(tokenizer, pattern), TaskContext.get().partitionId() << 33
        waiting, total, arrow_type = [], 0, None

        def batch(rows):
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = [arrow_type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["doc_id", "start", "ids", "length", "doc_tokens", "sequence_id", "offset"],
            )

        def deal():
            nonlocal made
            rows = []
            for members in windows([len(w[2]) // 4 for w in waiting], window):
                at = 0
                for i in members:
                    doc, start, ids, tokens = waiting[i]
                    rows.append((doc, start, ids, len(ids) // 4, tokens, made, at))
                    at += len(ids) // 4
                made += 1
            return rows

        for b in stream:
            arrow_type = b.column("doc_id").type
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for k in range(0, len(texts), 64):
                rows = []
                for doc, text in zip(ids[k : k + 64], texts[k : k + 64]):
                    code = encoder.encode(text) + end
                    tokens = len(code) // 4
                    full = tokens // window * window
                    for start in range(0, full, window):
                        rows.append((doc, start, code[4 * start : 4 * (start + window)], window, tokens, made, 0))
                        made += 1
                    for start in range(full, tokens, piece):
                        part = code[4 * start : 4 * (start + piece)]
                        if total + len(part) // 4 > group * window - window // 8:
                            rows += deal()
                            waiting, total = [], 0
                        waiting.append((doc, start, part, tokens))
                        total += len(part) // 4
                if rows:
                    yield batch(rows)
        if waiting:
            yield batch(deal())

    return held.mapInArrow(pack, schema)
