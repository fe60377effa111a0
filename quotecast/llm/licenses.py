"""License notices in running text, spelled exactly or nearly so."""

import bisect
import heapq

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import functions as F

# Notices and their labels; words as they come out of the tokens below.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "this work is licensed under the gnu general public license": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under the creative commons attribution license": "cc-by",
    "redistribution and use in source and binary forms": "bsd",
    "this file is subject to the terms of the mozilla public license": "mpl",
    "all rights reserved": "reserved",
}
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
RATE = 0.15
SCHEMA = (
    "doc_id {id}, n_words long, base array<struct<phrase:string,word:long>>, "
    "hits array<struct<label:string,notice:string,first:long,last:long,edits:long,span:string>>"
)
_TO_SPACE = bytes(b if (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) else 32 for b in (x + 32 if 65 <= x <= 90 else x for x in range(256)))


def edits_allowed(notice, rate=RATE):
    """One edit for every 1 / ``rate`` characters, at least one."""
    return max(1, int(len(notice) * rate))


GRAM = 3
STRETCH = 4


class Notice:
    """A notice with its exact seeds, its grams and its pattern with bounded edits.

    ``k`` edits touch at most k of k + 1 parts, so any occurrence with at most k
    edits holds one part unchanged: those parts are the seeds. An edit touches at
    most ``GRAM`` grams of three characters, so an occurrence lacks at most k times
    as many: areas that lack more are passed over before any matching.
    """

    def __init__(self, text, label, rate):
        self.text, self.label, self.edits = text, label, edits_allowed(text, rate)
        bounds = [round(i * len(text) / (self.edits + 1)) for i in range(self.edits + 2)]
        self.seeds = [(a, text[a:b]) for a, b in zip(bounds, bounds[1:])]
        self.grams = {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
        self.lacking = GRAM * self.edits
        self.pattern = regex.compile(rf"(?b)(?:{regex.escape(text)}){{e<={self.edits}}}")

    def near(self, area):
        lacking = 0
        for gram in self.grams:
            if gram not in area:
                lacking += 1
                if lacking > self.lacking:
                    return False
        return True

    def best(self, flat, a, b):
        """(edits, start, end, a, b) of the best occurrence inside a stretch, or nothing."""
        if b - a < len(self.text) - self.edits or not self.near(flat[a:b]):
            return []
        m = self.pattern.search(flat[a:b])
        return [(sum(m.fuzzy_counts), a + m.start(), a + m.end(), a, b)] if m else []

    def spans(self, flat, places):
        """(start, end, edits) of occurrences in word-joined text around the places where they may begin.

        Of overlapping ones the best is taken first (then the one that begins first), then
        those before and behind it. Only stretches of at most ``STRETCH`` times the notice's length
        are searched, a bounded number of times each, so the work grows with the text however many notices stand in a row.
        """
        stretches, size = [], len(flat)
        for place in sorted(set(places)):
            a, b = max(0, place - self.edits), min(size, place + len(self.text) + self.edits)
            if not self.near(flat[a:b]):
                continue
            if stretches and a <= stretches[-1][1] and b - stretches[-1][0] <= STRETCH * len(self.text):
                stretches[-1][1] = b
            else:
                stretches.append([a, b])
        waiting = [hit for a, b in stretches for hit in self.best(flat, a, b)]
        heapq.heapify(waiting)
        found = []  # sorted, without overlaps
        while waiting:
            edits, start, end, a, b = heapq.heappop(waiting)
            at = max(0, bisect.bisect_right(found, (a,)) - 1)
            taken = []
            while at < len(found) and found[at][0] < b:
                taken += [found[at]] * (found[at][1] > a)
                at += 1
            if all(end <= x[0] or x[1] <= start for x in taken):
                bisect.insort(found, (start, end, edits))
                taken = sorted([*taken, found[bisect.bisect_left(found, (start,))]])
            edges = [a, *(edge for x in taken for edge in x[:2]), b]
            for low, high in zip(edges[::2], edges[1::2]):  # the free parts of the stretch
                for hit in self.best(flat, low, high):
                    heapq.heappush(waiting, hit)
        return found


class Words:
    """Numbers of words at places that mostly grow: each counts on from the one before."""

    def __init__(self, flat):
        self.flat, self.at, self.n = flat, 0, 0

    def before(self, place):
        """Spaces in front of a place."""
        if place < self.at:
            self.at = self.n = 0
        self.n += self.flat.count(" ", self.at, place)
        self.at = place
        return self.n


def seeded(known):
    """One automaton for the seeds of all notices: each tells (notice, place in it) pairs."""
    told = {}
    for i, notice in enumerate(known):
        for at, seed in notice.seeds:
            told.setdefault(seed, []).append((i, at + len(seed) - 1))
    automaton = ahocorasick.Automaton()
    for seed, where in told.items():
        automaton.add_word(seed, where)
    automaton.make_automaton()
    return automaton


def scan(docs, id_col="doc_id", text_col="text", notices=None, phrases=None, rate=RATE):
    """A row for each row of docs: doc_id, n_words, base (places of the exact phrases)
    and hits (fuzzy occurrences of the notices: label, notice, first and last word,
    edits and the words found).

    Texts are lower-cased (A-Z only) and cut into words of digits, letters and
    characters beyond ASCII. A notice may differ by one edit (a character put in,
    left out or changed) for every 1 / ``rate`` of its characters. Exact seeds, all
    found in one pass, locate the candidate areas; only those that hold enough of the
    notice's grams are matched with edits, in stretches little longer than the notice,
    so the work grows with the length of a text. Each whole text is searched
    in its own task. Null and empty texts have no words and no hits; repeated rows
    are each reported.
    """
    sought = NOTICES if notices is None else notices
    exact = [(p, f" {p} ") for p in (PHRASES if phrases is None else phrases)]
    held = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = held.schema["doc_id"].dataType.simpleString()

    def look(text, known, automaton):
        words = text.encode().translate(_TO_SPACE).split()
        flat = f" {b' '.join(words).decode()} "
        base = []
        for phrase, spaced in exact:
            i, passed = flat.find(spaced), Words(flat)
            while i >= 0:
                base.append({"phrase": phrase, "word": passed.before(i)})
                i = flat.find(spaced, i + 1)
        places = {}
        for end, where in automaton.iter(flat):
            for i, at in where:
                places.setdefault(i, []).append(end - at)
        hits = []
        for i in sorted(places):
            passed = Words(flat)
            for a, b, edits in known[i].spans(flat, places[i]):
                span = flat[a:b].strip(" ")
                first = passed.before(a + 1 if flat[a] == " " else a) - 1
                hits.append({
                    "label": known[i].label, "notice": known[i].text, "first": first,
                    "last": first + span.count(" "), "edits": edits, "span": span,
                })
        return len(words), base, hits

    def run(stream):
        known = [Notice(t, label, rate) for t, label in sought.items()]
        automaton = seeded(known)
        for batch in stream:
            found = [look(t, known, automaton) for t in batch.column("text").to_pylist()]
            n, base, hits = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(base, BASE), pa.array(hits, HITS)],
                ["doc_id", "n_words", "base", "hits"],
            )

    return held.mapInArrow(run, SCHEMA.format(id=id_type))


BASE = pa.list_(pa.struct([("phrase", pa.string()), ("word", pa.int64())]))
HITS = pa.list_(pa.struct([
    ("label", pa.string()), ("notice", pa.string()), ("first", pa.int64()), ("last", pa.int64()),
    ("edits", pa.int64()), ("span", pa.string()),
]))
