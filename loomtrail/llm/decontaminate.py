"""Benchmark decontamination by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Edits allowed for each letter of a passage, letters of the shortest passage that is searched.
EDIT_RATE, SHORTEST = 0.1, 8
#: Length of a q-gram for passages from so many letters on: the longest power of two with which the lemma asks for one
#: shared q-gram at least, whatever the length.
Q_FROM = {SHORTEST: 4, 32: 8}
#: Characters that are searched at once in a task; characters of the benchmark in one broadcast block.
PIECE, BLOCK = 1_000_000, 4_000_000
#: Pairs of a q-gram of the text and one of a passage that are spelled out at once, cells of an alignment row.
PAIRS, CELLS = 2_000_000, 2_000_000
_FILTER_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def _fold() -> np.ndarray:
    """For each code point below 65,536 its lower-case form if that is a letter or digit, else 0."""
    table = np.zeros(1 << 16, dtype=np.uint16)
    for c in range(1 << 16):
        lower = chr(c).lower()
        if unicodedata.category(chr(c))[0] in "LNM" and len(lower) == 1:
            table[c] = ord(lower)
    return table


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text as folded letters and digits with 1 for each run of anything else, and their positions."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = _fold()[np.minimum(points, 0xFFFF)]
    folded[points > 0xFFFF] = (points[points > 0xFFFF] & 0x7FFF) | 0x8000
    gap = folded == 0
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    at = np.flatnonzero(keep)
    return np.maximum(folded[at], 1), at


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of every q-gram; q is a power of two."""
    out, factor, have = codes.astype(np.uint64), _MULTIPLIER, 1
    with np.errstate(over="ignore"):
        while have < q:
            out = out[:-have] * factor + out[have:] if len(out) > have else out[:0]
            factor, have = factor * factor, 2 * have
    return out


@dataclass
class Index:
    """Some passages of one q: their letters, edit budgets, bands, thresholds and sorted q-grams."""

    q: int
    ids: list[int]
    codes: list[np.ndarray]
    length: np.ndarray
    budget: np.ndarray
    need: np.ndarray
    width: np.ndarray
    grams: np.ndarray
    start: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    filter: np.ndarray

    @property
    def wide(self) -> np.ndarray:
        """Diagonals that are aligned: two bands, and the budget on both sides."""
        return 2 * (self.width + self.budget)


def build_indexes(items: list[tuple[int, str]], rate: float = EDIT_RATE) -> list[Index]:
    """Indexes of passages (id, text), one for each q. A passage of m letters has the budget k of rate * m edits; q is
    such that the lemma's bound m + 1 - q * (k + 1) is 1 at least. Passages of under SHORTEST letters are not searched:
    nearly every text has them by chance."""
    by_q: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, text in items:
        if i is None or text is None:
            continue
        c, _ = letters(text)
        c = c[1:] if len(c) and c[0] == 1 else c
        c = c[:-1] if len(c) and c[-1] == 1 else c
        if len(c) >= SHORTEST:
            by_q.setdefault(Q_FROM[max(m for m in Q_FROM if m <= len(c))], []).append((int(i), c))
    return [_index(q, *map(list, zip(*found, strict=True)), rate) for q, found in sorted(by_q.items())]


def _index(q: int, ids: list[int], codes: list[np.ndarray], rate: float) -> Index:
    m = np.array([len(c) for c in codes])
    k = np.minimum((rate * m + 1e-9).astype(np.int64), m // q - 1)
    all_grams = [grams(c, q) for c in codes]
    flat, item = np.concatenate(all_grams), np.repeat(np.arange(len(ids)), [len(g) for g in all_grams])
    offset = np.concatenate([np.arange(len(g)) for g in all_grams])
    order = np.argsort(flat, kind="stable")
    distinct, start = np.unique(flat[order], return_index=True)
    bloom = np.zeros(1 << _FILTER_BITS, dtype=bool)
    bloom[_slot(distinct)] = True
    return Index(q, ids, codes, m, k, m + 1 - q * (k + 1), np.maximum(k + 1, q), distinct, np.append(start, len(flat)), item[order], offset[order], bloom)


def _slot(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (codes * _MULTIPLIER) >> np.uint64(64 - _FILTER_BITS)


def search(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int, int]]:
    """All (text number, passage id, first position, end position, edits) with edits within the budget.

    A passage that a text holds several times is found in each band of diagonals; of overlapping finds
    the one with the fewest edits stays.
    """
    regions: list[_Region] = []
    group, size = [], 0
    for n, text in enumerate(texts):
        if text:
            group.append(n)
            size += len(text)
        if group and (size >= PIECE or n == len(texts) - 1):
            regions += _dense_regions([texts[g] for g in group], group, index)
            group, size = [], 0
    best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for n, edits, start, end in _verify(regions, index):
        region = regions[n]
        best.setdefault((region.text, region.item), []).append((edits, int(region.position[start]), int(region.position[end - 1]) + 1))
    found = []
    for (text, item), spans in best.items():
        taken: list[tuple[int, int]] = []
        for edits, start, end in sorted(spans):
            # those taken don't overlap, so that only the neighbours can be in the way
            n = bisect_right(taken, (start, end))
            if (n == 0 or taken[n - 1][1] <= start) and (n == len(taken) or end <= taken[n][0]):
                insort(taken, (start, end))
                found.append((text, index.ids[item], start, end, edits))
    return found


class _Region(NamedTuple):
    """A piece of a text that may hold a passage: its letters, where they stand in the text, and the
    diagonal on which the band begins, from the piece's first letter."""

    text: int
    item: int
    codes: np.ndarray
    position: np.ndarray
    low: int


def _dense_regions(texts: list[str], numbers: list[int], index: Index) -> list[_Region]:
    """The regions that share as many q-grams with a passage, in a band, as the lemma asks for."""
    parts = [letters(t) for t in texts]
    codes = np.concatenate([c for c, _ in parts])
    ends = np.cumsum([len(c) for c, _ in parts])
    begins = ends - [len(c) for c, _ in parts]
    all_grams = grams(codes, index.q)
    maybe = np.flatnonzero(index.filter[_slot(all_grams)])
    where = np.minimum(np.searchsorted(index.grams, all_grams[maybe]), len(index.grams) - 1)
    true = index.grams[where] == all_grams[maybe]
    at, where = maybe[true], where[true]
    doc = np.searchsorted(ends, at, side="right")
    inside = at + index.q <= ends[doc]
    at, where, doc = at[inside], where[inside], doc[inside]
    # texts lie so far apart that no band of diagonals touches two of them
    gap = int(index.wide.max()) + int(index.length.max()) + 1
    keys, counts, doc = _bands(at, where, doc, gap, index)
    # overlapping bands, two widths wide: what a band and the next one have together
    both = counts.copy()
    follows = np.flatnonzero(keys[1:] == keys[:-1] + 1)
    both[follows] += counts[follows + 1]
    item = keys >> 40
    dense = both >= index.need[item]
    doc = doc[dense]
    item, low = item[dense].astype(np.int64), ((keys[dense] & ((1 << 40) - 1)) * index.width[item[dense]])
    # edits before the first shared q-gram may begin that many diagonals below the band, those after the last end above
    low -= (doc + 1) * gap + index.budget[item]
    left = np.maximum(low, begins[doc])
    right = np.minimum(low + index.wide[item] + index.length[item], ends[doc])
    return [
        _Region(numbers[d], i, codes[x:y], parts[d][1][x - begins[d] : y - begins[d]], at - x)
        for d, i, x, y, at in zip(doc.tolist(), item.tolist(), left.tolist(), right.tolist(), low.tolist(), strict=True)
        if x < y
    ]


def _bands(at: np.ndarray, where: np.ndarray, doc: np.ndarray, gap: int, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage and band, q-grams shared in it, text) of the q-grams ``where`` found at ``at``. Pairs are spelled out by
    PAIRS, so that repeated q-grams in a text and a passage cost time but no memory."""
    many = index.start[where + 1] - index.start[where]
    upto = np.cumsum(many)
    keys, counts, docs = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, side="right")))
        s = slice(begin, end)
        n = many[s]
        place = np.repeat(index.start[where[s]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, of = index.item[place], np.repeat(doc[s], n)
        diagonal = np.repeat(at[s], n) - index.offset[place] + (of + 1) * gap
        # all q-grams of a band are of one text, which its first one names
        new, first, count = np.unique((item.astype(np.int64) << 40) | (diagonal // index.width[item]), return_index=True, return_counts=True)
        keys, where_first, inverse = np.unique(np.concatenate([keys, new]), return_index=True, return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([counts, count]), minlength=len(keys)).astype(np.int64)
        docs = np.concatenate([docs, of[first]])[where_first]
        begin = end
    return keys, counts, docs


def _verify(regions: list[_Region], index: Index) -> list[tuple[int, int, int, int]]:
    """(region, edits, first, end) of those that hold their passage within its budget; verbatim ones at once."""
    found, rest = [], []
    for n, region in enumerate(regions):
        passage = index.codes[region.item]
        where = _find(region.codes, passage)
        if where >= 0:
            found.append((n, 0, where, where + len(passage)))
        else:
            rest.append(n)
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for n, _, start, end in found:
        taken.setdefault((regions[n].text, regions[n].item), []).append((int(regions[n].position[start]), int(regions[n].position[end - 1]) + 1))
    rest = [n for n in rest if _has_room(regions[n], taken.get((regions[n].text, regions[n].item), []), index)]
    wide = index.wide
    # of like width together, so that narrow ones aren't padded to a wide one, and CELLS of them at once
    rest.sort(key=lambda n: wide[regions[n].item])
    while rest:
        n_now = max(1, int(np.searchsorted(np.arange(1, len(rest) + 1) * wide[[regions[n].item for n in rest]], CELLS, side="right")))
        rest, now = rest[n_now:], rest[:n_now]
        found += _aligned(regions, now, index)
    return found


def _has_room(region: _Region, taken: list[tuple[int, int]], index: Index) -> bool:
    """Whether the passage may stand in the region beside the places where it stands letter by letter: what overlaps
    such a place has more edits than it and would go."""
    free, longest = 0, 0
    for start, end in [*sorted(taken), (1 << 62, 1 << 62)]:
        longest = max(longest, int(np.searchsorted(region.position, start)) - free)
        free = max(free, int(np.searchsorted(region.position, end)))
    return longest >= index.length[region.item] - index.budget[region.item]


def _aligned(regions: list[_Region], rest: list[int], index: Index) -> list[tuple[int, int, int, int]]:
    found = []
    if rest:
        ends = np.cumsum([len(regions[n].codes) for n in rest])
        begins = ends - [len(regions[n].codes) for n in rest]
        item, low = np.array([regions[n].item for n in rest]), begins + [regions[n].low for n in rest]
        for n, edits, start, end in align(index, item, np.concatenate([regions[n].codes for n in rest]), low, begins, ends):
            found.append((rest[n], edits, int(start - begins[n]), int(min(end, ends[n]) - begins[n])))
    return found


def _find(text: np.ndarray, passage: np.ndarray) -> int:
    """Where the passage first stands in the text letter by letter, or -1."""
    hay, needle = text.tobytes(), passage.tobytes()
    at = hay.find(needle)
    while at >= 0 and at % text.itemsize:
        at = hay.find(needle, at + 1)
    return at // text.itemsize if at >= 0 else -1


_FAR = 1 << 20


def align(index: Index, item: np.ndarray, text: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Banded alignment of whole passages, row by row for all candidates at once.

    Candidate n aligns passage item[n] with text[begin[n]:end[n]] along the ``wide`` diagonals from low[n] on; ends are free. Returns (n, edits, first, end) for those within
    budget; a candidate over budget in every cell is left out of further rows.
    """
    if not len(item):
        return []
    live, found = np.arange(len(item)), []
    band = int(index.wide[item].max())
    steps = np.arange(band)
    lengths = index.length
    used = np.unique(item)
    passages = np.concatenate([index.codes[n] for n in used])
    starts = np.zeros(len(lengths), dtype=np.int64)
    starts[used] = np.cumsum(lengths[used]) - lengths[used]
    where = low[:, None] + steps
    outside = steps >= index.wide[item][:, None]
    cost = np.where((where >= begin[:, None]) & (where <= end[:, None]) & ~outside, 0, _FAR)
    begun = where.copy()
    for i in range(int(lengths[item].max())):
        done = lengths[item[live]] == i
        if done.any():
            for n, c, b in zip(live[done].tolist(), cost[done], begun[done], strict=True):
                at = int(c.argmin())
                if c[at] <= index.budget[item[n]]:
                    found.append((n, int(c[at]), int(b[at]), int(low[n] + at + i)))
            live, cost, begun = live[~done], cost[~done], begun[~done]
        at = low[live, None] + steps + i  # the letter of the text that meets letter i of the passage
        fits = (at >= begin[live, None]) & (at < end[live, None])
        other = text[np.clip(at, 0, len(text) - 1)] != passages[starts[item[live]] + i][:, None]
        straight = np.where(fits, cost + other, _FAR)
        skipped = np.full_like(cost, _FAR)  # the passage has a letter more
        skipped[:, :-1] = cost[:, 1:] + 1
        skipped[(at < begin[live, None] - 1) | (at >= end[live, None] + 1)] = _FAR
        new = np.minimum(straight, skipped)
        start = begun.copy()
        start[:, :-1] = np.where(straight[:, :-1] <= skipped[:, :-1], begun[:, :-1], begun[:, 1:])
        # letters of the text that the passage lacks, from the left
        least = np.minimum.accumulate((new - steps) * _FAR + steps, axis=1)
        source = least & (_FAR - 1)
        cost = np.take_along_axis(new, source, 1) + steps - source
        begun = np.take_along_axis(start, source, 1)
        within = cost.min(axis=1) <= index.budget[item[live]]
        if not within.all():
            live, cost, begun = live[within], cost[within], begun[within]
            if not len(live):
                return found
    for n, c, b in zip(live.tolist(), cost, begun, strict=True):
        at = int(c.argmin())
        if c[at] <= index.budget[item[n]]:
            found.append((n, int(c[at]), int(b[at]), int(low[n] + at + lengths[item[n]])))
    return found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of the benchmark, by blocks of about BLOCK characters: that bounds what is broadcast at once."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK))
    for b in range(n):
        items = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).orderBy("id", "text").collect()
        yield from build_indexes([(r["id"], r["text"]) for r in items])


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first_char, end_char, edits) for every passage of ``benchmark`` found in a text.

    Texts and passages are compared as lower-case letters and digits, with one gap for anything between. A
    passage of m letters is found wherever a region of the text is within m / 10 edits of all of it: such
    a region shares m + 1 - q * (k + 1) q-grams in a band of diagonals, and those that do are aligned. Whole
    texts of every row are searched, in pieces of bounded memory; nothing is shuffled. The benchmark is a
    stated query set: it is broadcast in blocks of about 4 million characters, one scan for each. Passages of
    under SHORTEST letters and null ones are not searched. Null or empty texts hold nothing; null ids of documents
    are returned as null; repeated rows are found each, as are passages that repeat. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    schema = "doc_id long, item_id long, first_char long, end_char long, edits long"
    found = spark.createDataFrame([], schema)
    for index in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def each(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                hits = search(batch["text"].tolist(), shared.value)
                ids = batch["doc_id"].astype("Int64").take([h[0] for h in hits]).reset_index(drop=True)
                rest = pd.DataFrame([h[1:] for h in hits], columns=["item_id", "first_char", "end_char", "edits"])
                yield pd.concat([ids, rest], axis=1)

        found = found.unionByName(rows.mapInPandas(each, schema))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no passage of ``benchmark`` is found.

    Null and empty texts hold none and stay; repeated rows stay or go together; an empty benchmark drops nothing.
    """
    position = docs.columns.index(text_col)
    for index in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {h[0] for h in search(batch.column(position).to_pylist(), shared.value)}
                yield batch.filter(pa.array([n not in bad for n in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(each, docs.schema)
    return docs
