"""Near-duplicate documents by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints at distance 2r or less have a common variant: flip half of the bits in which they
differ. So every distinct fingerprint emits all variants within r = radius // 2 flipped bits, variants
are shuffled, and fingerprints that meet in one are linked (by the triangle inequality they are within
the radius; the distance is verified all the same).

The shuffle key of a variant is its leading bits. All variants of a fingerprint that share a key are
sent as one row, the fingerprint itself, and are spelled out in the task that receives the key; so a
fingerprint costs 1 + p + p(p-1)/2 rows for p leading bits instead of 2,081. p follows the count of
fingerprints and keeps the number of variants per key level. Keys with very many variants are dealt
again by further bits, as often as it takes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_tag, cut, keep_rows, text_of
from .components import connected_components, local_roots
from .tokens import pieces, split_words, xxh64

BITS = 64
#: Variants that a task spells out at once (8 bytes each).
CHUNK = 8_000_000
#: Variants aimed at for each key, times as many above which it is dealt again, further bits, bits dealt at most.
PER_KEY, HOT, HOT_BITS, MOST_BITS = 1_000_000, 8, 8, 56


def simhash(texts: list[str | None], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprints of texts, unsigned. Null or wordless: 0."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for begun, piece in pieces(texts):
        words = split_words(piece)
        n_words = np.diff(words.first)
        n_hashes = np.where(n_words > shingle, n_words - shingle + 1, np.minimum(n_words, 1))
        text = np.repeat(np.arange(len(piece)), n_hashes)
        stop = np.cumsum(n_hashes)
        nth = np.arange(len(text)) - np.repeat(stop - n_hashes, n_hashes)
        left = words.first[:-1][text] + nth
        right = np.minimum(left + shingle, words.first[1:][text]) - 1
        hashes = xxh64(words.data, words.start[left], words.end[right], seed)
        for t, (i, j) in enumerate(zip((stop - n_hashes).tolist(), stop.tolist(), strict=True)):
            if i < j:
                out[begun + t] = _majority(hashes[i:j])
    return out


def _majority(hashes: np.ndarray) -> np.uint64:
    """A bit is 1 if set in over half of the hashes."""
    set_bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        set_bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp, tag) for every row; fp is the 64-bit SimHash over word shingles as a signed long.

    A bit is 1 if set in over half of the shingles' XXH64, repeats included. Fewer words than a shingle:
    the whole sequence is one; no words or a null text: 0. Rows are mapped one by one, so neither
    long texts nor repeated rows matter.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = simhash(batch["text"].tolist(), shingle, seed)
            yield pd.DataFrame({"id": batch["id"], "fp": prints.view(np.int64), "tag": batch["tag"]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(F.col(text_col)).alias("text"), content_tag(F.col(text_col)).alias("tag"))
    return rows.mapInPandas(each, "id long, fp long, tag long")


def flips(bits: int, most: int) -> list[int]:
    """All masks over ``bits`` bits with at most ``most`` set."""
    return [sum(1 << b for b in c) for k in range(min(bits, most) + 1) for c in combinations(range(bits), k)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long")


def link(prints: DataFrame, radius: int = 4) -> DataFrame:
    """``prints``: distinct fingerprints (fp). Returns (fp, root) for all that aren't their component's root.

    A pair of fingerprints within ``radius`` bits is always in one component, no pair beyond it is linked
    but through others. Each key returns a spanning forest of what it found, so a group of n close
    fingerprints gives n rows a key, never n squared.
    """
    most = radius // 2
    if radius != 2 * most:
        raise ValueError("radius must be even: both sides emit variants within half of it")
    n = max(1, prints.count())
    variants = n * len(flips(BITS, most))
    p = min(24, max(6, math.ceil(math.log2(variants / PER_KEY + 1))))
    masks = flips(p, most)
    rows = prints.select(
        "fp",
        F.explode(F.array([F.struct(_signed(m << (BITS - p)).alias("mask"), F.lit(m.bit_count()).alias("used")) for m in masks])).alias("flip"),
    ).select("fp", F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("flip.mask")), BITS - p).alias("key"), "flip.used")
    dealt, bits = [], p
    while bits + HOT_BITS <= MOST_BITS:
        # every variant has one key, so that at most 2 ** p / HOT keys are hot: that bounds what is broadcast (16 MB)
        limit = HOT * max(PER_KEY, variants >> p)
        spelled = F.element_at(F.array([F.lit(len(flips(BITS - bits, most - k))) for k in range(most + 1)]), F.col("used") + 1)
        hot = cut(rows.groupBy("key").agg(F.sum(spelled).alias("variants")).where(F.col("variants") > limit).select("key"))
        if hot.isEmpty():
            break
        dealt.append(rows.join(F.broadcast(hot), "key", "left_anti").withColumn("bits", F.lit(bits)))
        further = F.array([F.array([_signed(m << (BITS - bits - HOT_BITS)) for m in flips(HOT_BITS, most - k)]) for k in range(most + 1)])
        # what the leading bits are in the variant: those of the key, then those of the fingerprint with flips
        again = rows.join(F.broadcast(hot), "key", "left_semi").select("fp", "key", "used", F.explode(F.element_at(further, F.col("used") + 1)).alias("mask"))
        low = F.shiftrightunsigned(F.shiftleft(F.col("fp").bitwiseXOR(F.col("mask")), bits), BITS - HOT_BITS)
        rows = again.select("fp", F.shiftleft("key", HOT_BITS).bitwiseOR(low).alias("key"), (F.col("used") + F.bit_count("mask")).alias("used"))
        bits += HOT_BITS
    rows = rows.withColumn("bits", F.lit(bits))
    for part in dealt:
        rows = rows.unionByName(part)

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        prints, roots = meetings(group["fp"].to_numpy().view(np.uint64), group["used"].to_numpy(), int(key[1]), most)
        return pd.DataFrame({"fp": prints.view(np.int64), "root": roots.view(np.int64)})

    found = rows.groupBy("key", "bits").applyInPandas(meet, "fp long, root long")
    return connected_components(found.distinct()).toDF("fp", "root")


def meetings(prints: np.ndarray, used: np.ndarray, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Within one key, the fingerprints that share a variant: each with the first of its component.

    ``used``: flips that a fingerprint has spent on the leading ``bits`` bits.
    """
    owner = np.arange(len(prints))
    low = prints & np.uint64((1 << (BITS - bits)) - 1) if bits else prints
    pairs = list(_shared(low, owner, most - used, BITS - bits))
    if not pairs:
        return prints[:0], prints[:0]
    a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
    near = np.bitwise_count(prints[a] ^ prints[b]) <= 2 * most
    root = local_roots(a[near], b[near], len(prints))
    apart = root != owner
    return prints[apart], prints[root[apart]]


def _shared(low: np.ndarray, owner: np.ndarray, left: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (first owner, other owner) of each variant of the low ``bits`` bits that has several owners."""
    masks = {k: np.array(flips(bits, k), dtype=np.uint64) for k in np.unique(left).tolist()}
    if sum(int((left == k).sum()) * len(m) for k, m in masks.items()) > CHUNK and bits > 8:
        step = 4
        head, rest = low >> np.uint64(bits - step), low & np.uint64((1 << (bits - step)) - 1)
        for s in range(1 << step):
            spent = np.bitwise_count(head ^ np.uint64(s)).astype(left.dtype)
            within = spent <= left
            if within.sum() > 1:
                yield from _shared(rest[within], owner[within], (left - spent)[within], bits - step)
        return
    variants = np.concatenate([(low[left == k][:, None] ^ m[None, :]).ravel() for k, m in masks.items()])
    ordered = np.sort(variants)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return
    owners = np.concatenate([np.repeat(owner[left == k], len(m)) for k, m in masks.items()])
    place = np.minimum(np.searchsorted(twice, variants), len(twice) - 1)
    hit = twice[place] == variants
    place, owners = place[hit], owners[hit]
    first = np.full(len(twice), np.iinfo(np.int64).max)
    np.minimum.at(first, place, owners)
    edge = np.unique(np.stack([first[place], owners], axis=1), axis=0)
    edge = edge[edge[:, 0] != edge[:, 1]]
    yield edge[:, 0], edge[:, 1]


def components(prints: DataFrame, radius: int = 4) -> DataFrame:
    """``prints``: (id, fp, ...), a row for each document. Returns (fp, component): the smallest id reachable.

    Documents with one fingerprint are linked like any other. Null ids take part but name no component; a
    component with null ids only has null. Work after the grouping by fingerprint is over distinct ones.
    """
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    linked = link(nodes.select("fp"), radius)
    members = linked.unionByName(linked.select(F.col("root").alias("fp"), "root").distinct())
    named = nodes.join(members, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # cut, so that the join has an exchange of its own, which may be split at the root of a large component
    least = cut(named.groupBy("root").agg(F.min("least").alias("component")))
    return named.join(least, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null and wordless texts have the fingerprint 0 and are linked like any other; a null id has a row and names no
    component. Repeated rows come back as often as they are there. Empty tables give no rows; other columns of ``docs``
    are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    return prints.join(components(prints, radius), "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Repeated rows (one id, one text) become one. If one id has several texts, the smallest content tag
    decides. Components with null ids only keep one row.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    named = prints.join(components(prints, radius), "fp")
    by_component = named.groupBy("component", F.when(F.col("component").isNull(), F.col("fp")).alias("alone"))
    first = by_component.agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "tag")).alias("keep")).select("keep.*")
    size = prints.groupBy("id", "tag").agg(F.count("*").alias("n"))
    same = first["id"].eqNullSafe(size["id"]) & (first["tag"] == size["tag"])
    keepers = first.join(size, same).select(first["id"].alias("keep_id"), first["tag"].alias("keep_tag"), F.col("n").alias("keep_n"))
    return keep_rows(docs, cut(keepers), id_col, text_col)
