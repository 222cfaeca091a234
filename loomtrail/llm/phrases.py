"""Phrases that words make together, counted by an FM-index for each shard of documents.

A shard is a batch of documents. Its index over word ids has the Burrows-Wheeler transforms of the text and of the
reversed text. Intervals of words are extended to the left in the first and to the right in the second, in step, which
gives every pair of words and every run of three with its count. Counts are summed across shards by Spark.

A phrase of ten occurrences has no part with fewer. So rarer words stand as breaks in the index, and runs of three
are extended only from pairs in a bitmap of the frequent ones. It has a fixed size and lets some rarer pairs through,
but never loses a frequent one, so that counts are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

#: Characters of a shard.
SHARD = 16_000_000
#: Bits of the bitmap of frequent pairs, as a power of two: 16 MB.
BITS = 27
#: Rows that a task sends at once.
ROWS = 1 << 18

# fixed values: what ends a piece, and the byte that stands for it, which UTF-8 doesn't have
_BREAKS = ".,;:!?\n\x0b\x0c\r"
_BREAK = b"\xff"
_TO_BREAK = bytes(0xFF if chr(b) in _BREAKS else b for b in range(256))


class Extensions(NamedTuple):
    """Extensions of intervals by one symbol: the interval that is extended, the symbol, the count."""

    of: np.ndarray
    symbol: np.ndarray
    n: np.ndarray


class Index:
    """The FM-index of a text of symbols, of which 0 is the break, for patterns of two symbols and one more: the symbol before
    each suffix, in the order of suffixes by their first two symbols, and where each symbol's suffixes begin."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        wide = text.astype(np.int64)
        order = np.argsort((wide << 32) | np.roll(wide, -1), kind="stable")
        self.bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        # the last-to-first mapping: rows by their symbol, each symbol's in order
        self.rows = np.argsort(self.bwt, kind="stable")

    def extended(self, low: np.ndarray, high: np.ndarray) -> Extensions:
        """All extensions of disjoint intervals [low, high) that ascend, by symbol and then by interval. In the order
        of the mapping each extension is a run of rows, and the run is its interval."""
        of = np.full(len(self.bwt), -1, dtype=np.int64)
        size = high - low
        within = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        of[within] = np.repeat(np.arange(len(low)), size)
        of, symbol = of[self.rows], self.bwt[self.rows]
        inside = np.flatnonzero(of >= 0)
        of, symbol = of[inside], symbol[inside]
        begins = np.flatnonzero((np.diff(of, prepend=-2) != 0) | (np.diff(symbol, prepend=-1) != 0))
        return Extensions(of[begins], symbol[begins], np.diff(begins, append=len(of)))


def pairs_of(index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, second word, count, begin of its interval in the index of the reversed text) of every pair, by
    second word and then first."""
    words = np.arange(1, len(index.first) - 1)
    found = index.extended(index.first[words], index.first[words + 1])
    second = words[found.of]
    order = np.lexsort((found.symbol, second))
    first, second, n = found.symbol[order], second[order], found.n[order]
    # in the reversed text a word's rows are in the order of the symbol before it, breaks first, and so are its pairs
    before = np.cumsum(n) - n
    begins = np.flatnonzero(np.diff(second, prepend=-1))
    start = index.first[second] + before - np.repeat(before[begins], np.diff(begins, append=len(second)))
    real = first > 0
    return first[real], second[real], n[real], start[real]


def threes_of(reverse: Index, n: np.ndarray, start: np.ndarray) -> Extensions:
    """The extensions to the right of pairs, given by count and begin in the index of the reversed text."""
    order = np.argsort(start)
    found = reverse.extended(start[order], (start + n)[order])
    real = found.symbol > 0
    return Extensions(order[found.of[real]], found.symbol[real], found.n[real])


def segments(text: str, most: int) -> Iterator[str]:
    """A text cut at ends of pieces, so that parts are of about ``most`` characters."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(c, at, at + most) for c in _BREAKS)
        if end < 0:
            later = [p for c in _BREAKS if (p := text.find(c, at + most)) >= 0]
            if not later:
                break
            end = min(later)
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


def shards(texts: Iterator[tuple[str, str]], most: int) -> Iterator[list[tuple[str, str]]]:
    """(language, text) in runs of about ``most`` characters; long texts are cut at ends of pieces."""
    run, size = [], 0
    for lang, text in texts:
        for part in segments(text, most):
            run.append((lang, part))
            size += len(part) + 1
            if size >= most:
                yield run
                run, size = [], 0
    if run:
        yield run


def numbered(run: list[tuple[str, str]]) -> tuple[dict[str, list[bytes]], np.ndarray]:
    """The distinct words of a shard by language, the most frequent of each first, and its text as their numbers, counted
    on from language to language, -1 for an end of a piece."""
    words, parts, by_lang, before = {}, [], defaultdict(list), 0
    for lang, text in run:
        by_lang[lang].append(text)
    for lang, texts in sorted(by_lang.items()):
        data = "\n".join(texts).encode().lower().translate(_TO_BREAK).replace(_BREAK, b" \xff ").split()
        number = defaultdict(count().__next__)
        number[_BREAK] = -1
        ids = np.fromiter(map(number.__getitem__, data), np.int32, len(data))
        del number[_BREAK]
        order = np.argsort(-np.bincount(ids[ids >= 0], minlength=len(number)), kind="stable")
        rank = np.empty(len(number) + 1, dtype=np.int32)
        rank[order], rank[-1] = np.arange(before, before + len(number), dtype=np.int32), -1
        own = list(number)
        words[lang] = [own[k] for k in order]
        parts += [rank[ids], [-1]]
        before += len(number)
    return words, np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, dtype=np.int32)


def _zip(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unzip(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True) if packed else b""


def _pack(text: np.ndarray) -> bytes:
    """Numbers from -1 on: all their low bytes, then all second ones, and so on, which compress better by themselves."""
    return _zip(np.ascontiguousarray((text + 1).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unzip(packed), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int32) - 1


def symbols_of(text: np.ndarray, k: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text with 1, 2, ... for words number ``k`` and 0 for all else, breaks as one, and the id of each symbol."""
    symbol = np.zeros((k.max() if len(k) else -1) + 2, dtype=np.int32)
    symbol[k] = np.arange(1, len(k) + 1)
    out = symbol[np.where((text >= 0) & (text < len(symbol) - 1), text, len(symbol) - 1)]
    out = np.concatenate([[0], out, [0]]).astype(np.int32)
    return out[(out > 0) | (np.diff(out, prepend=1) != 0)], np.concatenate([[-1], ids]).astype(np.int64)


def _slots(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each pair of ids."""
    with np.errstate(over="ignore"):
        mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (second.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        return mixed >> np.uint64(64 - bits)


def _bitmap(pairs: DataFrame, bits: int) -> np.ndarray:
    """A bit for each pair (w1, w2), others' bits with it. Tasks send 64 bits at once, which Spark puts together."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slots(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    rows = pairs.select("w1", "w2").mapInArrow(each, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def _sent(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + ROWS].astype(np.int64)) for c in columns], names=names)


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for n in range(batch.num_rows):
            k, ids, text = (batch.column(c)[n] for c in ("k", "id", "text"))
            if len(k):
                yield symbols_of(_unpack(text.as_py()), k.values.to_numpy(), ids.values.to_numpy())


def _each_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of shards as rows (shard, k, lang, word, n)."""
    for batch in batches:
        for shard, langs, sizes, words, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "langs", "sizes", "words", "text")), strict=True):
            text, words = _unpack(text), _unzip(words).split()
            n, langs = np.bincount(text[text >= 0], minlength=len(words)), pa.array(langs, pa.string()).take(pa.array(np.repeat(np.arange(len(langs)), sizes)))
            for at in range(0, len(words), ROWS):
                part = pa.array(words[at : at + ROWS], pa.string())
                k = np.arange(at, at + len(part), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), shard)), pa.array(k), langs[at : at + ROWS], part, pa.array(n[k].astype(np.int64))], names=["shard", "k", "lang", "word", "n"])


def _each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for text, ids in _read_shards(batches):
        first, second, n, _ = pairs_of(Index(text, len(ids)))
        yield from _sent([ids[first], ids[second], n], ["w1", "w2", "n"])


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What ``docs`` says at least ``least`` times: words (lang, word, n, id), pairs (w1, w2, n) and runs of three
    (w1, w2, w3, n), the last two by ids of words; and how many words a language has, (lang, n)."""
    sc = docs.sparkSession.sparkContext

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        texts = ((lang, text) for b in batches for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for run in shards(texts, SHARD):
            words, text = numbered(run)
            own = [[number], [list(words)], [[len(w) for w in words.values()]], [_zip(b" ".join(w for ws in words.values() for w in ws))], [_pack(text)]]
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(own, kinds, strict=True)], names=["shard", "langs", "sizes", "words", "text"])
            number += 1

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), text_of(F.col(text_col)))
    kept = cut(rows.mapInArrow(read, "shard long, langs array<string>, sizes array<int>, words binary, text binary"))
    sent = kept.mapInArrow(_each_word, "shard long, k int, lang string, word string, n long")
    sizes = sent.groupBy("lang").agg(F.sum("n").alias("n"))
    # written, so that the ids stay what they are; and the join has exchanges of its own, which may be split at a word
    # that every shard has
    words = cut(sent.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).withColumn("id", F.monotonically_increasing_id()))
    found = sent.select("shard", "k", "lang", "word").join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("k", "id")).alias("found"))
    indexed = cut(kept.select("shard", "text").join(found, "shard").select("text", "found.k", "found.id"))
    pairs = cut(indexed.mapInArrow(_each_pair, "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    frequent, bits = sc.broadcast(_bitmap(pairs, BITS)), BITS

    def is_frequent(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        slot = _slots(first, second, bits)
        return (frequent.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0

    def each_three(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, ids in _read_shards(batches):
            first, second, n, start = pairs_of(Index(text, len(ids)))
            on = is_frequent(ids[first], ids[second])
            first, second, n, start = first[on], second[on], n[on], start[on]
            of, third, n = threes_of(Index(text[::-1], len(ids)), n, start)
            on = is_frequent(ids[second[of]], ids[third])
            yield from _sent([ids[first[of[on]]], ids[second[of[on]]], ids[third[on]], n[on]], ["w1", "w2", "w3", "n"])

    threes = cut(indexed.mapInArrow(each_three, "w1 long, w2 long, w3 long, n long").groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    return words, pairs, threes, sizes


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)) in whole numbers of 38 digits, exact for counts of up to 13 digits."""
    whole = lambda c: f"CAST({c} AS DECIMAL(13,0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({whole(a)} * {whole(a)})) DIV ({whole(left)} * {whole(right)})")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, most: int = 2000) -> DataFrame:
    """For each language its ``most`` phrases of two or three words that keep together best: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. A
    phrase has ``a`` >= ``least`` occurrences in pieces, overlaps included; ``n`` counts the words of its language. Of its cuts in two,
    with counts ``l`` and ``r``, the one with the lowest score floor(1000000 a a / (l r)) counts, the first of equal ones.
    A phrase goes if a longer one that holds it has at least half its occurrences. Ranks are by score, then a, then
    phrase in byte order.

    A null text is empty and a null language ``und``; repeated rows count each; an empty table gives no rows; other columns are
    not read. A text of any length is cut at ends of pieces; a piece is held whole. A word or phrase of any frequency is
    one row a shard, summed before the shuffle.
    """
    words, pairs, threes, sizes = counted(docs, text_col, lang_col, least)
    # all words of a phrase are of one language, that of the first
    word = lambda nth: words.select(F.col("id").alias(f"w{nth}"), F.col("word").alias(f"word{nth}"), F.col("n").alias(f"n{nth}"), *(["lang"] if nth == 1 else []))
    inside = threes.select("w1", "w2", "n").unionByName(threes.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "n"))
    longer = inside.groupBy("w1", "w2").agg(F.max("n").alias("longer"))
    twos = pairs.join(longer, ["w1", "w2"], "left").where("longer IS NULL OR 2 * longer < n").drop("longer")
    twos = twos.join(word(1), "w1").join(word(2), "w2")
    two = twos.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), F.col("n").alias("a"), F.col("n1").alias("l"), F.col("n2").alias("r"), _score("n", "n1", "n2").alias("score"))
    joined = threes.join(pairs.withColumnRenamed("n", "n12"), ["w1", "w2"]).join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("n23")), ["w2", "w3"])
    joined = joined.join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    cuts = joined.withColumn("s1", _score("n", "n1", "n23")).withColumn("s2", _score("n", "n12", "n3"))
    early = F.col("s1") <= F.col("s2")
    three = cuts.select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), F.col("n").alias("a"),
        F.when(early, F.col("n1")).otherwise(F.col("n12")).alias("l"), F.when(early, F.col("n23")).otherwise(F.col("n3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    best_first = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = _ranked(two.unionByName(three), (F.col("score").desc(), F.col("a").desc(), F.col("phrase")))
    return ranked.where(F.col("rank") <= most).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def _ranked(rows: DataFrame, best_first: tuple[Column, ...]) -> DataFrame:
    """``rows`` with their rank within ``lang``, from 1. Rows are sorted by ranges, so that no language is one task: a rank is
    that within the range and how many of the language stand in ranges before."""
    ranges = cut(cut(rows).repartitionByRange("lang", *best_first).withColumn("range", F.spark_partition_id()))
    each = ranges.groupBy("lang", "range").agg(F.count("*").alias("many"))
    # a row for each language and range
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("lang", "range", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("before"))
    within = ranges.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "range").orderBy(*best_first)))
    return within.join(offsets, ["lang", "range"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long")).drop("range", "before")
