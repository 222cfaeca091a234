"""Repeated passages by content-defined chunking with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_tag, cut, fresh, text_of, within_bytes
from .tokens import pieces, split_words, xxh64

#: Bytes that the gear hash looks back, hash bits that must be zero at a cut, words of a chunk at most.
LOOK_BACK, CUT_BITS, MOST = 16, 2, 64
#: Words of consecutive repeated chunks from which on a passage counts, and of one that is extended to its exact ends.
LEAST_WORDS, EXACT_WORDS = 30, 51
#: Words before the first common cut of a passage: those that fill LOOK_BACK bytes, and the one after them.
UNSETTLED = LOOK_BACK // 2 + 2
#: Bytes up to which the places to look at in documents are broadcast, so that texts aren't shuffled.
BROADCAST_BYTES = 64_000_000
_GEAR = np.random.default_rng(42).integers(0, 1 << 16, 256, dtype=np.uint16)


class Chunks(NamedTuple):
    """Chunk c belongs to a text, begins with a word of it, and has so many words and a digest."""

    text: np.ndarray
    first: np.ndarray
    words: np.ndarray
    digest: np.ndarray


def chunks(texts: list[str | None]) -> Chunks:
    """Cuts texts into chunks of whole words, about five each.

    The gear hash h = 2h + G[byte] of 16 bits depends on the last 16 bytes only, so that it is computed for
    all bytes by doubling. A chunk ends after a word if the hash there has its highest bits zero and the
    word before isn't such a place: cuts depend on nearby text only, and an insertion shifts them but
    doesn't change them further on. There is no cut within the first 16 bytes, and one after every 64
    words without.
    """
    parts = [_chunks(piece, begun) for begun, piece in pieces(texts)]
    return Chunks(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else Chunks(*(np.zeros(0, dtype=np.int64) for _ in range(3)), np.zeros(0, dtype=np.uint64))


def _chunks(texts: list[str | None], begun: int) -> Chunks:
    words = split_words(texts)
    n = len(words.start)
    if not n:
        return Chunks(*(np.zeros(0, dtype=np.int64) for _ in range(3)), np.zeros(0, dtype=np.uint64))
    gear, have = _GEAR[words.data], 1
    while have < LOOK_BACK:
        longer = gear.copy()
        longer[have:] += gear[:-have] << np.uint16(have)
        gear, have = longer, 2 * have
    n_words = np.diff(words.first)
    text = np.repeat(np.arange(len(texts)), n_words)
    nth = np.arange(n) - words.first[:-1][text]
    last = np.concatenate([text[1:] != text[:-1], [True]])
    place = (gear[words.end] >> np.uint16(16 - CUT_BITS)) == 0
    place &= words.end - words.start[words.first[:-1][text]] >= LOOK_BACK
    ends = last | (place & ~np.concatenate([[False], place[:-1]]))
    # the words since the last cut, and a cut after every MOST of them
    index = np.arange(n)
    opened = np.concatenate([[0], np.where(ends[:-1], index[1:], 0)])
    since = index - np.maximum.accumulate(opened) + 1
    ends |= since % MOST == 0
    stop = np.flatnonzero(ends)
    start = np.concatenate([[0], stop[:-1] + 1])
    digest = xxh64(words.data, words.start[start], words.end[stop])
    return Chunks(text[start] + begun, nth[start], stop - start + 1, digest)


def _chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: the words in each of its chunks, the digests of chunks in the order in which each is
    first found in it, the places of those that were found in it before, and where each of these was first found."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            c = chunks(batch["text"].tolist())
            at = np.searchsorted(c.text, np.arange(len(batch)))
            place = np.arange(len(c.text)) - at[c.text]
            order = np.lexsort((place, c.digest, c.text))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (np.diff(c.text[order]) != 0) | (c.digest[order][1:] != c.digest[order][:-1])
            first = np.empty(len(order), dtype=bool)
            first[order] = new
            of = np.empty(len(order), dtype=np.int64)
            of[order] = place[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "tag": batch["tag"],
                    "words": _by_text(c.words.astype(np.int16), c.text, len(batch)),
                    "digests": _by_text(c.digest[first].view(np.int64), c.text[first], len(batch)),
                    "again": _by_text(place[~first].astype(np.int32), c.text[~first], len(batch)),
                    "of": _by_text(of[~first].astype(np.int32), c.text[~first], len(batch)),
                }
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), content_tag(F.col(text_col)).alias("tag"), text_of(F.col(text_col)).alias("text"))
    return rows.mapInPandas(each, "id long, tag long, words array<smallint>, digests array<long>, again array<int>, of array<int>")


def _by_text(values: np.ndarray, text: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(values, np.searchsorted(text, np.arange(1, n))) if n else []


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, tag, first_doc_ids, start_word, end_word, n_words) of each passage that occurred before.

    Chunks with one digest are the same text but for case and white space. The first occurrence is in the
    document with the smallest id (null last), then content tag, then place; consecutive chunks of which
    each occurred before make a passage, which counts from ``least_words`` words on. Where such a run and the
    partial chunks around it may reach EXACT_WORDS, its chunks are extended word by word to both sides against
    the text of their first occurrence (at the ends of a run that counts anyway only the outer chunks are), and
    what then has EXACT_WORDS counts with its exact ends. first_doc_ids are the documents in which its chunks
    are first found, each once. Words are counted from 0, end_word is the one after. Lost is only what has no
    whole chunk, or whose every chunk first stands in some other document.

    A digest leaves a document once, as what repeats within it is known there. Counts and first places are summed up
    before the shuffle, so that a chunk that a third of all documents have is no hot group there.
    Null and empty texts have no chunks; rows that repeat an id and a text are one document and make no
    passage by themselves.
    """
    docs_chunks = cut(_chunked(docs, id_col, text_col))
    places = F.when(F.size("words") > 0, F.array_except(F.sequence(F.lit(0), F.size("words") - 1), F.col("again")))
    rows = docs_chunks.select("id", "tag", F.inline(F.arrays_zip(places.alias("k"), F.col("digests").alias("digest"))).alias("k", "digest"))
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "tag", "k")
    # cut, so that the join has an exchange of its own, which may be split at a chunk that very many documents have
    repeated = cut(rows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = rows.join(repeated, "digest").where(place != F.col("first"))
    marks = later.groupBy("id", "tag").agg(F.sort_array(F.collect_set(F.struct("k", F.col("first.id").alias("first_id"), F.col("first.tag").alias("first_tag"), F.col("first.k").alias("first_k")))).alias("marks"))
    once = docs_chunks.select("id", "tag", "words", "again", "of").dropDuplicates(["id", "tag"])
    joined = once.alias("d").join(marks.alias("m"), F.expr("d.id <=> m.id AND d.tag = m.tag"), "left").select("d.id", "d.tag", "d.words", "d.again", "d.of", "m.marks").where("marks IS NOT NULL OR size(again) > 0")

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, tag, words, again, of, marks in zip(batch["id"], batch["tag"], batch["words"], batch["again"], batch["of"], batch["marks"], strict=True):
                i = None if pd.isna(i) else int(i)
                first = {int(k): (i, tag, int(f)) for k, f in zip(again, of, strict=True)} | {m["k"]: (m["first_id"], m["first_tag"], m["first_k"]) for m in (marks if marks is not None else [])}
                ends = np.cumsum(words, dtype=np.int64)
                k = np.array(sorted(first))
                breaks = np.flatnonzero(np.diff(k) > 1) + 1
                for a, b in zip([0, *breaks], [*breaks, len(k)], strict=True):
                    begin, last = int(k[a]), int(k[b - 1])
                    start, end = int(ends[begin] - words[begin]), int(ends[last])
                    counts = end - start >= least_words
                    before = min(start, int(words[begin - 1]) + UNSETTLED) if begin else 0
                    after = int(words[last + 1]) - 1 if last + 1 < len(words) else 0
                    if counts:
                        asked = {n for n, more in ((begin, before), (last, after)) if more}
                    else:
                        asked = k[a:b].tolist() if before + end - start + after >= EXACT_WORDS else ()
                    seeds = [(n, int(ends[n] - words[n]), int(ends[n]), *first[n]) for n in sorted(asked)]
                    if counts or seeds:
                        froms = list(dict.fromkeys(first[n][0] for n in k[a:b].tolist() if first[n][0] is not None)) if counts else []
                        out.append((i, tag, froms, start, end, counts, seeds))
            yield pd.DataFrame(out, columns=["id", "tag", "froms", "start", "end", "counts", "seeds"]).astype({"id": "Int64"})

    seed = "array<struct<k int, start long, end long, first_id long, first_tag long, first_k int>>"
    found = cut(joined.mapInPandas(runs, f"id long, tag long, froms array<long>, start long, end long, counts boolean, seeds {seed}"))
    whole = found.where("counts").select("id", "tag", "froms", "start", "end")
    spans = whole.unionByName(_extended(docs, found.select("id", "tag", F.inline("seeds")), id_col, text_col))
    return spans.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "end", "froms")).alias("spans")).mapInPandas(
        _merged, "doc_id long, tag long, first_doc_ids array<long>, start_word long, end_word long, n_words long"
    )


def _extended(docs: DataFrame, seeds: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, froms, start, end) of the chunks that have EXACT_WORDS once they are extended to both sides.

    Only 32-bit hashes of the MOST words on both sides of the chunks asked for are sent.
    """
    own = seeds.select("id", "tag", "k")
    asked = own.unionByName(seeds.select(F.col("first_id").alias("id"), F.col("first_tag").alias("tag"), F.col("first_k").alias("k")))
    asked = cut(asked.groupBy("id", "tag").agg(F.sort_array(F.collect_set("k")).alias("ks")).withColumnsRenamed({"id": "asked_id", "tag": "asked_tag"}))
    asked = F.broadcast(asked) if within_bytes(asked, BROADCAST_BYTES) else asked
    texts = docs.select(F.col(id_col).cast("long").alias("id"), content_tag(F.col(text_col)).alias("tag"), text_of(F.col(text_col)).alias("text"))
    texts = texts.join(asked, F.expr("id <=> asked_id AND tag = asked_tag")).select("id", "tag", "text", "ks")

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, tag, text, ks in zip(batch["id"], batch["tag"], batch["text"], batch["ks"], strict=True):
                words, c = split_words([text]), chunks([text])
                hashes = xxh64(words.data, words.start, words.end).astype(np.uint32).view(np.int32)
                start = c.first[ks]
                end = start + c.words[ks]
                left = [hashes[max(0, s - MOST) : s][::-1] for s in start]
                right = [hashes[e : e + MOST] for e in end]
                yield pd.DataFrame({"id": pd.array([i] * len(ks)).astype("Int64"), "tag": tag, "k": ks, "left": left, "right": right})

    windows = cut(texts.mapInPandas(around, "id long, tag long, k int, left array<int>, right array<int>").dropDuplicates(["id", "tag", "k"]))
    both = seeds.alias("s").join(windows.alias("a"), F.expr("s.id <=> a.id AND s.tag = a.tag AND s.k = a.k"))
    both = both.join(windows.alias("b"), F.expr("s.first_id <=> b.id AND s.first_tag = b.tag AND s.first_k = b.k"))

    def same(side: str) -> Column:
        differs = F.array_position(F.zip_with(f"a.{side}", f"b.{side}", lambda x, y: x.eqNullSafe(y)), F.lit(False))
        return F.when(differs == 0, F.size(f"a.{side}")).otherwise(differs - 1)

    start, end = F.col("s.start") - same("left"), F.col("s.end") + same("right")
    froms = F.array_compact(F.array("s.first_id"))
    return both.select("s.id", "s.tag", froms.alias("froms"), start.alias("start"), end.alias("end")).where(F.col("end") - F.col("start") >= EXACT_WORDS)


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One passage for those of a document that overlap."""
    for batch in batches:
        out = []
        for i, tag, spans in zip(batch["id"], batch["tag"], batch["spans"], strict=True):
            done: list[tuple[int, int, list[int]]] = []
            for start, end, froms in sorted((s["start"], s["end"], sorted(s["froms"])) for s in spans):
                if done and start < done[-1][1]:
                    done[-1] = (done[-1][0], max(done[-1][1], end), list(dict.fromkeys([*done[-1][2], *froms])))
                else:
                    done.append((start, end, list(froms)))
            out += [(None if pd.isna(i) else int(i), tag, froms, start, end, end - start) for start, end, froms in done]
        yield pd.DataFrame(out, columns=["doc_id", "tag", "first_doc_ids", "start_word", "end_word", "n_words"]).astype({"doc_id": "Int64"})


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with all columns, and in the text only the first occurrence of each repeated passage.

    What is left of a text that had passages is joined by single spaces where one was taken out. Null and empty texts
    stay as they are; rows that repeat an id and a text are treated alike; an empty table gives no rows.
    """
    id_name, tag, spans = (fresh(docs, n) for n in ("__id", "__tag", "__spans"))
    found = repeated_passages(docs, id_col, text_col, least_words)
    marks = found.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set(F.array("start_word", "end_word"))).alias(spans)).withColumnsRenamed({"doc_id": id_name, "tag": tag + "2"})
    tagged = docs.withColumn(tag, content_tag(F.col(text_col)))
    joined = tagged.join(marks, tagged[id_col].eqNullSafe(marks[id_name]) & (tagged[tag] == marks[tag + "2"]), "left").select(*docs.columns, spans)
    at, cuts = docs.columns.index(text_col), len(docs.columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_without(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(cuts).to_pylist(), strict=True)]
            columns = [pa.array(texts, batch.schema.field(at).type) if n == at else batch.column(n) for n in range(cuts)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:cuts])

    return joined.mapInArrow(each, docs.schema)


def _without(text: str | None, spans: list[list[int]] | None) -> str | None:
    if not spans:
        return text
    raw = text.encode()
    bounds, at = [], 0
    for word in raw.split():
        begin = raw.index(word, at)
        at = begin + len(word)
        bounds.append((begin, at))
    kept, done = [], 0
    for start, end in spans:
        kept.append(raw[done : bounds[start][0]].strip())
        done = bounds[end - 1][1]
    kept.append(raw[done:].strip())
    return b" ".join(k for k in kept if k).decode()
