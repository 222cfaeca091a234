"""Scoring texts with a hashed maximum-entropy language model.

P(word | history) = P(class | history) * P(member | class, history) * P(word | class, member). Two softmaxes
over hashed features of the words before: the last word, skips to the second and third last, and an n-gram of
word endings; the member is predicted from the class with the last word, the skip to the second last and the endings. A word
belongs to a class by its ending and to a member of it by its hash, so that every word of any text has both. Within a member, about a thousandth of all
words, a word has its smoothed share of the training tokens.

The model is trained in two synchronous steps over all training documents. Gradients are taken in Spark: tasks sum them by
row of the weight table in whole numbers, Spark adds those up, and the driver takes the step for the whole table, which
has a fixed size. In the first step all outcomes are equally likely. Sums of whole numbers are the same however rows are
partitioned.

Counts of words grow with the corpus and stay in Spark: batches of documents send each distinct word once, counts are
summed by word, and joined back to the batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, text_of
from .tokens import pieces, split_words, xxh64

#: Classes (the last one is the end of a text), members of each, rows of the class table and of each class's member table.
CLASSES, MEMBERS, ROWS, MEMBER_ROWS = 32, 32, 1 << 14, 1 << 10
#: Tokens whose features are looked up at once; tokens of a row whose gradients are summed in 32 bits at most.
BATCH, SUMMED = 1 << 11, (1 << 18) - 1
#: Of the first step: how much of a feature's log ratio its weight takes. Counts added to every row, size of later steps.
TRUST, SMOOTH, RATE = 0.5, 50.0, 0.4
#: Whole-number units of a probability in the sums of gradients; characters of a batch of documents.
UNITS, BATCH_CHARS = 1 << 13, 8_000_000
_END = CLASSES - 1
_TABLE = ROWS + _END * MEMBER_ROWS
#: For each row of the table the first one of its part, which all tokens predicted there share.
_SHARED = np.concatenate([np.zeros(ROWS, dtype=np.int64), ROWS + np.arange(_TABLE - ROWS) // MEMBER_ROWS * MEMBER_ROWS])
#: Cells (class and member); the end of a text has its own.
_CELLS = _END * MEMBERS + 1


@dataclass
class Tokens:
    """The tokens of some texts, each text closed by an end token: hash, class, member, text, and the rows of the weight
    table that predict its class and its member (the first is the one that all have)."""

    word: np.ndarray
    kind: np.ndarray
    member: np.ndarray
    text: np.ndarray
    kind_rows: np.ndarray
    member_rows: np.ndarray

    @property
    def cell(self) -> np.ndarray:
        return self.kind * MEMBERS + self.member


def _remainder(values: np.ndarray, by: int) -> np.ndarray:
    """Of numbers below 2**32, from the quotient, which numpy takes of many at once."""
    values = values.astype(np.uint32)
    return values - values // np.uint32(by) * np.uint32(by)


def tokens(texts: list[str | None]) -> Tokens:
    words = split_words(texts)
    n = np.diff(words.first) + 1
    text = np.repeat(np.arange(len(texts)), n)
    ends = np.cumsum(n) - 1
    is_word = np.ones(len(text), dtype=bool)
    is_word[ends] = False
    word, ending = np.zeros(len(text), dtype=np.uint64), np.zeros(len(text), dtype=np.uint64)
    word[is_word] = xxh64(words.data, words.start, words.end)
    ending[is_word] = words.data[words.end - 1].astype(np.uint64) * np.uint64(256) + words.data[words.end - 2]
    with np.errstate(over="ignore"):
        mixed = (ending * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        kind = _remainder(mixed, _END).astype(np.int64)
        kind[ends] = _END
        member = _remainder((word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(35), MEMBERS).astype(np.int64)
        member[ends] = 0
        before = [np.full(len(text), back, dtype=np.uint64) for back in range(4)]
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        for back in (1, 2, 3):
            before[back][back:] = np.where(nth[back:] >= back, word[:-back], np.uint64(back))
        tail1, tail2 = np.full_like(word, 1), np.full_like(word, 2)
        tail1[1:] = np.where(nth[1:] >= 1, mixed[:-1], np.uint64(1))
        tail2[2:] = np.where(nth[2:] >= 2, mixed[:-2], np.uint64(2))
        context = (before[1], before[2] + np.uint64(2), before[3] + np.uint64(3), tail1 * np.uint64(31) + tail2 + np.uint64(4))
        hashed = [(c * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32) for c in context]
    kind_rows = np.zeros((1 + len(hashed), len(text)), dtype=np.uint16)
    # of the last word, the second last and the endings
    member_hashed = (hashed[0], hashed[1], hashed[-1])
    member_rows = np.zeros((1 + len(member_hashed), len(text)), dtype=np.uint16)
    first = ROWS + kind * MEMBER_ROWS
    first[ends] = 0
    member_rows[0] = first
    for f, h in enumerate(hashed, 1):
        kind_rows[f] = 1 + _remainder(h, ROWS - 1)
    for f, h in enumerate(member_hashed, 1):
        member_rows[f] = first + 1 + _remainder(h, MEMBER_ROWS - 1)
    return Tokens(word, kind, member, text, kind_rows, member_rows)


def _exponents(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every outcome and token the exponent of its logit above the token's largest, and for every token the sum of those;
    kept by outcome, so that sums and largest values are taken of long rows."""
    # rows are below the table's length, so that nothing is clipped
    logits, one = np.empty((2, rows.shape[1], CLASSES), dtype=weights.dtype)
    np.take(weights, rows[0], axis=0, out=logits, mode="clip")
    for f in rows[1:]:
        logits += np.take(weights, f, axis=0, out=one, mode="clip")
    logits = np.ascontiguousarray(logits.T)
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    parts = logits[:8] + logits[8:16]
    for at in range(16, CLASSES, 8):
        parts += logits[at : at + 8]
    while len(parts) > 1:
        parts = parts[::2] + parts[1::2]
    return logits, parts[0]


def _probabilities(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The probability of every outcome for every token."""
    exponents, total = _exponents(weights, rows)
    exponents /= total
    return exponents.T


def _log_right(weights: np.ndarray, rows: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The log10 probability of every token's own outcome, with what is read for its second row lying together."""
    out = np.empty(len(right))
    order = np.argsort(rows[1], kind="stable")
    rows, right = np.take(rows, order, axis=1), right[order]
    for at in range(0, len(right), BATCH):
        exponents, total = _exponents(weights, rows[:, at : at + BATCH])
        own = exponents.reshape(-1)[right[at : at + BATCH] * len(total) + np.arange(len(total))] / total
        out[order[at : at + BATCH]] = np.log10(np.maximum(own.astype(np.float64), 1e-30))
    return out


class Gradient:
    """Sums over tokens for each row of the table: predicted minus observed probabilities, and how many tokens used it."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.zero = weights, not weights.any()
        self.sums = np.zeros((_TABLE, CLASSES), dtype=np.int64)
        self.seen = np.zeros(_TABLE, dtype=np.int64)
        self.right = np.zeros((_TABLE, CLASSES) if self.zero else 0, dtype=np.int64)
        # two sums in one number, and how many tokens one of them has at most
        self.packed, self.most = np.zeros((CLASSES // 2, 0 if self.zero else _TABLE), dtype=np.int64), 0

    def add(self, t: Tokens) -> None:
        word = np.flatnonzero(t.kind != _END)
        for rows, right in ((t.kind_rows, t.kind), (t.member_rows[:, word], t.member[word])):
            for at in range(0, len(right), SUMMED * (8 if self.zero else 1)):
                if self.zero:
                    self._add_even(rows[:, at : at + 8 * SUMMED], right[at : at + 8 * SUMMED])
                else:
                    self._add(rows[:, at : at + SUMMED], right[at : at + SUMMED])
        if self.zero:
            self.seen = self.right.sum(axis=1)
            self.sums = (UNITS // CLASSES) * self.seen[:, None] - UNITS * self.right
        else:
            self._unpack()

    def _add_even(self, rows: np.ndarray, right: np.ndarray) -> None:
        """The same at zero weights, where every outcome has the same probability: how often each was right is counted first."""
        at = rows.astype(np.int64) * CLASSES + right
        self.right += np.bincount(at.ravel(), minlength=_TABLE * CLASSES).reshape(_TABLE, CLASSES)

    def _add(self, rows: np.ndarray, right: np.ndarray) -> None:
        # tokens by the second of their rows, and so by the first, which is the table's or the class's own
        order = np.argsort(rows[1], kind="stable")
        rows, right = np.take(rows, order, axis=1), right[order]
        # so few units of probability fit 32 bits, so that two sums are taken at once as one of 64
        pairs = np.empty((CLASSES // 2, len(right)), dtype=np.int64)
        for at in range(0, len(right), BATCH):
            s = slice(at, at + BATCH)
            wrong = _probabilities(self.weights, rows[:, s]).T
            wrong *= UNITS
            wrong = np.rint(wrong, out=wrong).astype(np.int32)
            wrong.reshape(-1)[right[s] * wrong.shape[1] + np.arange(wrong.shape[1])] -= UNITS
            pairs[:, s] = (wrong[1::2].astype(np.int64) << 32) + wrong[0::2]
        dealt, upto = np.empty(len(right), dtype=np.int64), np.zeros(len(right) + 1, dtype=np.int64)
        for own in (rows[:2], *rows[2:, None]):
            order = np.argsort(own[0], kind="stable") if len(own) == 1 else None
            # of each part of the table the first row, and how many tokens the rows from there have
            parts = [(int(f.min()), np.bincount(f - f.min())) for f in own]
            # no row is in two parts
            most = max(int(n.max()) for _, n in parts)
            if self.most + most > SUMMED:
                self._unpack()
            self.most += most
            for first, n in parts:
                self.seen[first : first + len(n)] += n
            ends = [(first, np.cumsum(n)) for first, n in parts]
            for one, sums in zip(pairs, self.packed, strict=True):
                np.cumsum(one if order is None else np.take(one, order, out=dealt, mode="clip"), out=upto[1:])
                # differences of running sums, which are right even where those pass 64 bits
                for first, end in ends:
                    until = np.take(upto, end)
                    sums[first : first + len(end)] += until
                    sums[first + 1 : first + len(end)] -= until[:-1]

    def _unpack(self) -> None:
        """Adds what is packed to the sums."""
        low = self.packed.astype(np.int32).astype(np.int64)
        self.sums[:, 0::2] += low.T
        self.sums[:, 1::2] += ((self.packed - low) >> 32).T
        self.packed[:], self.most = 0, 0

    def rows(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.seen)
        values = pa.array(self.sums[used].ravel())
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * CLASSES), values)
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(self.seen[used]), sums], names=["row", "seen", "sums"])


def first_step(sums: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Weights from the gradient at zero weights, where every outcome is equally likely. The row that all tokens of a
    table share gets the log shares of outcomes, every other one a part of its smoothed log ratio to those."""
    counts = seen[:, None] / CLASSES - sums / UNITS
    share = (counts + 0.1) / (seen[:, None] + 0.1 * CLASSES)
    expected = share[_SHARED]
    weights = TRUST * (np.log(np.maximum(counts, 0) + SMOOTH * expected) - np.log(seen[:, None] + SMOOTH) - np.log(expected))
    own = np.unique(_SHARED)
    weights[own] = np.log(share[own])
    return weights.astype(np.float32)


def later_step(weights: np.ndarray, sums: np.ndarray, seen: np.ndarray, share: np.ndarray) -> np.ndarray:
    """A gradient step, each weight by its row's tokens and its outcome's spread; ``share`` has the outcomes' shares."""
    return (weights - RATE * (sums / UNITS) / (seen[:, None] * share * (1 - share) + SMOOTH)).astype(np.float32)


@dataclass
class Model:
    """The weight table, and how many tokens and texts it was trained on."""

    weights: np.ndarray
    n_tokens: int
    n_texts: int


def _summed(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient over ``rows`` (text): sums of tasks are added up by row of the table, of which there is a fixed number."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient = Gradient(shared.value)
        for batch in batches:
            for _, piece in pieces(batch.column(0).to_pylist()):
                gradient.add(tokens(piece))
        yield gradient.rows()

    parts = rows.mapInArrow(each, "row int, seen long, sums array<long>")
    total = parts.groupBy("row").agg(F.sum("seen").alias("seen"), F.array(*[F.sum(F.get("sums", F.lit(c))) for c in range(CLASSES)]).alias("sums")).toArrow()
    sums, seen = np.zeros((_TABLE, CLASSES), dtype=np.int64), np.zeros(_TABLE, dtype=np.int64)
    row = total["row"].to_numpy()
    seen[row] = total["seen"].to_numpy()
    sums[row] = np.concatenate([np.zeros(0, dtype=np.int64), *(c.flatten().to_numpy() for c in total["sums"].chunks)]).reshape(-1, CLASSES)
    return sums, seen


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> Model:
    """Learns from all documents of which crc32 of the id modulo ``folds`` isn't 1.

    Null and empty texts have an end token only. Without training rows all outcomes are equally likely.
    """
    rows = docs.where(~held_out(F.col(id_col), folds)).select(text_of(F.col(text_col)).alias("text"))
    sums, seen = _summed(rows, np.zeros((_TABLE, CLASSES), dtype=np.float32))
    weights = first_step(sums, seen)
    n_tokens, n_texts = int(seen[0]), int(seen[0] - seen[ROWS::MEMBER_ROWS].sum())
    # the row that all tokens of a table share tells how often an outcome is seen
    shares = np.exp(weights[_SHARED])
    weights = later_step(weights, *_summed(rows, weights), shares)
    return Model(weights, n_tokens, n_texts)


_DOCUMENT = np.dtype([("id", "<i8"), ("null", "?"), ("out", "?"), ("n_tokens", "<i8"), ("predicted", "<f8")])
_BATCH = "batch long, words array<long>, trained array<int>, cells array<smallint>, documents binary, spread binary, text binary, count binary"


def _pack(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpack(packed: bytes, kind: np.dtype | type) -> np.ndarray:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True) if packed else b""
    return np.frombuffer(raw, dtype=kind)


def predictions(weights: np.ndarray, t: Tokens) -> np.ndarray:
    """The log10 probability of every token's class and member."""
    word = np.flatnonzero(t.kind != _END)
    out = _log_right(weights, t.kind_rows, t.kind)
    out[word] += _log_right(weights, t.member_rows[:, word], t.member[word])
    return out


def _batch_row(number: int, texts: list[str | None], documents: np.ndarray, weights: np.ndarray) -> tuple:
    """What a batch of documents knows: its distinct words, how often each occurs in its training documents, their
    cells, its documents, and which document has which word how often."""
    parts = []
    for at, small in pieces(texts):
        t = tokens(small)
        documents["predicted"] += np.bincount(t.text + at, weights=predictions(weights, t), minlength=len(texts))
        documents["n_tokens"] += np.bincount(t.text + at, minlength=len(texts))
        real = t.kind != _END
        parts.append((t.word[real], t.cell[real].astype(np.int16), t.text[real] + at))
    word, cell, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    word, inverse = np.unique(word, return_inverse=True)
    cells = np.empty(len(word), dtype=np.int16)
    cells[inverse] = cell
    pair, count = np.unique(inverse * len(texts) + text, return_counts=True)
    of, text = pair // len(texts), pair % len(texts)
    trained = np.bincount(of, weights=count * ~documents["out"][text], minlength=len(word)).astype(np.int32)
    spread = np.bincount(of, minlength=len(word)).astype(np.uint32)
    return (number, word.view(np.int64), trained, cells, _pack(documents), _pack(spread), _pack(text.astype(np.uint32)), _pack(count.astype(np.uint32)))


def _finish(n_tokens: int, n_texts: int, log_cell: np.ndarray, log_base: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    log_end = math.log10(n_texts + 0.5)
    for batch in batches:
        for own in batch.itertuples(index=False):
            docs, text, count = _unpack(own.documents, _DOCUMENT), _unpack(own.text, np.uint32), _unpack(own.count, np.uint32)
            spread, trained = _unpack(own.spread, np.uint32), np.zeros(len(own.cells), dtype=np.int64)
            if own.k is not None:
                trained[own.k] = own.n
            logs = np.log10(trained + 0.5)

            def over_words(values: np.ndarray, text=text, count=count, spread=spread, n=len(docs)) -> np.ndarray:
                return np.bincount(text, weights=count * np.repeat(values, spread), minlength=n)

            yield pd.DataFrame(
                {
                    "doc_id": pd.Series(docs["id"]).astype("Int64").mask(docs["null"]),
                    "held_out": docs["out"],
                    "n_tokens": docs["n_tokens"],
                    "n_known": (over_words(trained > 0) + (n_texts > 0)).astype(np.int64),
                    "train_tokens": n_tokens,
                    "base_score": over_words(logs) + log_end - docs["n_tokens"] * log_base,
                    "score": over_words(logs - log_cell[own.cells]) + log_end - log_cell[-1] + docs["predicted"],
                }
            )


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of the whole text with its end token. Null and empty texts have that
    token only. Rows that repeat an id or a text are scored each, and count each in training if they are not
    held out. Without training rows all counts are 0 and outcomes are equally likely. An empty table gives no rows.

    A batch sends each of its words once, so that a word that every document has is one row a batch. Counts are summed
    before the shuffle; the join back may be split by adaptive execution.
    """
    model = train(docs, id_col, text_col, folds)
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for begun, texts in pieces(batch["text"].tolist(), BATCH_CHARS):
                own = batch.iloc[begun : begun + len(texts)]
                documents = np.zeros(len(texts), dtype=_DOCUMENT)
                documents["null"], documents["id"], documents["out"] = own["id"].isna(), own["id"].fillna(0), own["held_out"]
                yield pd.DataFrame([_batch_row(number, texts, documents, weights.value)], columns=[c.split()[0] for c in _BATCH.split(", ")])
                number += 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col), folds).alias("held_out"), text_of(F.col(text_col)).alias("text"))
    batches = cut(rows.mapInPandas(each, _BATCH))
    sent = batches.select("batch", F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.col("trained").alias("n"), F.col("cells").alias("cell"))).alias("k", "x"))
    sent = sent.select("batch", "k", "x.word", "x.n", "x.cell")
    # cut, so that the join has an exchange of its own, which may be split at a word that very many batches have
    counts = cut(sent.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"), F.min("cell").alias("cell")))
    # a row for each cell, however many words there are
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    size, types = np.zeros(_CELLS), np.zeros(_CELLS)
    for r in cells:
        size[r["cell"]], types[r["cell"]] = r["n"], r["types"]
    size[-1], types[-1] = model.n_texts, model.n_texts > 0
    log_cell = np.log10(size + 0.5 * (types + 1))
    log_base = math.log10(model.n_tokens + 0.5 * (types.sum() + 1))
    back = sent.select("batch", "k", "word").join(counts.select("word", "n"), "word").groupBy("batch").agg(F.collect_list(F.struct("k", "n")).alias("counts"))
    back = back.select(F.col("batch").alias("to"), F.col("counts.k").alias("k"), F.col("counts.n").alias("n"))
    joined = batches.drop("words", "trained").join(back, F.col("batch") == F.col("to"), "left").drop("batch", "to")
    return joined.mapInPandas(
        partial(_finish, model.n_tokens, model.n_texts, log_cell, log_base), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
