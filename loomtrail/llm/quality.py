"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded, a gated attention network that only ever sees
document labels weighs the passages, and the weighted representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held_out, text_of
from .tokens import _IS_SPACE, pieces

#: Words of a passage, hashed byte pairs, size of the encoding and of the attention network.
PASSAGE, PAIRS, ENCODED, ATTENTION = 50, 64, 24, 12
#: Labelled documents that the classifier is fitted on at most, their passages at most (130 MB), passes over them.
SAMPLE, SAMPLE_PASSAGES, EPOCHS = 4_000, 400_000, 40

_KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \n", b".", b",;:", b"!?", b"#$%&*@^~", b"|<>{}[]\\/_=+", b"'\"()-`")
_KIND = np.full(256, len(_KINDS) + 1, dtype=np.int64)
_KIND[:128] = len(_KINDS)
for _n, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes)] = _n
_N_KINDS = len(_KINDS) + 2
_PAIR = (np.arange(1 << 16) * 40503 >> 5) % PAIRS
WIDTH = _N_KINDS + PAIRS + 4


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many each text has. A text without words is one passage of zeros."""
    rows, counts = [], []
    for _, piece in pieces(texts):
        x, n = _passages(piece)
        rows.append(x)
        counts.append(n)
    return (np.concatenate(rows), np.concatenate(counts)) if rows else (np.zeros((0, WIDTH), np.float32), np.zeros(0, int))


def _passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    # how words are spaced and broken into lines says nothing of quality
    raw = [b" ".join((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n" + bytes(8), dtype=np.uint8)
    size = len(data) - 8
    space = _IS_SPACE[data[:size]]
    start = np.flatnonzero(~space[1:] & space[:-1]) + 1
    end = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(start, begins)
    n_words = np.diff(first)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(n_passages) - n_passages
    text = np.repeat(np.arange(len(raw)), n_words)
    of_word = base[text] + (np.arange(len(start)) - first[:-1][text]) // PASSAGE
    total = int(n_passages.sum())
    x = np.zeros((total, WIDTH), dtype=np.float32)
    if not len(start):
        return x, n_passages
    opens = np.flatnonzero(np.diff(of_word, prepend=-1))
    at = start[opens]
    of_byte = np.repeat(of_word[opens], np.diff(np.append(at, size)))
    body = data[at[0] : size]
    n_bytes = np.bincount(of_byte, minlength=total).clip(1)[:, None]
    x[:, :_N_KINDS] = np.bincount(of_byte * _N_KINDS + _KIND[body], minlength=total * _N_KINDS).reshape(total, -1) / n_bytes
    lower = np.frombuffer(data.tobytes().lower().replace(b"\n", b" "), dtype=np.uint8)[at[0] : size + 1].astype(np.int64)
    pair = _PAIR[lower[:-1] * 256 + lower[1:]]
    x[:, _N_KINDS : _N_KINDS + PAIRS] = np.bincount(of_byte * PAIRS + pair, minlength=total * PAIRS).reshape(total, -1) / n_bytes
    # a word's first eight bytes and length stand for it
    length = end - start
    eight = np.ndarray(size, dtype="<u8", buffer=data.data, strides=(1,))[start]
    short = np.minimum(length, 8).astype(np.uint64) * np.uint64(8)
    mask = np.where(short == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (short % np.uint64(64))) - np.uint64(1))
    with np.errstate(over="ignore"):
        word = (eight & mask) * np.uint64(0x9E3779B97F4A7C15) + length.astype(np.uint64)
        mixed = (word >> np.uint64(20)) ^ (of_word.astype(np.uint64) << np.uint64(44))
    in_passage = np.bincount(of_word, minlength=total).clip(1)
    distinct = np.unique(mixed) >> np.uint64(44)
    again = np.concatenate([[False], (word[1:] == word[:-1]) & (of_word[1:] == of_word[:-1])])
    x[:, -4] = np.bincount((distinct % np.uint64(1 << 20)).astype(np.int64), minlength=total)[:total] / in_passage
    x[:, -3] = np.bincount(of_word[again], minlength=total) / in_passage
    x[:, -2] = np.log1p(np.bincount(of_word, weights=length, minlength=total) / in_passage)
    x[:, -1] = in_passage / PASSAGE
    return x, n_passages


@dataclass
class Model:
    """Weights of the encoder (w, c), the attention (v, u, a) and the output (b, bias), for scaled features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), float(self.mean[0]))
        x, counts = passages(texts)
        return _forward(self.weights, (x - self.mean) / self.scale, counts)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    if not len(counts):
        return {"p": np.zeros(0)}
    at, bag = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    e = np.tanh(x @ w["w"] + w["c"])
    t, g = np.tanh(e @ w["v"]), _sigmoid(e @ w["u"])
    s = (t * g) @ w["a"]
    s = np.exp(s - np.maximum.reduceat(s, at)[bag])
    share = s / np.add.reduceat(s, at)[bag]
    z = np.add.reduceat(share[:, None] * e, at)
    return {"at": at, "bag": bag, "e": e, "t": t, "g": g, "share": share, "z": z, "p": _sigmoid(z @ w["b"] + w["bias"])}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, counts)
    wrong = (f["p"] - y) / len(y)
    dz = wrong[:, None] * w["b"]
    dz_of = dz[f["bag"]]
    pull = (f["e"] * dz_of).sum(axis=1)
    ds = f["share"] * (pull - np.add.reduceat(f["share"] * pull, f["at"])[f["bag"]])
    dh = ds[:, None] * w["a"]
    dt, dg = dh * f["g"] * (1 - f["t"] ** 2), dh * f["t"] * f["g"] * (1 - f["g"])
    de = f["share"][:, None] * dz_of + dt @ w["v"].T + dg @ w["u"].T
    dx = de * (1 - f["e"] ** 2)
    return {"w": x.T @ dx, "c": dx.sum(axis=0), "v": f["e"].T @ dt, "u": f["e"].T @ dg, "a": (f["t"] * f["g"]).T @ ds, "b": f["z"].T @ wrong, "bias": wrong.sum()}


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 42) -> Model:
    """Adam over batches of 64 bags. With labels of one kind (or none) the score is that label (or 0.5)."""
    if not len(y) or y.min() == y.max():
        return Model(np.array([float(y[0]) if len(y) else 0.5]), np.ones(1), {})
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"w": init(WIDTH, ENCODED), "c": np.zeros(ENCODED), "v": init(ENCODED, ATTENTION), "u": init(ENCODED, ATTENTION), "a": init(ATTENTION), "b": init(ENCODED), "bias": np.zeros(())}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    at = np.cumsum(counts) - counts
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(y))
        for begin in range(0, len(y), 64):
            chosen = order[begin : begin + 64]
            rows = np.concatenate([np.arange(at[i], at[i] + counts[i]) for i in chosen])
            step += 1
            for k, g in _gradients(w, x[rows], counts[chosen], y[chosen]).items():
                g = g + 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents that are not held out, first in the order of a hash.

    Of those, documents with over a hundredth of SAMPLE_PASSAGES (200,000 words) are passed over, and the others are
    taken until their passages are SAMPLE_PASSAGES. Rows of ``labels`` that share an id count by their mean; null
    ids and labels are left out. The features of the sample's passages are made on the executors and bounded there; only
    then they reach the driver. Where several rows share a chosen id, the text with the smallest content tag stands
    for it.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.where(~held_out(F.col("id"), 3)).groupBy("id").agg(F.avg("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(F.col(text_col)).alias("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, counts = passages(batch["text"].tolist())
            parts = np.split(x, np.cumsum(counts)[:-1]) if len(counts) else []
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "n": counts, "x": [p.tobytes() for p in parts]})

    labelled = texts.join(F.broadcast(chosen), "id")
    # reduced in each task before the shuffle, so that an id with very many rows is no hot group
    one = labelled.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("tag"), "text", "y")).alias("first"))
    encoded = cut(one.select("id", "first.y", "first.text").mapInPandas(encode, "id long, y double, n long, x binary"))
    # one row for each document of the sample
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id"))
    taken = encoded.where(F.col("n") <= SAMPLE_PASSAGES // 100).select("id", so_far.alias("so_far")).where(F.col("so_far") <= SAMPLE_PASSAGES)
    bags = encoded.join(F.broadcast(taken.select("id")), "id", "left_semi").toPandas()
    bags = bags.sort_values("id", kind="stable")
    x = [np.frombuffer(b, dtype=np.float32).reshape(-1, WIDTH) for b in bags["x"]]
    return fit(np.concatenate(x) if x else np.zeros((0, WIDTH), np.float32), np.array([len(b) for b in x], dtype=int), (bags["y"].to_numpy() >= 0.5).astype(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Every passage of the whole text takes part; null and empty texts are one empty passage. Only the text
    enters the score. The model is a few kilobytes and goes with the task.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = model.score(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": p, "predicted": (p >= 0.5).astype(int)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), 3).alias("held_out"), text_of(F.col(text_col)).alias("text"))
    return rows.mapInPandas(each, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns.

    Null and empty texts are scored as one empty passage; rows that repeat a text stay or go together.
    """
    position = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(position).to_pylist()) >= threshold))

    return docs.mapInArrow(each, docs.schema)
