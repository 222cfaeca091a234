"""Phrases and their counts against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from loomtrail.llm import phrases
from loomtrail.llm.phrases import Index, collocations, pairs_of, threes_of

SCHEMA = "doc_id long, text string, lang string, phrase string, n string, id string, shard string"


def brute(rows, least, most):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])
    out = []
    for lang in n:
        mine = []
        for (of, p), (score, a, left, right) in found.items():
            longer = [b for (o, q), (_, b, _, _) in found.items() if of == o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if of == lang and not any(100 * b >= 50 * a for b in longer):
                mine.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(mine)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def test_an_index_counts_pairs_and_threes():
    r = np.random.default_rng(3)
    for symbols, size in ((2, 1), (4, 50), (9, 400), (40, 3000)):
        text = np.concatenate([[0], r.integers(0, symbols, size), [0]]).astype(np.int32)
        first, second, n, start = pairs_of(Index(text, symbols))
        want = Counter((a, b) for a, b in zip(text.tolist(), text[1:].tolist(), strict=False) if a and b)
        assert dict(zip(zip(first.tolist(), second.tolist(), strict=True), n.tolist(), strict=True)) == want
        kept = np.flatnonzero(n % 3 > 0)
        found = threes_of(Index(text[::-1], symbols), n[kept], start[kept])
        three = {(first[kept[o]], second[kept[o]], c): k for o, c, k in zip(found.of, found.symbol, found.n, strict=True)}
        pairs = {(first[k], second[k]) for k in kept}
        assert three == Counter(t for t in zip(text.tolist(), text[1:].tolist(), text[2:].tolist(), strict=False) if all(t) and t[:2] in pairs)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Über", "éa", "x-1", " ", "\x1c", "\xa0y"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";:", "!", " ?", "\r\x0b"]
    return [(r.choice(["en", "de", None, "und", ""]), "".join(r.choice(words).upper() * (r.random() < 0.9) + r.choice(gaps) for _ in range(r.randrange(80)))) for _ in range(n)]


@pytest.mark.parametrize("bits", [27, 7])
@pytest.mark.parametrize("shard", [phrases.SHARD, 60])
def test_phrases_are_the_brute_force_ones(spark, monkeypatch, shard, bits):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "BITS", bits)
    rows = [*corpus(4, 150), ("en", None), (None, ""), ("fr", ".,;"), *[("en", "same text again, same text")] * 12]
    frame = spark.createDataFrame([(i, text, lang, "x", "y", "z", "s") for i, (lang, text) in enumerate(rows)], SCHEMA).repartition(5)
    for least, most in ((10, 2000), (4, 7)):
        got = collocations(frame, least=least, most=most)
        assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute(rows, least, most)


def test_no_phrases(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, *"xyzs"), (2, "one", "en", *"xyzs"), (3, "a b c d", None, *"xyzs")]
    assert collocations(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_counts_beyond_64_bits(spark):
    rows = [(9_000_000_000_000, 9_000_000_000_001, 9_000_000_000_000), (3_000_000_000_000, 3_000_000_000_000, 9_999_999_999_999)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(phrases._score("a", "l", "r").alias("s")).collect()
    assert [r["s"] for r in got] == [1_000_000 * a * a // (left * right) for a, left, right in rows]


def test_a_long_text_is_cut_at_ends_of_pieces():
    text = "a b. c d" * 50 + "x" * 300 + "\ny z"
    parts = list(phrases.segments(text, 40))
    assert "".join(parts) == text and all(p[-1] in phrases._BREAKS for p in parts[:-1]) and len(parts) > 5
    assert list(phrases.segments("x" * 100, 10)) == ["x" * 100]
