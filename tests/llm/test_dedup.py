"""Exact, near, line and substring deduplication against brute force, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtrail.llm import components, exact_dedup, line_dedup, simhash, substring_dedup, tokens

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, source string, id string, tag string, kept string, __tag string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def frame(spark, rows, schema=SCHEMA):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *["x"] * (width - len(r))) for r in rows], schema)


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "one"), (6, "ünï çødé \x0b x"), (7, "word " * 30000)]


def brute_simhash(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_hash_of_any_length_is_xxh64():
    data = np.frombuffer(bytes(range(256)) * 4, dtype=np.uint8)
    start, end = np.arange(100), np.arange(100) + np.arange(100) * 3
    assert tokens.xxh64(data, start, end).tolist() == [xxhash.xxh64_intdigest(data[i:j].tobytes(), 42) for i, j in zip(start, end, strict=True)]


def test_simhash_is_the_brute_force_one():
    texts = [None, "", "A", "a B c", "a b c d", "a b c d e", "É é\x0bx  y", prose(1, 500), "x" * 4000]
    assert simhash.simhash(texts).tolist() == [brute_simhash(t) for t in texts]


@pytest.mark.parametrize("hot", [8, 0.005])
def test_near_duplicates_are_all_links_within_four_bits(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "CHUNK", 50_000)
    rows = [(i, prose(i, 400)) for i in range(60)]
    for i in range(60, 160):
        words = prose(i % 20, 400).split()
        words[i % 60] = f"changed{i}"
        rows.append((i, " ".join(words)))
    rows += [(200, rows[3][1]), (201, None), (202, "  ")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    prints = {i: brute_simhash(t) for i, t in rows}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    root = {i: i for i in prints}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in prints}
    assert len({r["component_id"] for r in got.values()}) < 140


def test_near_duplicate_edges(spark):
    got = simhash.near_duplicates(frame(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    by_text = {r["doc_id"]: r["component_id"] for r in got}
    assert by_text[1] == by_text[2] == by_text[3] == 1 and by_text[4] == by_text[5] == by_text[None] == 4
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    kept = simhash.drop_near_duplicates(frame(spark, EDGE))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted(set(ids)) and {1, 4} <= set(ids) and 5 not in ids and None not in ids
    assert simhash.drop_near_duplicates(frame(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (300, 299)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 51)}, **{200 + i: 100 for i in range(50)}, 300: 299}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        t = t or ""
        key = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(key, []).append((-len(t), i is None, i or 0, i))
    return {hashlib.sha256(k.encode()).hexdigest(): (min(v)[-1], len(v)) for k, v in groups.items()}


def test_exact_duplicates(spark):
    rows = EDGE + [(20, "a b  c"), (21, "abc"), (22, "ab\tc"), (23, " " * 600 + prose(1, 40)), (24, prose(1, 40)), (25, prose(1, 40).replace(" ", "\n")), (26, prose(2, 40))]
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_exact(rows)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[r["text_sha256"]]
    kept = [r for r in got if r["kept"]]
    assert {r["text_sha256"] for r in kept} == set(want) and {r["doc_id"] for r in kept} == {k for k, _ in want.values()}
    left = exact_dedup.drop_exact_duplicates(frame(spark, rows))
    assert left.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(k for k, _ in want.values())
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    assert exact_dedup.drop_exact_duplicates(frame(spark, [])).count() == 0


def test_a_repeated_row_stays_once(spark):
    rows = [(1, prose(5, 30))] * 4 + [(2, prose(5, 30))]
    assert [r["doc_id"] for r in exact_dedup.drop_exact_duplicates(frame(spark, rows)).collect()] == [1]


def test_lines(spark):
    block = "first line\n  second line\n\nthird line"
    rows = [(1, f"{block}\nown"), (2, f"before\n{block}\nfourth"), (3, "third line\nfirst line"), (4, None), (5, "a\na\na\na\na"), (6, ""), (None, block), (1, f"{block}\nown")]
    got = {(r["doc_id"], r["n_removed"]): r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {
        (1, 0): f"{block}\nown", (2, 3): "before\n\nfourth", (3, 0): "third line\nfirst line", (4, 0): "", (5, 4): "a", (6, 0): "", (None, 3): "",
    }
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_one_document_of_very_many_lines(spark):
    rows = [(1, "\n".join(f"line {i}" for i in range(200_000))), (2, "\n".join(f"line {i}" for i in range(100_000, 300_000)))]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["n_lines"]) == (0, 100_000, 200_000)
    assert got[2]["text"].split("\n") == [f"line {i}" for i in range(200_000, 300_000)]


def test_chunks_cover_texts_and_resist_shifts():
    text = prose(3, 2000)
    c = substring_dedup.chunks([text, None, "", "tiny", "orre " * 1000])
    assert [int(c.words[c.text == t].sum()) for t in range(5)] == [2000, 0, 0, 1, 1000]
    assert (c.first[c.text == 0] == np.cumsum(c.words[c.text == 0]) - c.words[c.text == 0]).all()
    shifted = substring_dedup.chunks(["inserted words here " + text])
    shared = np.isin(shifted.digest, c.digest[c.text == 0])
    assert shared[3:].all() and c.words.max() <= substring_dedup.MOST
    again = substring_dedup.chunks(["other", text])
    assert (again.digest[again.text == 1] == c.digest[c.text == 0]).all()


def test_passages_that_repeat_are_found(spark):
    passage = [prose(1000 + i, 60) for i in range(30)]
    rows = [(i, f"{prose(i, 80)} {passage[i % 30]} {prose(500 + i, 70)}") for i in range(60)] + [(100, None), (101, ""), (102, "short"), (100, None)]
    found = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    pairs = {(i, r["doc_id"]) for r in found for i in r["first_doc_ids"]}
    assert pairs == {(i, i + 30) for i in range(30)}
    for r in found:
        assert 80 - 1 <= r["start_word"] and r["end_word"] <= 141 and r["n_words"] == r["end_word"] - r["start_word"] >= 30
    left = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeated_passages(frame(spark, rows)).collect()}
    assert left[3] == rows[3][1] and left[100] is None
    assert len(left[33].split()) < 185 and set(left[33].split()) <= set(rows[33][1].split())
    assert substring_dedup.repeated_passages(frame(spark, [])).count() == 0


def test_passages_within_a_document_and_without_ids(spark):
    once, twice = prose(20, 80), f"{prose(21, 80)} {prose(22, 30)} {prose(21, 80)}"
    rows = [(1, twice), (None, f"{prose(23, 20)} {once}"), (4, once), (5, "pair of " * 3000), (6, "pair of " * 3000 + "end")]
    found = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["first_doc_ids"], r["n_words"] > 60) for r in found if r["doc_id"] in (1, None)} == {1: ([1], True), None: ([4], True)}
    assert {r["doc_id"] for r in found} == {1, None, 5, 6}
    left = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeated_passages(frame(spark, rows)).collect()}
    assert left[4] == once and len(left[1].split()) < 130


def test_long_and_repeated_rows_make_no_passage_by_themselves(spark):
    rows = [(1, prose(9, 3000))] * 2 + [(2, prose(10, 3000))]
    assert substring_dedup.repeated_passages(frame(spark, rows)).count() == 0
    rows = [(1, prose(9, 300)), (2, prose(9, 300).upper().replace(" ", "\n"))]
    assert substring_dedup.repeated_passages(frame(spark, rows)).agg(F.sum("n_words")).first()[0] >= 295


def test_passages_of_just_over_fifty_words_are_found_to_their_ends(spark):
    passage = [prose(3000 + i, 51) for i in range(400)]
    rows = [(i, f"{prose(i, 40)} start{i} {passage[i % 400]} stop{i} {prose(5000 + i, 40)}") for i in range(800)]
    rows += [(900, f"{prose(900, 90)} {prose(8000, 25)}"), (901, f"{prose(8000, 25)} {prose(901, 90)}")]
    found = {r["doc_id"]: r for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert set(found) == set(range(400, 800))
    assert all(i - 400 in r["first_doc_ids"] for i, r in found.items())
    assert {(r["start_word"], r["end_word"]) for r in found.values()} == {(41, 92)}
