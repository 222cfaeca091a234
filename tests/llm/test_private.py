"""Personal data: the fixed patterns against brute force, votes, and what the method adds."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomtrail.llm import private
from loomtrail.llm.private import personal_data, reliabilities, running

SCHEMA = "doc_id long, text string, found string, spans string, base string, email string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, said):
    digits = [int(d) for d in said if d in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in said.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if n % 2 == 0 else sum(divmod(2 * d, 10)) for n, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_base(text):
    found = [(m.start(), list(PATTERNS).index(kind), f"{kind}:{m.start()}:{m.end()}") for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(kind, m[0])]
    return [s for _, _, s in sorted(found)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *"xyzw") for i, t in rows], SCHEMA)


def odd_texts():
    r = random.Random(2)
    alphabet = list("ab01.. @@+--_%()") + ["é", "𝒳", "\n", "user@mail.example.com", "10.0.0.1", "+1 (555) 010-2030", "4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.08.9.255"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(600)]
    return [None, "", "a@b.c_x@d.ef", "a@b.c@d.e", "x" * 3000 + "@y.z", "𝒳𝒳 a@b.cd", "1-2 3-4 5", "4111-1111-1111-1111 4111111111111112", *texts]


def test_the_base_is_the_brute_force_one(spark):
    rows = list(enumerate(odd_texts())) + [(None, "me@x.org"), (3, "me@x.org"), (3, "me@x.org")]
    got = personal_data(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), hashlib.sha256(",".join(brute_base(t)).encode()).hexdigest(), *(sum(s.startswith(k) for s in brute_base(t)) for k in PATTERNS)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"], *(r[f"n_{k}"] for k in PATTERNS)) for r in got) == want
    texts = dict(rows[:-3])
    for r in got[: len(texts)]:
        spans = r["spans"].split(",") if r["spans"] else []
        assert spans == list(dict.fromkeys(spans)) and set(spans) >= ({f"{s['kind']}:{s['start']}:{s['stop']}" for s in r["found"] if s["base"]})


def test_running_sums(spark):
    for n in (0, 1, 63, 64, 65, 129, 1000):
        values = [(i * 7) % 11 for i in range(n)]
        got = spark.createDataFrame([(values,)], "v array<int>").select(running(F.col("v")).alias("s")).first()["s"]
        assert got == [sum(values[: i + 1]) for i in range(n)]


def test_long_texts_of_any_kind(spark):
    pieces = ["1", "a.", "a@b", "1.2.3.", "+1 ", "me@x.org 10.1.2.3 ", "(", "A1"]
    # brute force takes the square of the length, so that it has short ones
    short, long = [(i, p * (1500 // len(p))) for i, p in enumerate(pieces)], [(i, p * (300_000 // len(p))) for i, p in enumerate(pieces)]
    got = {r["doc_id"]: r["base_sha256"] for r in personal_data(frame(spark, short)).collect()}
    assert got == {i: hashlib.sha256(",".join(brute_base(t)).encode()).hexdigest() for i, t in short}
    began = time.perf_counter()
    found = {r["doc_id"]: r for r in personal_data(frame(spark, long).repartition(8)).collect()}
    assert time.perf_counter() - began < 90 and len(found) == len(pieces)
    n = 300_000 // len(pieces[5])
    assert (found[5]["n_email"], found[5]["n_ip"]) == (n, n) and found[0]["n_card"] == 0 and found[3]["n_ip"] == 150_000 // 4


def test_no_rows_and_no_candidates(spark):
    assert personal_data(frame(spark, [])).count() == 0
    got = personal_data(frame(spark, [(1, None), (2, "just words."), (3, "")])).collect()
    assert all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() and not r["found"] for r in got)


def brute_reliabilities(items, rounds):
    """The same over single items, with nothing counted together."""
    width, kinds = len(items[0][1]), {k for k, _ in items}
    shares = [[{"+": 0.15, "0": 0.25, "-": 0.6}, {"+": 0.6, "0": 0.25, "-": 0.15}] for _ in range(width)]
    prior = dict.fromkeys(kinds, 0.5)
    for _ in range(rounds):
        likely = []
        for kind, said in items:
            yes, no = prior[kind], 1 - prior[kind]
            for k, v in enumerate(said):
                yes, no = yes * shares[k][1][v], no * shares[k][0][v]
            likely.append(yes / (yes + no))
        for kind in kinds:
            own = [p for p, (k, _) in zip(likely, items, strict=True) if k == kind]
            prior[kind] = (1 + sum(own)) / (2 + len(own))
        for k in range(width):
            for true in (0, 1):
                counts = {v: 1 + sum(p if true else 1 - p for p, (_, said) in zip(likely, items, strict=True) if said[k] == v) for v in "+0-"}
                shares[k][true] = {v: c / sum(counts.values()) for v, c in counts.items()}
    return dict(zip(items, likely, strict=True)), shares


def test_reliabilities_are_those_over_single_items():
    r = random.Random(4)
    items = []
    for _ in range(400):
        true = r.random() < 0.4
        items.append((r.randrange(2), "".join("0" if r.random() < 0.2 else "+-"[(r.random() < trust) != true] for trust in (0.95, 0.8, 0.7, 0.6, 0.5))))
    likely, shares = reliabilities([(k, s, items.count((k, s))) for k, s in set(items)], 15)
    want, want_shares = brute_reliabilities(items, 15)
    assert all(math.isclose(likely[i], want[i], abs_tol=1e-9) for i in set(items))
    assert all(math.isclose(shares[k][t][v], want_shares[k][t][v], abs_tol=1e-9) for k in range(5) for t in (0, 1) for v in "+0-")
    # the more reliable a labeler is, the further apart are its votes
    apart = [s[1]["+"] - s[0]["+"] for s in shares]
    assert apart[0] > apart[1] > apart[3] > apart[4] - 0.1
    assert reliabilities([]) == ({}, [])


def test_the_method_adds_disguised_data_and_leaves_clean_texts_alone(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice(["er", "in", "tho", "an", "re", "st"]) for _ in range(r.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    card = lambda: next(c for c in iter(lambda: "4" + "".join(r.choice("0123456789") for _ in range(15)), "") if holds("card", c))
    rows, want = [], {}
    for i in range(300):
        plain = r.choice([lambda: f"call +1 (555) 010-{r.randrange(1000, 9999)}", lambda: f"mail {word()}.{r.randrange(99)}@mail.example.com", lambda: f"card {card()}", lambda: f"server 10.{r.randrange(256)}.7.{r.randrange(1, 256)}", lambda: f"order {r.randrange(10**12, 10**13)}"])()
        rows.append((i, f"{prose(30)} {plain} {prose(20)}"))
    hidden = [("email", "jane [at] mail (dot) example (dot) com"), ("phone", "(555) 010-2039"), ("secret", "password=7602ad27cf5550de1c"), ("ssn", "512-44-1987"), ("name", "Mrs. Winterbottom"), ("iban", "DE44 5001 0517 5407 3249 31")]
    for n, (kind, said) in enumerate(hidden * 5):
        before = prose(20)
        rows.append((1000 + n, f"{before} contact {said} {prose(20)}"))
        want[1000 + n] = f"{kind}:{len(before) + 9}:{len(before) + 9 + len(said)}"
    clean = [f"{prose(50)}. Chapter 12, page 1999, total 12.50 and version 1.2.3 of {prose(5)}." for _ in range(200)]
    rows += [(5000 + i, t) for i, t in enumerate(clean)]
    got = {x["doc_id"]: x["spans"] for x in personal_data(frame(spark, rows)).collect()}
    assert all(span in got[i].split(",") for i, span in want.items()), [(i, s, got[i]) for i, s in want.items() if s not in got[i].split(",")]
    assert all(got[5000 + i] == "" for i in range(len(clean)))


def test_native(spark):
    """No Python worker has a part in it."""
    plan = personal_data(frame(spark, [(1, "a@b.cd")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "pandas" not in open(private.__file__).read()
