"""Repair of conversations against a search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from loomtrail.llm import conversations
from loomtrail.llm.conversations import Edits, Repair, damaged, repaired

SPACE = " \t\n\x0b\x0c\r"
FORM = re.compile(r"(s?(ua)+)?")


def brute_repair(rows):
    """Every edit string that isn't longer than the cheapest needs, tried out."""
    seen, marks = set(), []
    for _, role, text in rows:
        core = text.strip(SPACE)
        marks.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None

    def walk(n, cost, audit, out):
        nonlocal best
        if best and (cost, audit) >= best[:2] and cost >= best[0]:
            return
        if n == len(rows) and FORM.fullmatch("".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
        if cost > 4 * len(rows):
            return
        for role in ("user", "assistant"):
            walk(n, cost + 3, audit + "I", [*out, (role, "")])
        if n == len(rows):
            return
        _, role, text = rows[n]
        walk(n + 1, cost + 4, audit + "D", out)
        if marks[n] not in ("blank", "duplicate"):
            more = 3 if marks[n] == "truncated" else 0
            if role:
                walk(n + 1, cost + more, audit + "K", [*out, (role, text)])
            for other in ("user", "assistant"):
                walk(n + 1, cost + 3 + more, audit + "R", [*out, (other, text)])

    walk(0, 0, "", [])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def plain_repair(rows):
    """The same with whole strings for each state, which does long conversations too."""
    states = {0: (0, "", ())}
    seen = set()
    kept, wanted = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))

    def insert(new):
        for _ in range(3):
            for q in list(new):
                role, to = wanted[q]
                c = (new[q][0] + 3, new[q][1] + "I", (*new[q][2], f"{role}:"))
                new[to] = min(new.get(to, c), c)
        return new

    states = insert(states)
    for _, role, text in rows:
        core, new = text.strip(SPACE), {}
        go = not core or (role, text) in seen
        seen.add((role, text))
        more = 0 if go or core[-1] in ".!?" else 3
        for q, (cost, audit, out) in states.items():
            options = [(q, (cost + 4, audit + "D", out))]
            if not go:
                options.append((wanted[q][1], (cost + 3 + more, audit + "R", (*out, f"{wanted[q][0]}:{text}"))))
                if role[:1] in kept[q]:
                    options.append((kept[q][role[:1]], (cost + more, audit + "K", (*out, f"{role}:{text}"))))
            for to, c in options:
                new[to] = min(new.get(to, c), c)
        states = insert(new)
    cost, audit, out = min(states[q] for q in (0, 3) if q in states)
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def random_rows(r, n):
    roles, texts = ["user", "assistant", "system", "tool", "", "unknown"], ["Hi.", "Well", "", " \t", "What?", "So it goes!", "é."]
    return [(r.choice([None, i, i + r.randrange(3)]), r.choice(roles[: r.randrange(2, 7)]), r.choice(texts) + (str(r.randrange(3)) + "." if r.random() < 0.5 else "")) for i in range(n)]


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


def run(rows, repair=None):
    repair = repair or Repair()
    for row in rows:
        repair.add(*row)
    return repair.result()


@pytest.mark.parametrize("seed", range(150))
def test_repairs_are_those_of_a_search_over_all_edits(seed):
    r = random.Random(seed)
    rows = in_order(random_rows(r, r.randrange(0, 5)))
    assert run(rows) == brute_repair(rows)


@pytest.mark.parametrize("prime", [conversations._PRIME, 7])
@pytest.mark.parametrize("nodes", [conversations.NODES, 4])
def test_colliding_hashes_and_written_prefixes_change_nothing(prime, nodes):
    r = random.Random(5)
    for n in (1, 3, 8, 40, 120):
        for _ in range(20):
            rows = in_order(random_rows(r, n))
            assert run(rows, Repair(Edits(prime), nodes))[5:] == plain_repair(rows)


def test_a_long_conversation_of_one_role_is_repaired_in_time():
    rows = [(i, "user", f"Point {i}.") for i in range(30_000)]
    cost, audit = run(rows)[5:7]
    assert cost == 45_000 and audit == "KR" * 15_000
    rows = [(i, "system", " ") for i in range(20_000)]
    assert run(rows)[5:7] == (80_000, "D" * 20_000)


def brute_damage(rows):
    out = {}
    for conv_id, turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        hurt = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv_id, [])
        if hurt == 1:
            text = ""
        if hurt == 2:
            text = re.sub(r"[.!?]", "", text)
        if hurt == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if hurt == 0 else 2 if hurt == 3 else 1)
    return {k: in_order(v) for k, v in out.items()}


def test_damage_and_repair_of_a_table(spark):
    r = random.Random(9)
    rows = []
    for conv_id in [None, *range(400)]:
        for turn in [*range(r.randrange(1, 5)), *([None] if r.random() < 0.1 else [])]:
            rows.append((conv_id, turn, r.choice(["user", "assistant", "system", None, "tool"]), r.choice(["Yes. No!", "what?", None, "", "and ", "so\n\n"]) if r.random() < 0.7 else f"Line {turn}."))
    rows += rows[:10]
    frame = spark.createDataFrame([(*x, "x", 1) for x in rows], "conv_id long, turn int, role string, text string, audit string, copies int")
    got = {x["conv_id"]: tuple(x)[1:] for x in repaired(damaged(frame)).collect()}
    want = brute_damage(rows)
    assert set(got) == set(want) and None in got
    for conv_id, own in want.items():
        assert got[conv_id][5:] == plain_repair(own), own
        if len(own) < 5:
            assert got[conv_id] == brute_repair(own), own
    assert any(not own for own in want.values())


def test_all_rows_dropped_empty_tables_and_long_texts(spark):
    schema = "conv_id string, turn long, role string, text string, copies long"
    assert repaired(spark.createDataFrame([], schema)).count() == 0
    rows = [("a", 1, "user", "x", 0), ("b", None, "user", "word " * 200_000 + "end.", 1), ("b", None, "assistant", "ok.", None)]
    got = {x["conv_id"]: tuple(x)[1:] for x in repaired(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # null turns: by role, so that the assistant stands first
    assert got["b"][:7] == (0, 0, 0, 0, 0, 6, "IKKI")
