"""Word differences by region, and whom changes belong to, against brute force."""

import hashlib
import os
import random
import re
import time

import pytest

from loomtrail.functions.diffs import regions, word_diff
from loomtrail.operators import ownership, rewrites
from loomtrail.plans import rewrite_queries

FIELDS = "sample_id string, row int, step int, field string, old string, new string"
EDITS = "sample_id string, step int, field string, n int, edit string, old string, new string"


def parts(old, new):
    return [({"same": "=", "removed": "-", "added": "+"}[op], text) for op, text in word_diff(old, new)]


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        ("same", "same", [("=", "same")]),
        ("", "", []),
        ("", "new", [("+", "new")]),
        ("a\n", "", [("-", "a\n")]),
        ("Following these rules I can start.", "I can start.", [("-", "Following these rules "), ("=", "I can start.")]),
        ("a b c", "x y z", [("-", "a b c"), ("+", "x y z")]),
        ("Please look at the two old plans before lunch.", "Please look for anything else you might need.", [("=", "Please look "), ("-", "at the two old plans before lunch"), ("+", "for anything else you might need"), ("=", ".")]),
        ("They will run the check twice.", "They will run the check once.", [("=", "They will run the check "), ("-", "twice"), ("+", "once"), ("=", ".")]),
        ("first\nsecond line\nthird\n", "first\nsecond row\nthird\n", [("=", "first\nsecond "), ("-", "line"), ("+", "row"), ("=", "\nthird\n")]),
        ("I read the cards now, and the rest of this line stays as it is.", "I decide the design now, and the rest of this line stays as it is.", [("=", "I "), ("-", "read the cards"), ("+", "decide the design"), ("=", " now, and the rest of this line stays as it is.")]),
    ],
)
def test_word_differences(old, new, want):
    assert parts(old, new) == want


def test_texts_are_what_the_parts_say():
    r = random.Random(1)
    words = ["a", "bb", "ccc", "中", "é", "\n", " ", "  ", "x_1", ".", "same", "words"]
    for _ in range(400):
        old = "".join(r.choice(words) + r.choice(["", " "]) for _ in range(r.randrange(30)))
        new = "".join(w for w in re.split(r"( )", old) if r.random() < 0.9) + r.choice(["", "!", " end"])
        found = word_diff(old, new)
        assert "".join(t for op, t in found if op != "added") == old and "".join(t for op, t in found if op != "removed") == new
        ops = [op for op, _ in found]
        assert all(a != b and (a, b) != ("added", "removed") for a, b in zip(ops, ops[1:], strict=False))
    assert {"same", "removed", "added"} >= set(ops)
    assert ("same", "我先") in word_diff("我先读取参考卡片再选方向。", "我先自己选方向。")


def test_a_long_line_takes_little_time():
    old = " ".join(f"word{i % 97}" for i in range(1500))
    new = old.replace("word50", "other", 3)
    began = time.perf_counter()
    found = word_diff(old, new)
    assert time.perf_counter() - began < 3 and len(old) > 10_000
    assert [t for op, t in found if op == "removed"] == ["word50"] * 3
    wide = "x y " * 12_000
    assert [op for op, _ in word_diff(wide, wide.replace("x", "z", 1))] == ["removed", "added"]


def locate(text, needle):
    if not needle:
        return None
    at = text.find(needle)
    if at >= 0:
        return at, at + len(needle)
    words = needle.split()
    m = re.search(r"\s+".join(map(re.escape, words)), text) if 0 < len(words) <= 2000 else None
    return m and m.span()


def brute(fields, edits):
    """Changes by walking through each text, and the edits that none belongs to."""
    out, used = [], set()
    for sample, row, step, field, old, new in fields:
        old, new = old or "", new or ""
        own = sorted((e for e in edits if e[:3] == (sample, step, field)), key=lambda e: e[3])
        spots = [locate(old, e[5] or "") for e in own]
        exact = bool(own) and None not in spots
        if exact:
            at, text = 0, ""
            for (start, stop), e in sorted(zip(spots, own, strict=True), key=lambda x: x[0]):
                exact = exact and start >= at
                text, at = text + old[at:start] + (e[6] or ""), stop
            exact = exact and text + old[at:] == new
        runs = []
        if exact:
            for (start, stop), e in sorted(zip(spots, own, strict=True), key=lambda x: x[0]):
                runs += [((e[4],), old[start:stop][r.old_start : r.old_stop], (e[6] or "")[r.new_start : r.new_stop]) for r in regions(old[start:stop], e[6] or "")]
        else:
            for r in regions(old, new):
                touches = lambda s, a, b: s is not None and s[0] <= b and a <= s[1]
                who = tuple(e[4] for e, s in zip(own, spots, strict=True) if touches(s, r.old_start, r.old_stop) or touches(locate(new, e[6] or ""), r.new_start, r.new_stop))
                runs.append((who, old[r.old_start : r.old_stop], new[r.new_start : r.new_stop]))
        for who in dict.fromkeys(w for w, _, _ in runs):
            mine = [(a, b) for w, a, b in runs if w == who]
            said = "\0".join(s + t for a, b in mine for s, t in (("-", a), ("+", b)) if t)
            name = "e:" + "+".join(who) if who else f"h:{step}:{field}:{hashlib.sha1(said.encode()).hexdigest()[:10]}"
            out.append((sample, step, name, " … ".join(a for a, _ in mine if a), " … ".join(b for _, b in mine if b), "+".join(who)))
            used |= {(sample, w) for w in who}
    return sorted(out), sorted((e[0], e[4]) for e in edits if (e[0], e[4]) not in used)


def run(spark, fields, edits):
    told = spark.createDataFrame(edits, EDITS)
    changes = ownership.owned_changes(spark.createDataFrame(fields, FIELDS), told)
    rows = [(r["sample_id"], r["step"], r["id"], r["removed"], r["added"], "+".join(r["owners"])) for r in changes.collect()]
    return sorted(rows), sorted((r["sample_id"], r["edit"]) for r in ownership.unplaced_edits(told, changes).collect())


def test_changes_belong_to_their_edits(spark):
    fields = [
        ("a", 1, 3, "thinking", "As the manual says I open the samples first. Then I go on.", "I choose a layout. Then I go on."),
        ("a", 2, 4, "text", "The last step was never recorded.", "The last step was recorded by nobody."),
        ("b", 1, 9, "thinking", "By the book I take card A. By the book I take card B.", "I took A. I took B."),
        ("c", 1, 2, "text", "One  two\nthree four five six seven.", "One 2 three four five six 7."),
        ("d", 1, 2, "text", "nothing changes", "nothing changes"),
        ("e", 1, 2, "text", "x 𝒳 y (a.b) z", "x 𝒳 y [c] z"),
        ("f", 1, 1, "text", None, "all of it is new"),
    ]
    edits = [
        ("a", 3, "thinking", 0, "2:rewrite:0", "As the manual says I open the samples first.", "I choose a layout myself."),
        ("b", 9, "thinking", 0, "one", "By the book I take card A.", "I took A."),
        ("b", 9, "thinking", 1, "two", "By the book I take card B.", "I took B."),
        ("c", 2, "text", 0, "p", "two three", "2 three"),
        ("c", 2, "text", 1, "q", "not there", "nor there"),
        ("d", 2, "text", 0, "k", "nothing", "something"),
        ("e", 2, "text", 0, "dots", "(a.b)", "[c]"),
        ("z", 2, "text", 0, "lost", "x", "y"),
    ]
    rows, lost = run(spark, fields, edits)
    assert (rows, lost) == brute(fields, edits)
    ids = {(r[0], r[2].split(":")[0] if r[2].startswith("h") else r[2]) for r in rows}
    assert ids == {("a", "e:2:rewrite:0"), ("a", "h"), ("b", "e:one"), ("b", "e:two"), ("c", "e:p"), ("c", "h"), ("e", "e:dots"), ("f", "h")}
    assert lost == [("c", "q"), ("d", "k"), ("z", "lost")]
    # other texts and edits of a sample don't change an id
    again, _ = run(spark, fields[1:2] + [("a", 9, 8, "text", "other", "text")], edits[:1])
    assert [r for r in rows if r[:2] == ("a", 4)] == [r for r in again if r[:2] == ("a", 4)]


def test_random_edits(spark):
    r = random.Random(3)
    fields, edits = [], []
    for n in range(150):
        words = [r.choice(["alpha", "beta", "the", "of", "card", "(x)", "é."]) for _ in range(r.randrange(1, 25))]
        old = "".join(w + r.choice([" ", " ", "  ", "\n"]) for w in words)
        new = old
        for k in range(r.randrange(4)):
            at = r.randrange(len(words))
            was, said = r.choice([" ", "  "]).join(words[at : at + 2]), r.choice(["", "gone", "the new one", "beta"])
            edits.append((f"s{n}", 1, "text", k, f"k{k}", was, said))
            if (spot := locate(new, was)) and r.random() < 0.8:
                new = new[: spot[0]] + said + new[spot[1] :]
        fields.append((f"s{n}", 0, 1, "text", old, new + r.choice(["", "", "tail"])))
    assert run(spark, fields, edits) == brute(fields, edits)


def test_ids_of_steps_and_calls(spark):
    steps = spark.createDataFrame([("s", 2, None, "removed"), ("s", None, 4, "added"), ("s", 1, 1, "content")], "sample_id string, old_step int, new_step int, how string")
    assert sorted(r["id"] for r in ownership.step_changes(steps).collect()) == ["s:+:4", "s:-:2"]
    a = spark.createDataFrame([("s", "c1", "Read", "x"), ("s", "c2", "Read", "x")], "sample_id string, call_id string, tool string, input string")
    b = spark.createDataFrame([("s", "c1", "Read", "y"), ("s", "c3", "Bash", "x")], a.schema)
    assert sorted(r["id"] for r in ownership.call_changes(rewrites.tool_changes(a, b)).collect()) == ["t:c1:changed", "t:c2:removed", "t:c3:added"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables aren't here")
def test_the_query_on_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    fields, records = rewrite_queries.rewritten_texts(spark, sf)
    rows = [tuple(x) for x in fields.select("sample_id", "row", "step", "field", "old", "new").collect()]
    told = [tuple(x) for x in records.select("sample_id", "step", "field", "n", "edit", "old", "new").collect()]
    want, lost = brute(rows, told)
    got = sorted(tuple(x) for x in rewrite_queries.owned_changes(spark, sf).select("sample_id", "step", "id", "removed", "added", "owners").collect())
    assert got == want and len(got) > 100 and {i[2][:2] for i in got} == {"e:", "h:"}
    assert sorted((x["sample_id"], x["edit"]) for x in rewrite_queries.unplaced_edits(spark, sf).collect()) == lost
