"""Lines by byte ranges, samples by offset, and heads of files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomtrail.sources import chat, discover, ranges
from loomtrail.sources.ranges import NarrowedReader, heads, lines_of, read_ranges, read_sample, read_samples, with_rows

LINES = ['{"id": "a", "messages": []}', "", "  ", "é" * 50, '{"id": "b", "messages": [1]}\r', "{broken", "x" * 3000, '{"id": "a", "messages": []}', '{"messages": []}', '{"id": "c"}', "last"]


def offsets(data):
    out, at = [], 0
    for line in data.split(b"\n"):
        if line.strip():
            out.append((at, line.removesuffix(b"\r")))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 10**9])
@pytest.mark.parametrize("end", ["", "\n", "\n\n"])
@pytest.mark.parametrize("read", [5, 1 << 20])
def test_each_line_is_in_one_range(tmp_path, monkeypatch, split, end, read):
    monkeypatch.setattr(ranges, "READ", read)
    data = ("\n".join(LINES[:6] + ["x" * 90] + LINES[7:]) + end).encode()
    (tmp_path / "f").write_bytes(data)
    found = []
    for start in range(0, len(data), split):
        with open(tmp_path / "f", "rb") as f:
            found += [(at, line) for at, line in lines_of(f, start, start + split) if line.strip()]
    assert found == offsets(data)


def test_rows_keys_and_offsets(spark, tmp_path):
    for name in ("x.jsonl", "y.jsonl", "_hidden.jsonl"):
        (tmp_path / name).write_bytes("\n".join(LINES).encode() + b"\n\xff\xfe\n")
    lines = read_ranges(spark, str(tmp_path), split=100)
    assert lines.rdd.getNumPartitions() > 40
    data = (tmp_path / "x.jsonl").read_bytes()
    want = [(at, n) for n, (at, _) in enumerate(offsets(data))]
    for name in ("x.jsonl", "y.jsonl"):
        got = with_rows(lines).where(F.col("file").endswith(name)).orderBy("offset").collect()
        assert [(r["offset"], r["row"]) for r in got] == want and got[-1]["value"] is None
    samples = read_samples(spark, str(tmp_path / "x.jsonl"), split=64).orderBy("offset").collect()
    at = dict(enumerate(o for o, _ in offsets(data)))
    assert [(r["row"], r["key"], r["offset"]) for r in samples] == [(0, "a", 0), (2, "b", at[2]), (5, f"@{at[5]}", at[5]), (6, f"@{at[6]}", at[6])]


def test_one_sample_is_read_from_its_place(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    with open(path, "w") as f:
        f.writelines(json.dumps({"id": f"s{i}", "messages": [{"role": "user", "content": "x" * 100}]}) + "\n" for i in range(5000))
    rows = read_samples(spark, path, split=10_000).where("sample_id = 's4321'").collect()
    one = read_sample(spark, path, rows[0]["offset"], "s4321")
    assert one.rdd.getNumPartitions() == 1 and [r["sample_id"] for r in one.collect()] == ["s4321"]
    # where it isn't the one that was there, nothing else is shown instead
    with pytest.raises(Exception, match="has changed"):
        read_sample(spark, path, rows[0]["offset"], "s1").collect()
    assert read_sample(spark, path, 10**9, "s1").count() == 0


def test_filters_narrow_what_is_opened(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text("one\ntwo\nthree\n" * 100)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = NarrowedReader({"path": str(tmp_path), "split": "100"})
    assert len(reader.partitions()) == 28
    filters = [EqualTo(("offset",), 4), EqualTo(("file",), str(tmp_path / "b")), GreaterThan(("start",), 3)]
    assert list(reader.pushFilters(filters)) == filters
    assert [(p.file, p.start, p.stop) for p in reader.partitions()] == [(str(tmp_path / "b"), 4, 5)]
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    for on in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
        got = read_ranges(spark, str(tmp_path)).where(F.col("offset") == 4).collect()
        assert sorted((os.path.basename(r["file"]), r["value"]) for r in got) == [("a", "two"), ("b", "two")]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_empty_folders_and_files(spark, tmp_path):
    assert read_ranges(spark, str(tmp_path)).count() == 0
    (tmp_path / "e.jsonl").write_text("")
    assert read_samples(spark, str(tmp_path)).count() == 0


def test_heads_end_at_the_first_bad_line(tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n[2]\nno json\n{"b": 2}\n')
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n' * 100)
    (tmp_path / "z.jsonl").write_text('{"a": "' + "x" * 2000 + '"}\n')
    (tmp_path / "d.json").write_text('{\n"a": 1}')
    names = [str(tmp_path / n) for n in ("x.jsonl", "y.jsonl", "z.jsonl", "d.json")]
    assert [len(h) for _, h in heads(names, 40, 1000)] == [2, 40, 0, 1]


def test_discovery_reads_heads_only(spark, tmp_path):
    sample = json.dumps({"id": "s", "messages": [{"role": "user", "content": "hi"}]})
    (tmp_path / "good.jsonl").write_text((sample + "\n") * 50)
    (tmp_path / "late.jsonl").write_text("no json\n" + sample + "\n")
    (tmp_path / "steps.json").write_text('{\n  "schema_version":\n  "ATIF-v1.2",\n "steps": []}')
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.jsonl").write_text(sample)
    got = {os.path.basename(r["path"]): r["format"] for r in discover.discover(spark, str(tmp_path)).collect()}
    assert got == {"good.jsonl": "chat", "steps.json": "steps"}


def test_chat_runs_have_their_place(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    lines = [json.dumps({"id": i, "messages": [{"role": "user", "content": "go on then"}]}) if i else json.dumps({"messages": []}) for i in ("a", "b", "a", None)]
    path.write_text("\n".join(lines))
    runs = {r["offset"]: (r["key"], r["sample_id"], r["row"]) for r in chat.read_chat(spark, str(path)).runs.collect()}
    at = [o for o, _ in offsets(path.read_bytes())]
    assert runs == {0: ("a", "a", 0), at[1]: ("b", "b", 1), at[2]: (f"@{at[2]}", "a", 2), at[3]: (f"@{at[3]}", f"@{at[3]}", 3)}
