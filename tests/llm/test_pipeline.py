"""The pipeline over small tables against what brute force keeps."""

from collections import Counter

import pytest

import corpus_pipeline
from loomtrail.llm.common import stored

from .test_dedup import brute_exact, brute_simhash, prose
from .test_models import brute_targets


@pytest.fixture
def tables(spark, tmp_path):
    good = [(i, prose(i, 300), "en", f"s{i % 4}") for i in range(120)]
    bad = [(200 + i, " ".join(w.upper() + "!!" for w in prose(i, 60).split()), "de", "s1") for i in range(60)]
    copies = [(300 + i, good[i % 7][1].replace(" ", "\n" if i % 2 else "  "), "en", "s0") for i in range(40)]
    near = []
    for i in range(30):
        words = good[20 + i % 5][1].split()
        words[10 * i % 300] = "other"
        near.append((400 + i, " ".join(words), "en", None))
    items = [(i, prose(9000 + i, 20)) for i in range(10)]
    leaks = [(500 + i, f"{prose(600 + i, 150)} {items[i][1].upper()} {prose(700 + i, 150)}", "en", "s2") for i in range(10)]
    empty = [(900, None, None, None), (901, "", None, "s3")]
    docs = good + bad + copies + near + leaks + empty
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(*d, len(d[1] or ""), "x") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, copies string", "documents")
    write([(d[0], int(d[0] < 200)) for d in good + bad], "doc_id long, quality int", "labels")
    write(items, "item_id long, text string", "benchmark")
    return str(tmp_path), docs


def test_pipeline(spark, tables):
    sf_dir, docs = tables
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "benchmark decontamination", "mixing sources to target weights"]
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = frame.columns, []
    for _, stage in corpus_pipeline.STAGES:
        frame = stored(stage(spark, frame, sf_dir))
        kept.append({r["doc_id"] for r in frame.select("doc_id").collect()})
        assert frame.columns[: len(columns)] == columns
    text, source = {d[0]: d[1] for d in docs}, {d[0]: d[3] for d in docs}
    # the classifier: labelled as it learned; what has no label is like the good ones
    assert {i for i in kept[0] if i < 900} == {d[0] for d in docs if not 200 <= d[0] < 300 and d[0] < 900}
    assert kept[1] == {k for k, _ in brute_exact([(i, text[i]) for i in kept[0]]).values()}
    prints, root = {i: brute_simhash(text[i]) for i in kept[1]}, {i: i for i in kept[1]}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert kept[2] == {i for i in prints if find(i) == i} and len(kept[2]) < len(kept[1])
    assert kept[3] == {i for i in kept[2] if not 500 <= i < 600} and set(range(7, 120)) <= kept[3]
    sizes = Counter()
    for i in kept[3]:
        sizes[source[i]] += len((text[i] or "").split())
    want, taken = brute_targets(sizes), Counter()
    for r in frame.collect():
        assert r["copies"] == "x" and 1 <= r["copies_"] <= 3
        taken[r["source"]] += r["copies_"] * len(r["text"].split())
    assert all(abs(taken[s] - want[s]) <= 320 for s in sizes)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == kept[4]


def test_pipeline_of_empty_tables(spark, tmp_path):
    for schema, name in (("doc_id long, text string, lang string, source string, n_chars long", "documents"), ("doc_id long, quality int", "labels"), ("item_id long, text string", "benchmark")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
