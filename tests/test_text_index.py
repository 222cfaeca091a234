"""The kept text index: the same scores as a new one, and only the buckets of a query's terms opened."""

import random
import re

import pytest

from loomtrail.operators import search
from loomtrail.operators.text_index import TextIndex

STEPS = "run_id int, step int, text string"
QUERIES = ["quick", '"quick brown"', "brown the", "café", "none", "", '"the the"', "文字"]


def steps_of(seed, runs):
    r = random.Random(seed)
    words = ["the", "quick", "brown", "fox", "Café", "中文字", "jumps", "42", "of"]
    return [(run, step, None if r.random() < 0.05 else " ".join(r.choice(words) for _ in range(r.randrange(12)))) for run in runs for step in range(r.randrange(1, 6))]


def hits(df):
    return [(r["run_id"], r["step"], round(r["score"], 9)) for r in df.collect()]


def check(spark, index, rows):
    frame = spark.createDataFrame(rows, STEPS)
    for query in QUERIES:
        want = hits(search.search_text(frame, query))
        assert hits(index.search(query)) == want, query
        sizes = frame.select("run_id", "step", search.F.size(search.terms(search.F.coalesce("text", search.F.lit("")))).alias("size"))
        assert hits(search.search(search.postings(frame), query, sizes=sizes)) == want


def test_search_replace_and_remove(spark, tmp_path):
    rows = steps_of(1, range(40))
    index = TextIndex(spark, str(tmp_path))
    index.build(spark.createDataFrame(rows, STEPS), parts=4, buckets=8)
    check(spark, index, rows)
    before = set(map(str, tmp_path.rglob("*.parquet")))
    new = steps_of(2, [3, 7, 100])
    index.replace(spark.createDataFrame(new, STEPS), spark.createDataFrame([(5,), (7,), (999,)], "run_id int"))
    rows = [r for r in rows if r[0] not in (3, 5, 7)] + new
    # another reader sees the same, and what was there is still there for those who read it
    check(spark, TextIndex(spark, str(tmp_path)), rows)
    assert before <= set(map(str, tmp_path.rglob("*.parquet")))
    index.replace(spark.createDataFrame([], STEPS), spark.createDataFrame([(r,) for r in {r[0] for r in rows}], "run_id int"))
    assert hits(index.search("quick")) == []
    index.replace(spark.createDataFrame(rows[:5], STEPS))
    check(spark, index, rows[:5])


def test_only_the_parts_that_change_are_written(spark, tmp_path):
    rows = steps_of(3, range(30))
    index = TextIndex(spark, str(tmp_path))
    index.build(spark.createDataFrame(rows, STEPS), parts=8, buckets=4)
    versions = lambda: {r["part"]: r["version"] for r in index._last()}
    before = versions()
    index.replace(spark.createDataFrame(steps_of(4, [11]), STEPS))
    after = versions()
    assert sum(before[p] != after[p] for p in before) == 1
    index.replace(spark.createDataFrame([], STEPS))
    assert versions() == after


def test_a_query_opens_only_the_buckets_of_its_terms(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path))
    index.build(spark.createDataFrame(steps_of(5, range(60)), STEPS), parts=2, buckets=16)
    now = index._last()
    rows = index._postings(now).where((search.F.col("bucket") == search.F.pmod(search.F.xxhash64(search.F.lit("quick")), search.F.lit(16)).cast("int")) & (search.F.col("term") == "quick"))
    assert len(rows.inputFiles()) >= 1
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = index.search("quick")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = re.search(r"FileScan parquet.*", plan)[0]
    buckets = set(re.findall(r"bucket#\d+ = (\d+)", scan))
    assert "PartitionFilters" in scan and len(buckets) == 1 and "EqualTo(term,quick)" in scan


@pytest.mark.parametrize("rows", [[], [(1, 1, None)], [(1, 1, ""), (1, 2, "?!")]])
def test_nothing_to_index(spark, tmp_path, rows):
    index = TextIndex(spark, str(tmp_path))
    index.build(spark.createDataFrame(rows, STEPS), parts=2, buckets=2)
    assert hits(index.search("quick")) == []
    index.replace(spark.createDataFrame([(1, 1, "quick")], STEPS))
    assert [h[:2] for h in hits(index.search("quick"))] == [(1, 1)]


@pytest.mark.parametrize("name", ["phrase_search_bm25", "indexed_phrase_search"])
def test_scores_that_round_to_the_same_are_in_the_order_of_ids(spark, tmp_path, name):
    import duckdb

    from loomtrail.plans import catalog

    # nearly all have the terms, so that scores differ in the seventh decimal only
    texts = [(i, "the of and" + " more" * (120 - i)) for i in range(120)] + [(120, "nothing")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect().execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'").execute(catalog.oracle_sql()[name]).fetchall()
    assert [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()] == want


def test_postings_are_made_without_a_shuffle(spark):
    plan = search.postings(spark.createDataFrame(steps_of(6, range(3)), STEPS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def agrees(spark, index, rows):
    for query in ["quick", '"quick brown"']:
        assert hits(index.search(query)) == hits(search.search_text(spark.createDataFrame(rows, STEPS), query)), query


def test_a_replacement_writes_only_its_own_runs(spark, tmp_path):
    rows = steps_of(7, range(30))
    index = TextIndex(spark, str(tmp_path))
    index.build(spark.createDataFrame(rows, STEPS), parts=1, buckets=2)
    new = steps_of(8, [4])
    index.replace(spark.createDataFrame(new, STEPS), spark.createDataFrame([(9,)], "run_id int"))
    written = spark.read.parquet(f"{tmp_path}/postings").where(search.F.col("version") == index._last()[-1]["version"])
    assert {r["run_id"] for r in written.select("run_id").distinct().collect()} == {4}
    agrees(spark, index, [r for r in rows if r[0] not in (4, 9)] + new)


@pytest.mark.parametrize("before", [False, True])
def test_a_part_of_many_versions_is_written_whole(spark, tmp_path, monkeypatch, before):
    monkeypatch.setattr("loomtrail.operators.text_index.VERSIONS", 2)
    rows = steps_of(9, range(12))
    index = TextIndex(spark, str(tmp_path / "new"))
    index.build(spark.createDataFrame(rows, STEPS), parts=1, buckets=2)
    if before:
        # as it was written when a part had one version, and an empty term only for steps without terms
        spark.read.parquet(f"{index.path}/postings").where("term <> '' OR size = 0").write.partitionBy("part", "version", "bucket").parquet(f"{tmp_path}/old/postings")
        spark.read.parquet(f"{index.path}/commits").drop("since").write.parquet(f"{tmp_path}/old/commits")
        index = TextIndex(spark, str(tmp_path / "old"))
    for n in range(3):
        # 1 is replaced each time, 5 goes and comes back
        new, gone = steps_of(10 + n, [1] if n < 2 else [1, 5]), [5] if n == 0 else []
        index.replace(spark.createDataFrame(new, STEPS), spark.createDataFrame([(r,) for r in gone], "run_id int"))
        rows = [r for r in rows if r[0] not in {1, *gone, *(x[0] for x in new)}] + new
        assert len(index._last()) <= 2
        agrees(spark, index, rows)
