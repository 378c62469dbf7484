"""The external merge: rounds of few runs, ranges, long runs and hot keys, against a sort."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.llm import warc


def _pages(spark, n):
    rng = random.Random(6)
    rows = [(k if rng.random() < 0.98 else None, rng.choice(["http://hot.example/", f"http://h{rng.randrange(40)}.example/p{rng.randrange(9)}", None]), f"body {rng.randrange(n)}", "x") for k in range(n)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, key string")


def _ordered(index):
    return [tuple(r)[2:] for r in index.select(F.spark_partition_id(), F.monotonically_increasing_id(), *index.columns).collect()]


@pytest.mark.parametrize("fan_in,ranges", [(2, 5), (64, 1), (3, 40)])
def test_merged_index_is_the_sorted_index(spark, tmp_path, monkeypatch, fan_in, ranges):
    monkeypatch.setattr(warc, "FAN_IN", fan_in)
    folder = f"file:{tmp_path}/w"  # a form of URI that Spark gives
    runs = warc.write_archives(_pages(spark, 4000).repartition(7), folder)
    written = runs.collect()
    lines = [line for r in written for _, line in warc.run_lines(r["folder"], r["run"])]
    assert len(lines) == sum(r["n_lines"] for r in written) == 4000 and max(r["n_lines"] for r in written) > warc.RUN_BATCH
    index = warc.merge_runs(runs, ranges)
    assert _ordered(index) == sorted(lines, key=warc._order)
    parts = index.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) <= ranges and max(r["count"] for r in parts) < 3 * 4000 / ranges + 100  # a hot URL is spread
    assert warc.read_records(index, folder).count() == 4000


def test_slices_of_a_run(tmp_path):
    run = warc.RunWriter(f"file://{tmp_path}")
    lines = [(f"k{k // 7:05d}", "t", k if k % 5 else None, None, "f", k, 1) for k in range(2600)]
    lines.sort(key=warc._order)
    for x in lines:
        run.add(x)
    row = run.close().to_pylist()[0]
    assert row["n_lines"] == 2600 and len(row["marks"]) <= warc.MARKS
    rng = random.Random(1)
    for _ in range(60):
        low, high = sorted(warc._order(rng.choice(lines)) for _ in range(2))
        assert [x for _, x in warc.run_lines(row["folder"], row["run"], low, high)] == [x for x in lines if low <= warc._order(x) < high]


def test_nothing_stays_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "shared_dir", lambda s: f"file://{tmp_path}")
    pages = _pages(spark, 50).unionByName(spark.createDataFrame([(900, "http://a.example/", "long " * 400_000, "x"), (900, "http://a.example/", "long " * 400_000, "x")], "page_id bigint, url string, html string, key string"))
    got = warc.archive_round_trip(pages)
    assert got.count() == 52 and not [p for p in tmp_path.iterdir() if p.name.startswith("warc-")]
    assert {r["record_type"] for r in got.where("page_id = 900").collect()} == {"response"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
