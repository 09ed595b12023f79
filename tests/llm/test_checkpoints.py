"""How many files the checkpoints write where each shuffle has more partitions than the cluster has use for."""

from pathlib import Path

import pytest

from sedimenta.llm import common, line_dedup

HELD = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in HELD}
    for k, v in HELD.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def files(spark):
    """Files of each checkpoint written so far."""
    common.shared_folder(spark)
    top = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    return {str(d): len(list(d.glob("part-*"))) for d in top.glob("rdd-*")}


def test_dedup_lines_writes_few_files(many_partitions):
    spark = many_partitions
    most, before = common.FILES_A_CORE * spark.sparkContext.defaultParallelism, files(spark)
    assert most < int(HELD["spark.sql.shuffle.partitions"])
    line = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(i, f"own words of number {i}\n{line}") for i in range(60)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {i: f"own words of number {i}" + f"\n{line}" * (i == 0) for i in range(60)}
    written = [n for d, n in files(spark).items() if d not in before]
    assert written and max(written) <= most


def test_few_files_hold_every_row(many_partitions):
    spark = many_partitions
    out = common.checkpoint_few(spark.range(1000).groupBy("id").count())
    assert sorted(r.id for r in out.collect()) == list(range(1000))
    assert out.rdd.getNumPartitions() <= common.FILES_A_CORE * spark.sparkContext.defaultParallelism
