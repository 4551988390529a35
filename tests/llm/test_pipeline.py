"""The pipeline's stages one after the other, and the entry points."""

from pathlib import Path

import corpus_pipeline

from nidifold.llm import exact_dedup, near_dedup, queries
from nidifold.llm.common import release, shared_dir, staged


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        rows = corpus_pipeline.staged(stage(spark, rows, sf_dir), f"test-{name}")
        counts.append(rows.count())
        if name != "packing":
            assert rows.columns == docs.columns
            assert rows.exceptAll(before).count() == 0
        if name == "exact_dedup":
            assert exact_dedup.exact_duplicates(rows).filter("NOT kept").count() == 0
        if name == "near_dedup":
            assert near_dedup.near_duplicates(rows).filter("NOT kept").count() == 0
    assert counts[0] > counts[1] > counts[2] >= counts[3] >= counts[4] > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[5]


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_staged_tables_can_be_released(spark):
    df = staged(spark.range(5).toDF("x"), "released")
    assert df.count() == 5 and df.columns == ["x"]
    (path,) = {p.rsplit("/", 1)[0] for p in df.inputFiles()}
    release(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def test_stages_leave_no_passed_tables(spark, sf_dir):
    """A stage before packing leaves what its lazy result reads, not all tables that it staged on the way."""
    rows, left = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    folder = Path(shared_dir(spark).removeprefix("file://"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        release(spark)
        before = {p.name for p in folder.iterdir()} if folder.exists() else set()
        rows = stage(spark, rows, sf_dir)
        left[name] = sorted(p.name.rpartition("-")[0] for p in folder.iterdir() if p.name not in before)
        rows = spark.createDataFrame(rows.collect(), rows.schema)
    assert left == {"toxicity": ["toxic"], "exact_dedup": ["kept-rows", "numbered"], "near_dedup": ["near-lost", "repeated-ids"], "decontamination": ["contaminated"]}
