"""The corpus pipeline, stage by stage and as a whole."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from isohyet.llm import op02_decontaminate, op09_simhash, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    place, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"place": F.lit(1), "toxicity": F.lit("kept"), "a.b": F.lit(2), "c d": F.lit(3), "c`d": F.lit(4)})
    docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).write.parquet(f"{place}/documents")
    out["documents"] = docs = spark.read.parquet(f"{place}/documents")
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"{place}/{name}")
        out[name] = docs = spark.read.parquet(f"{place}/{name}")
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    for name, _ in cp.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns
    counts = [stages[n].count() for n in ("documents", "toxicity", "near_duplicates", "decontamination", "pii")]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0.5 * counts[0]


def test_decisions_take_effect(stages, spark):
    # By brute force: the smallest id of every group of the fingerprints.
    from test_operators_llm import component_brute

    before = [(r.doc_id, r.text) for r in stages["toxicity"].select("doc_id", "text").collect()]
    assert sorted({c for _, _, c in component_brute(before)}) == sorted({r.doc_id for r in stages["near_duplicates"].collect()})
    kept = op09_simhash.near_duplicates(stages["near_duplicates"])
    assert kept.count() == kept.select("component").distinct().count()
    found = op02_decontaminate.find_contamination(stages["decontamination"], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert found.where("n_hit > 0 and 20 * n_hit >= n_words").count() == 0
    assert not any(re.search(r"[\w.]+@[\w-]+\.\w", r.text or "") for r in stages["pii"].collect())
    assert stages["pii"].where("n_chars != length(text)").count() == 0
    assert stages["packing"].select("doc_id").distinct().count() == stages["pii"].select("doc_id").distinct().count()


def test_run_and_empty(spark, stages):
    assert cp.run(spark, SF).count() > 0
    none = stages["documents"].limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_places_outlast_other_splits(spark, tmp_path, monkeypatch):
    """The files are split in another way from the operator's end on, as when an
    executor is lost."""
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)] * 2
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/docs")
    real = op09_simhash.near_duplicates

    def then_split(*a):
        out = real(*a)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return out

    monkeypatch.setattr(op09_simhash, "near_duplicates", then_split)
    spark.conf.set("spark.sql.files.minPartitionNum", "8")
    try:
        kept = [r.doc_id for r in cp.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), SF).collect()]
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(kept) == list(range(40))


def test_frames_that_are_no_files(spark):
    """Rows dealt anew, as by a shuffle: places must still tell them apart."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (cp.near_duplicates, cp.decontamination):
        want = sorted(r.doc_id for r in stage(spark, docs, SF).collect())
        assert sorted(r.doc_id for r in stage(spark, docs.repartition(4), SF).collect()) == want


def test_registered():
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is cp.run and set(registry.QUERIES) < set(e.queries())
