"""The pipeline, stage by stage, and the registered queries."""

import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as spark_entry
import corpus_pipeline
from guichet.llm import minhash_join, mixing, pii, quality_forest
from guichet.llm.common import table
from guichet.llm.queries import QUERIES, SQL
from guichet.operators.settle import stage

SF = "/root/testdata/sf0.001"


def test_fourteen_queries_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(spark_entry.queries())
    assert set(SQL) <= set(spark_entry.oracle_sql())


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out of it."""
    docs, out = table(spark, SF, "documents"), []
    for name, apply in corpus_pipeline.STAGES:
        result = stage(apply(spark, docs, SF))
        out.append((name, docs, result))
        docs = result
    return out


def test_columns_stay(stages):
    assert [name for name, _, _ in stages] == ["quality_rules", "near_duplicates", "surrogates", "mix_sources", "sample_segmentations"]
    columns = stages[0][1].columns
    assert all(result.columns == columns and result.schema == docs.schema for _, docs, result in stages[:-1])


def test_quality_stage(spark, stages):
    _, docs, result = stages[0]
    forest = quality_forest.fit_forest(docs, table(spark, SF, "labels"))
    kept = {r["doc_id"] for r in quality_forest.judge(docs, forest).collect() if r["kept"]}
    assert sorted(r["doc_id"] for r in result.collect()) == sorted(kept)
    assert 0 < len(kept) < docs.count()


def test_near_duplicate_stage(stages):
    _, docs, result = stages[1]
    kept = {r["doc_id"] for r in minhash_join.near_duplicates(docs).collect() if r["kept"]}
    assert sorted(r["doc_id"] for r in result.collect()) == sorted(kept)


def test_surrogate_stage(stages):
    _, docs, result = stages[2]
    before = {r["doc_id"]: r for r in docs.collect()}
    after = {r["doc_id"]: r for r in result.collect()}
    assert set(before) == set(after)
    for i, old in before.items():
        found = pii.mentions(old["text"])
        assert all(old["text"][a:b] not in after[i]["text"] for a, b, _, _ in found)
        assert found or old == after[i]
        assert after[i]["n_chars"] == len(after[i]["text"])


def test_mixing_stage(stages):
    _, docs, result = stages[3]
    sizes, taken = defaultdict(int), defaultdict(int)
    size_of = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    for r in docs.collect():
        sizes[r["source"]] += size_of[r["doc_id"]]
    copies = Counter(r["doc_id"] for r in result.collect())
    assert max(copies.values()) <= 2 and set(copies) <= set(size_of)
    for r in result.collect():
        taken[r["source"]] += size_of[r["doc_id"]]
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.05)
    report = {r["doc_id"]: r["copies"] for r in mixing.Mix(docs).report().collect()}
    assert copies == +Counter(report)


def test_segmentation_stage(stages):
    _, docs, result = stages[4]
    rows = result.collect()
    copies = Counter(r["doc_id"] for r in docs.collect())
    assert Counter(r["doc_id"] for r in rows if r["sample"] == 1) == copies
    assert all(r["round_trip"] and r["log_prob"] <= 0 and r["log_inclusion"] <= 0 for r in rows)


def test_run_equals_the_stages(spark, stages):
    want = Counter((r["doc_id"], r["sample"], tuple(r["ids"])) for r in stages[-1][2].collect())
    got = Counter((r["doc_id"], r["sample"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_pipeline_leaves_no_scratch_tables(spark, tmp_path):
    import os

    from guichet.session import ensure_checkpoint_dir, scratch

    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")

    def held():
        return {n for n in os.listdir(folder) if n.startswith(("table-", "rdd-"))}

    before = held()
    with scratch(spark):
        corpus_pipeline.run(spark, SF).write.parquet(str(tmp_path / "out"))
        assert held() > before
    assert held() <= before
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


@pytest.mark.parametrize(
    "extra", ["empty", "nulls"],
)
def test_odd_documents(spark, tmp_path, extra):
    """Nulls in any column, empty and very long texts, repeated rows and further columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, target double, row string"
    good = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, good, "en", "a", len(good), 0.5, "r"), (1, good, "en", "a", len(good), 0.5, "r"), (2, None, None, None, None, None, None),
        (None, good + " and more", None, None, None, None, None), (3, "", "en", "b", 0, 0.0, ""),
        (4, " ".join(f"long{i}" for i in range(200_000)), "en", "b", 0, 0.0, ""), (5, good + " write to x.y@mail.com now", "en", "", 0, 0.0, ""),
    ]
    docs = spark.createDataFrame([] if extra == "empty" else rows, schema)
    for name, apply in corpus_pipeline.STAGES:
        out = stage(apply(spark, docs, SF))
        if name != "sample_segmentations":
            assert out.columns == docs.columns
        docs = out
    found = {r["doc_id"] for r in docs.collect()}
    assert found == (set() if extra == "empty" else {1, None, 4, 5} & found) and (extra == "empty" or 4 in found)
