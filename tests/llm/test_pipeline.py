"""The pipeline keeps columns and clean documents, and catches planted ones."""

import random

import pytest

pytest.importorskip("quakeframe.llm")
import corpus_pipeline  # noqa: E402
from quakeframe.llm.queries import QUERIES  # noqa: E402

from .test_operators import prose  # noqa: E402

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    bench = prose(30, rng)
    texts = [f"{prose(60, rng)}\n{prose(20, rng)}" for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "en", "s0", 0), (101, f"{prose(20, rng)} {bench}", "en", "s1", 0), (102, None, "en", "s0", None), (103, "", None, None, 0), (None, prose(20, rng), "en", "s1", 0)]
    for i in range(20):
        rows.append((200 + i, " ".join(prose(3, rng) + " vilex" for _ in range(12)), "en", "s2", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i >= 200)) for i in [*range(60), *range(200, 220)]], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k < 4:
            assert docs.columns == columns
        assert set(range(60)) <= ids | ({3} if k >= 2 else set()) and {102, 103} <= ids, name
        assert not ids & set(range(200, 220)), name
        if k >= 2:
            assert len(ids & {3, 100}) == 1
        assert (101 in ids) == (k < 3), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, null and very long texts, repeated rows, and columns that clash with those of the stages."""
    rng = random.Random(5)
    long = prose(20_000, rng)
    rows = [(1, None, "a", 1.0, "x", "y", "z"), (2, "", "a", 1.0, "x", "y", "z"), (3, long, "a", 1.0, "x", "y", "z"), (3, long, "a", 1.0, "x", "y", "z"), (None, prose(30, rng), None, 1.0, "x", "y", "z"), (4, prose(40, rng), "b", 1.0, "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Score double, Leaks string, __met string, __host string")
    spark.createDataFrame([(i, int(i % 2)) for i in range(4)], "doc_id long, toxic int").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(30, rng))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        out = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert out.columns == docs.columns and out.count() == (6 if k < 2 else 5), name
            docs = out
    assert {r["doc_id"] for r in out.collect()} == {1, 2, 3, 4, None}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_cover_all_documents(spark, name):
    n = spark.read.parquet(f"{DIR}/documents.parquet").count()
    got = QUERIES[name](spark, DIR)
    assert "doc_id" in got.columns
    if not name.startswith("op6"):
        assert got.select("doc_id").distinct().count() == n
