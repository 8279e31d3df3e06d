import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from inkveil.llm import quality
from inkveil.llm.shared import crc_of_id


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf)
        out.append((docs, rows))
        docs = spark.createDataFrame(rows.collect(), rows.schema)
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_each_stage_equals_brute_force(spark, sf, stages):
    (d0, r0), (d1, r1), (d2, r2), (d3, r3), (d4, r4) = stages
    scores = quality.score_quality(d0, spark.read.parquet(f"{sf}/labels.parquet"), crc_of_id(F.col("doc_id")) % 3 != 1)
    assert {i for i, _ in texts(r0)} == {r["doc_id"] for r in scores.filter("predicted = 1").collect()}
    assert {i for i, _ in texts(r1)} == {i for i, _, _, kept, _ in brute.exact(texts(d1)) if kept}
    assert {i for i, _ in texts(r2)} == {c for _, _, c in brute.near(texts(d2))}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {i for i, _ in texts(r3)} == {r[0] for r in brute.contaminated(texts(d3), items) if not r[5]}
    assert {r["doc_id"] for r in r4.collect()} == {i for i, _ in texts(d4)}
    for _, rows in stages[:-1]:
        assert rows.columns == d0.columns


def test_run_gives_the_last_stage(spark, sf, stages):
    names = ("doc_id", "piece", "length", "ids_crc32")
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).select(*names).collect()} == {tuple(r) for r in stages[-1][1].select(*names).collect()}


def test_stages_on_hard_and_empty_tables(spark, sf, docs_of, hard):
    for rows in (hard, [(None, None), (None, None), (3, "x")], []):
        docs = docs_of(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from inkveil.llm import shared

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_root(Session())
