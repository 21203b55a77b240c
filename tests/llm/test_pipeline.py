"""The pipeline's stages on planted documents, and the queries' SQL."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import queries

from ..conftest import DATA
from ..test_queries import rows
from .conftest import frame


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_llm_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, f"{DATA}/sf0.001").toArrow()
    assert rows(got) == rows(duck.execute(queries.ORACLE_SQL[name]).to_arrow_table())


def test_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(0)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    base = [(i, text(80)) for i in range(60)]
    copies = [(100, base[3][1] + " tail"), (101, base[4][1])]
    docs = frame(spark, base + copies)
    stages = dict(corpus_pipeline.STAGES)
    sf = f"{DATA}/sf0.1"
    real = spark.read.parquet(f"{sf}/documents.parquet")
    rude = F.lower("text").rlike("idiot|moron|pathetic|worthless|disgusting")
    kept = stages["toxicity"](spark, real, sf)
    assert kept.columns == real.columns
    # documents labelled 1 need not be rude in English: what is left alone is counted by labels.toxic
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    left = {r["toxic"]: r["n"] for r in kept.join(labels, "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    all_ = {r["toxic"]: r["n"] for r in real.join(labels, "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kept.where(rude).count() <= 0.05 * real.where(rude).count()
    assert left[0] >= 0.98 * all_[0] and left.get(1, 0) <= 0.1 * all_[1], (left, all_)
    once = stages["MinHash near-dedup"](spark, docs, sf)
    ids = {r["doc_id"] for r in once.collect()}
    assert 3 in ids and 4 in ids and 100 not in ids and 101 not in ids and once.columns == docs.columns
    for name in ("line dedup", "MinHash near-dedup", "mixing"):
        assert stages[name](spark, docs, sf).columns == docs.columns
    assert stages["line dedup"](spark, docs, sf).count() == docs.count()


def test_run(spark):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, f"{DATA}/sf0.01")
    assert pieces.where("length > 0").count() > 500 and pieces.columns[:2] == ["doc_id", "start"]
