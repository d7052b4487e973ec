import os
import sys

import pytest
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from panelcast.llm import pii, simhash  # noqa: E402
from panelcast.llm.oracles import ORACLES  # noqa: E402
from panelcast.llm.queries import QUERIES  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_held_out_accuracy(spark):
    found = QUERIES["op2_language_id"](spark, SF).where("held_out")
    rows = found.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, total = rows.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.97 * total


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hard = spark.createDataFrame([(90_001, None, "en", "src1", None), (90_002, "", None, None, 0), (90_003, "12 !?", None, "src2", 5),
                                  (None, "the and of this " * 9, None, None, None), (90_005, "the and of this " * 9, "en", "src3", 1),
                                  (90_005, "the and of this " * 9, "en", "src3", 1)], DOCS)
    now = docs.unionByName(hard).withColumn("score", F.lit("clash")).withColumn("component_id", F.lit("clash")).cache()
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["language_id"](spark, now, SF).cache()
    assert kept.columns == now.columns
    assert not {90_001, 90_002, 90_003} & {r.doc_id for r in kept.collect()}
    assert kept.count() >= 0.97 * docs.where(F.col("text").rlike(r"\p{L}")).count()

    single = stages["simhash_dedup"](spark, kept, SF).cache()
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept).collect() if r.doc_id is not None}
    assert single.columns == now.columns
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == sorted(set(classes.values()))
    assert single.where("doc_id is null").count() == 1

    clean = stages["personal_data"](spark, single, SF).cache()
    assert clean.columns == now.columns and clean.count() == single.count()
    assert pii.find_spans(clean).where(F.size("spans") > 0).count() == 0
    assert clean.where("n_chars <> length(text)").count() == 0

    mixed = stages["mixture"](spark, clean, SF).cache()
    reads = mixed.groupBy("doc_id").count().agg(F.min("count"), F.max("count")).first()
    assert mixed.columns == now.columns and mixed.select("doc_id").distinct().count() == clean.select("doc_id").distinct().count()
    assert reads[0] == 1 and reads[1] <= 5

    coded = stages["tokens"](spark, mixed, SF)
    assert coded.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and coded.count() == mixed.count()


def test_repeated_ids_and_missing_ids_lose_no_text(spark):
    words = lambda name: " ".join(f"{name}{n}" for n in range(60))
    near = words("a").replace("a59", "q5")
    assert 0 < (simhash.fingerprint(words("a")) ^ simhash.fingerprint(near)).bit_count() <= 3
    rows = [(3, words("a")), (7, words("a")), (7, words("b")), (8, near), (8, words("c")), (9, words("d")), (9, words("d")),
            (None, words("e")), (None, words("e")), (None, words("f")), (0, words("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(5)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()]
    want = [(3, words("a")), (7, words("b")), (8, words("c")), (9, words("d")), (None, words("e")), (None, words("f")), (0, words("f"))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pipeline_on_an_empty_table(spark):
    now = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.collect() == []


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
