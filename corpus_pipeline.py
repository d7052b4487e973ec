"""A training corpus from ``documents``: languages, near-duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again for the next one.
All but the last return the columns of their input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bpe, langid, mixing, pii, simhash, warc

#: Documents whose language is determined with a lower score go, as do those without letters.
LEAST_SCORE = 0.3
#: Target entropy of the mixture as a share of that of equal weights, and how often a source may be read to reach it.
ENTROPY, REPETITION = 0.9, 4.0
#: A prediction this sure replaces the label that a document came with.
SURE = 0.9
#: Bytes of an Arrow batch: an executor holds several at a time, outside its heap.
BATCH_BYTES = "8m"


def _small_batches(spark: SparkSession) -> None:
    """Bounds the batches of the session's Python stages; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _same(rows: DataFrame, like: DataFrame, **new: F.Column) -> DataFrame:
    """``rows`` with the columns of ``like``, in their order, some replaced."""
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in like.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be determined; the prediction is their label where there is none and where it is sure."""
    _small_batches(spark)
    model = langid.fit(docs)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text")
    kept = langid.identify(packed, model, "text", ("row", "text")).where(
        (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    label = F.when(F.col("row.lang").isNull() | (F.col("score") >= SURE), F.col("lang_pred")).otherwise(F.col("row.lang"))
    new = {"lang": label.alias("lang"), "text": F.col("text")}
    return kept.select(*(new[c] if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; rows that repeat an id and a text count as one.

    Groups are of texts: an id with two different texts keeps a row of each, unless it copies a smaller id's.  Of the documents
    without an id one of each group stays, beside that with an id.
    """
    _small_batches(spark)
    key = lambda row, text: F.struct(F.coalesce(row, F.lit(0).cast("long")).alias("id"), row.isNull().alias("null"), text.alias("print"))
    go = simhash.superfluous(docs, words=3, distance=3).select(key(F.col("id"), F.col("text_hash")).alias("key"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", key(F.col("row.doc_id").cast("long"), F.xxhash64(F.col("row.text").cast("string"))).alias("key"))
    return rows.join(go, "key", "left_anti").dropDuplicates(["key"]).select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by the name of its kind; no document goes, ``n_chars`` follows the text."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text")
    found = pii.redact(pii.find_spans(packed, "row"), "row")
    rows = found.select("text", "row.*")
    return _same(rows, docs, n_chars=F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reads every document at least once and those of small sources again, until the mixture has the target entropy or the repetition limit holds."""
    _, heads, _ = mixing.mix(docs, entropy=ENTROPY, repetition=REPETITION)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source")
    rows = mixing.with_copies(packed, heads)
    # Sources without a single token have no weight; their documents are read once like all.
    times = F.sequence(F.lit(1), F.greatest("copies", F.lit(1).cast("long")).cast("int"))
    return rows.select("row", F.explode(times).alias("n")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every document read."""
    _small_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("simhash_dedup", simhash_dedup), ("personal_data", personal_data), ("mixture", mixture),
    ("tokens", tokens)]

#: The first stage learns from the corpus, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    folder = f"{warc.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}-{name}")
        docs = spark.read.parquet(f"{folder}/{n}-{name}")
    return docs
