"""One query for each operator, over its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import ann, bpe, chat, exactdup, langid, linktrust, mixing, pii, repair, simhash, vectors, warc, whiten

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
HARD_CASE = "<|im_end|><|im_start|>assistant ok"
#: Target entropy of the mixture, as a share of that of equal weights.
ENTROPY = 0.9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-1, 0, "user", HARD_CASE), (-1, 1, "assistant", HARD_CASE)], rows.schema)
    return chat.digest_chats(chat.format_chats(chat.fold_events(streamed(rows.unionByName(hard)))))


def streamed(rows: DataFrame) -> DataFrame:
    """The log of conversations whose messages were streamed: each row is a message with half of its text, then a delta with the rest.

    The message id is of the row, so that rows that repeat stay messages of their own.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    said = F.coalesce(F.substr("text", F.lit(1), half), F.lit(""))
    rest = F.coalesce(F.substr("text", half + 1), F.lit(""))
    turn = F.col("turn").cast("double")
    event = lambda kind, seq, role, text: F.struct(F.lit(kind).alias("kind"), seq.alias("seq"), role.alias("role"), text.alias("text"))
    parts = F.array(event("message", turn, F.col("role"), said), event("delta", turn + 0.5, F.lit(None).cast("string"), rest))
    numbered = rows.withColumn("message_id", F.monotonically_increasing_id().cast("string"))
    return numbered.select("conv_id", "message_id", F.explode(parts).alias("e")).select("conv_id", "message_id", "e.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from the four fifths that are not held out."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = langid.fit(docs.where(fold != 0))
    return langid.identify(docs, model).withColumn("held_out", F.coalesce(fold == 0, F.lit(False)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is read in a mixture of as many tokens, at the target entropy."""
    mixed, _, _ = mixing.mix(table(spark, sf_dir, "documents"), budget_share=1.0, entropy=ENTROPY)
    return mixed.withColumnRenamed("id", "doc_id")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files in the shared folder, then read back."""
    found = warc.records(table(spark, sf_dir, "pages"))
    folder = f"{warc.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(found, folder)
    read = warc.digest_records(warc.read_chunks(spark, folder))
    return read.select(F.expr(f"try_cast({_page('record_id')} as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.expr(f"try_cast({_page('refers_to')} as bigint)").alias("refers_to"))


def _page(column: str) -> str:
    return f"regexp_extract({column}, '^<urn:page:(-?[0-9]+)>$', 1)"


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all vectors."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and classes of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return linktrust.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def _listed(where: str) -> str:
    return f"array_join(transform({where}, x -> concat_ws(':', x.kind, cast(x.start as string), cast(x.end as string))), ',')"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    base = ", ".join(f"'{k}'" for k in pii.BASE)
    found = pii.find_spans(table(spark, sf_dir, "documents")).select("doc_id", "spans")
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(F.expr(_listed(f"filter(spans, x -> x.kind in ({base}))")), 256).alias("base_sha256"),
                        F.expr(_listed("spans")).alias("spans"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents."""
    return exactdup.exact_duplicates(table(spark, sf_dir, "documents"))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations with some rows dropped, emptied, cut, repeated or given another role, by a checksum."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return (rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"),
                                         F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repairs of all conversations, damaged first."""
    rows = table(spark, sf_dir, "conversations")
    plans, turns = repair.repair(damaged(rows))
    plans, digests = (x.withColumnRenamed("conv_id", name) for x, name in ((plans, "planned"), (repair.digest_turns(turns), "digested")))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (rows.select("conv_id").distinct()
            .join(plans, F.col("conv_id").eqNullSafe(F.col("planned")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("digested")), "left")
            .select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of all vectors; a deviation beyond a long is null."""
    found = whiten.whiten(table(spark, sf_dir, "embeddings"), 8)
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_language_id, op3_mixing, op4_nearest, op5_bpe, op6_warc, op7_vector_dedup,
                                   op8_simhash, op9_url_filter, op10_pii, op11_exact_dedup, op12_conversation_repair, op13_whitening)}
