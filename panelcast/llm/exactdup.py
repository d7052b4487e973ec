"""Exact duplicates: rows grouped by a 128-bit hash of their text, bytes compared within the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.sizing import SMALL_ROWS, cut_lineage

#: Characters that don't count: blank, tab, line feed, vertical tab, form feed, carriage return.
IGNORED = r"[\x20\x09-\x0D]+"


def normalised(text: Column, ignored: str = IGNORED) -> Column:
    """The characters of a text that count; of null none."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), ignored, "")


def content_hash(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text))


def _small(keys: DataFrame, max_rows: int) -> DataFrame:
    """Written keys, marked for broadcast if counted to be few."""
    keys = cut_lineage(keys)
    return F.broadcast(keys) if keys.count() <= max_rows else keys


def collided(texts: DataFrame, prints: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """(hash) of those groups whose texts are not all the same bytes.

    ``texts`` has (hash, text), ``prints`` the hashes of the same rows.  Only texts whose hash occurs again are compared: grouped by hash
    and text, so that Spark's aggregation compares them byte by byte, and the copies of one text collapse where they are read, however many there are.
    The hashes that occur again are broadcast up to ``max_rows`` of them, joined by shuffle beyond.
    """
    again = prints.groupBy("hash").count().where("count > 1").select("hash")
    different = texts.join(_small(again, max_rows), "hash", "left_semi").groupBy("hash", "text").agg(F.lit(1).alias("one"))
    return different.groupBy("hash").agg(F.count("one").alias("n")).where("n > 1").select("hash")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ignored: str = IGNORED, longest: bool = True,
                     hash_of: Callable[[Column], Column] = content_hash, max_rows: int = SMALL_ROWS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row; rows whose texts are the same without ``ignored`` form a group.

    Of a group one row stays: with ``longest`` the one with the most code points, then the one with the smallest id; a missing id
    counts as the largest.  A null text is empty, and all empty texts are one group.  Of rows that agree in id, length and normalised text
    exactly one is kept, so every group keeps exactly one row.  ``text_sha256`` is of the normalised text.
    An empty table gives no rows; other columns of any name are not looked at.

    Texts are read twice.  First each becomes a row of hash, length and id, written to the checkpoint folder; only those are shuffled.
    Then the bytes of texts whose hash occurs again are compared (see ``collided``); if a hash stands for different texts,
    their rows are grouped by the text itself.  Counts and the row that stays are aggregated before the shuffle, so a group may hold
    any share of the rows; the join that hands them back is split by the adaptive skew join.
    """
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("original"))
    texts = texts.select("id", normalised(F.col("original"), ignored).alias("text"),
                         F.coalesce(F.length("original"), F.lit(0)).cast("long").alias("chars"))
    texts = texts.withColumn("hash", hash_of(F.col("text")))
    prints = cut_lineage(texts.select("hash", "id", "chars", F.sha2("text", 256).alias("text_sha256"), F.lit(None).cast("string").alias("exact")))
    few = _small(collided(texts.select("hash", "text"), prints.select("hash"), max_rows), max_rows)
    if not few.isEmpty():
        apart = texts.join(few, "hash", "left_semi").select("hash", "id", "chars", F.sha2("text", 256).alias("text_sha256"), F.col("text").alias("exact"))
        prints = prints.join(few, "hash", "left_anti").unionByName(apart)

    # Rows that can't be told apart are one row with a number, until the last step.
    alike = prints.groupBy("hash", "exact", "id", "chars").agg(F.count("*").alias("rows"), F.first("text_sha256").alias("text_sha256"))
    rank = F.struct((-F.col("chars") if longest else F.lit(0).cast("long")).alias("short"), F.col("id").isNull().alias("missing"), "id",
                    F.col("chars").alias("chars"))
    groups = alike.groupBy("hash", "exact").agg(F.min(rank).alias("first"), F.sum("rows").alias("group_size"))
    groups = groups.select(F.col("hash").alias("g_hash"), F.col("exact").alias("g_exact"), F.col("first.id").alias("keep_id"),
                           F.col("first.chars").alias("keep_chars"), "group_size")
    found = alike.join(groups, (F.col("hash") == F.col("g_hash")) & F.col("exact").eqNullSafe(F.col("g_exact")))
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")) & (F.col("copy") == 1)
    return (found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
            .select(F.col("id").alias(id_col), "keep_id", "group_size", stays.alias("kept"), "text_sha256"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; ids must be unique and not null."""
    kept = exact_duplicates(df, id_col, text_col, **how).where("kept").select(F.col(f"`{id_col}`").alias("__kept"))
    return df.join(kept, F.col(f"`{id_col}`") == F.col("__kept"), "left_semi")
