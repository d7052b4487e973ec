"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.graph import components
from panelcast.operators.sizing import cut_lineage

SEED = 42
HALF = 32
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Fingerprints with one 32-bit half in common beyond which links go through midpoints.
DENSE = 512


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 if it has no words.

    A-Z are lower-cased, words end at ASCII white space, shingles count as often as they occur; fewer words
    than ``words`` make one shingle.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    total = len(tokens) - width + 1
    spans = zip(starts[:total].tolist(), ends[width - 1:].tolist())
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for _ in range(0, total, BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in islice(spans, BLOCK)], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, **more: Column) -> DataFrame:
    """(id, fp) per row, and ``more``, longs; ``fp`` is the fingerprint as a signed long.  A null text has no words."""
    names = ["id", "fp", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]], names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       *(c.alias(name) for name, c in more.items())).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _flips(part: str, bits: int) -> str:
    """SQL array of ``part`` and of every value up to ``bits`` flipped bits from it."""
    found = [f"array({part})"]
    if bits >= 1:
        found.append(f"transform(sequence(0, {HALF - 1}), i -> {part} ^ shiftleft(1L, i))")
    if bits >= 2:
        found.append(f"flatten(transform(sequence(0, {HALF - 2}), i -> transform(sequence(i + 1, {HALF - 1}), "
                     f"j -> {part} ^ shiftleft(1L, i) ^ shiftleft(1L, j))))")
    return f"concat({', '.join(found)})"


def _segments(points: DataFrame) -> DataFrame:
    """Two rows per point: each half in turn as ``part``, with the other as ``rest``."""
    low, high = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"
    return points.select("node", "fp", F.expr(
        f"inline(array(struct(0 as seg, {low} as part, {high} as rest), struct(1 as seg, {high} as part, {low} as rest)))"))


def fingerprint_links(points: DataFrame, distance: int = 3, dense: int = DENSE) -> DataFrame:
    """Links (a, b) that join the same points as all pairs of fingerprints at most ``distance`` <= 3 bits apart.

    ``points`` holds distinct (node, fp).  Of two such fingerprints one 32-bit half differs by at most one bit,
    so the ball of radius one around each half is looked up in the table of halves and the full distance verified.
    Where more than ``dense`` fingerprints share a half, pairs are not listed: points that lie
    half the distance, rounded down, and points that lie the rest of it from a common midpoint of the other half meet there, and each gets one link to
    the smallest of the former.  That joins exactly the same points with rows in proportion to the points.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves with a ball of one bit find up to 3 differing bits")
    table = cut_lineage(_segments(points))
    crowded = cut_lineage(table.groupBy("seg", "part").count().where(F.col("count") > dense).select("seg", "part"))
    probes = table.select("node", "fp", "seg", "rest", F.expr(f"explode({_flips('part', min(1, distance))})").alias("part"),
                          F.col("part").alias("own"))
    held = table.select("seg", "part", F.col("node").alias("other"), F.col("fp").alias("other_fp"))
    if (some := crowded.limit(1).count()):
        held = held.join(crowded, ["seg", "part"], "left_anti")
    # A pair whose halves both match is found twice, and from either end; a distinct follows in components().
    pairs = (probes.join(held, ["seg", "part"]).where("node <> other")
             .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) <= distance)
             .select(F.col("node").alias("a"), F.col("other").alias("b")))
    if not some:
        return pairs
    inside = table.join(crowded, ["seg", "part"])
    around = probes.where("part <> own").join(crowded, ["seg", "part"])
    # kind 0: whole distance left for the other half; kind 1: one bit is spent on this half.
    near, far = distance // 2, distance - distance // 2
    spent = distance - 1
    stars = [inside.select("seg", "part", F.lit(0).alias("kind"), "node", F.lit(True).alias("hub"),
                           F.expr(f"explode({_flips('rest', near)})").alias("mid")),
             inside.select("seg", "part", F.lit(0).alias("kind"), "node", F.lit(False).alias("hub"),
                           F.expr(f"explode({_flips('rest', far)})").alias("mid"))]
    if spent >= 0:
        stars += [inside.select("seg", "part", F.lit(1).alias("kind"), "node", F.lit(True).alias("hub"),
                                F.expr(f"explode({_flips('rest', spent // 2)})").alias("mid")),
                  around.select("seg", "part", F.lit(1).alias("kind"), "node", F.lit(False).alias("hub"),
                                F.expr(f"explode({_flips('rest', spent - spent // 2)})").alias("mid"))]
    rows = stars[0]
    for more in stars[1:]:
        rows = rows.unionByName(more)
    rows = cut_lineage(rows)
    key = ["seg", "part", "kind", "mid"]
    hubs = rows.where("hub").groupBy(*key).agg(F.min("node").alias("centre"))
    met = rows.join(hubs, key).where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    return pairs.unionByName(met.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3,
                    dense: int = DENSE) -> DataFrame:
    """(id, fingerprint, component_id) per row: 16 hex digits, and the smallest id reachable by links.

    Equal fingerprints are one point, so copies are never paired.  Null and empty texts have fingerprint zero and link like
    any other; a row without an id gets the component of its fingerprint, null if no row of that fingerprint has an id.
    Repeated rows stay repeated, an empty table gives none, other columns are ignored.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, words))
    points = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("node")).where("node is not null"))
    # One id may carry several texts: such points are one node already.
    joined = components(fingerprint_links(points, distance, dense))
    classes = points.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp", "left").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def superfluous(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3,
                dense: int = DENSE) -> DataFrame:
    """Distinct (id, text_hash) of the rows that are not the one their group keeps; ``text_hash`` is ``xxhash64``.

    Groups are of fingerprints, so an id that stands on several texts doesn't join them.  A group keeps its smallest (id, text_hash),
    and of its rows without an id the smallest text_hash.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, words, text_hash=F.xxhash64(F.col(text_col).cast("string"))))
    named = F.struct("id", "text_hash")
    points = cut_lineage(prints.groupBy("fp").agg(F.min(F.when(F.col("id").isNotNull(), named)).alias("named"),
                                                  F.min(F.when(F.col("id").isNull(), F.col("text_hash"))).alias("nameless")))
    joined = components(fingerprint_links(points.select(F.col("fp").alias("node"), "fp"), distance, dense))
    classes = cut_lineage(points.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
                          .withColumn("component", F.coalesce("component", "fp")))
    best = classes.groupBy("component").agg(F.min("named").alias("named"), F.min("nameless").alias("nameless"))
    kept = classes.select("fp", "component").join(best, "component").drop("component")
    other = F.when(F.col("id").isNull(), F.col("text_hash") != F.col("nameless")).otherwise(named != F.col("named"))
    return prints.join(kept, "fp").where(other).select("id", "text_hash").distinct()
