"""Mixing sources to target weights: temperature, bisection, and budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.sizing import cut_lineage

#: Tokens a block of a permutation aims at; only the block in which a budget ends is ordered row by row.
BLOCK_TOKENS = 1 << 18
STEPS = 60


@dataclass(frozen=True)
class Plan:
    """Exponent and, for each source, tokens, weight and token budget; sources are few, rows are not."""

    exponent: float
    tokens: dict[str | None, int]
    weights: dict[str | None, float]
    budgets: dict[str | None, int]


def _weights(shares: list[float], exponent: float) -> list[float]:
    powers = [s ** exponent for s in shares]
    total = sum(powers)
    return [p / total for p in powers]


def solve(tokens: dict[str | None, int], budget: int | None = None, entropy: float | None = None, repetition: float | None = None) -> Plan:
    """Exponent in [0, 1] by bisection, weights and budgets.

    ``entropy``: the largest exponent whose weights have at least that entropy, as a fraction of that of equal weights.  ``repetition``: the
    smallest exponent with which no source is read more often than that within ``budget`` tokens.  If both are given the larger
    exponent, so the repetition limit, wins.  Without a budget the smallest total is taken that reads every source
    at least once, and repetition is then relative to the source read least.  Sources without tokens get no weight.
    """
    names = sorted((n for n, t in tokens.items() if t > 0), key=lambda n: (n is not None, n))
    total = sum(tokens[n] for n in names)
    if not names:
        return Plan(1.0, tokens, {}, {})
    shares = [tokens[n] / total for n in names]

    def flat_enough(x: float) -> bool:
        weights = _weights(shares, x)
        return -sum(w * math.log(w) for w in weights if w > 0) >= entropy * math.log(len(names))

    def seldom_enough(x: float) -> bool:
        reads = [w / s for w, s in zip(_weights(shares, x), shares)]
        return max(reads) * (budget / total if budget else 1 / min(reads)) <= repetition

    exponent = 1.0
    if entropy is not None and len(names) > 1:
        low, high = 0.0, 1.0  # entropy falls as the exponent rises
        if not flat_enough(high):
            for _ in range(STEPS):
                middle = (low + high) / 2
                low, high = (middle, high) if flat_enough(middle) else (low, middle)
            exponent = low
    elif repetition is not None:
        exponent = 0.0
    if repetition is not None and not seldom_enough(exponent):
        low, high = exponent, 1.0  # repetition falls as the exponent rises
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (low, middle) if seldom_enough(middle) else (middle, high)
        exponent = high
    weights = _weights(shares, exponent)
    whole = budget if budget is not None else max(s / w for s, w in zip(shares, weights)) * total
    # Rounded to full tokens; the last bits of a float power must not decide about one.
    budgets = {n: int(math.floor(w * whole + 0.5)) for n, w in zip(names, weights)}
    return Plan(exponent, dict(tokens), dict(zip(names, weights)), budgets)


def word_count(text: Column) -> Column:
    """Tokens as the mixing counts them: runs of anything but ASCII white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_tokens(docs: DataFrame, source_col: str = "source", tokens_col: str = "tokens") -> dict[str | None, int]:
    """Tokens of each source, summed where they are read: one row per source reaches the driver."""
    return {r.s: int(r.t or 0) for r in docs.groupBy(F.col(source_col).alias("s")).agg(F.sum(tokens_col).alias("t")).collect()}


def _draw(id_col: str, seed: int) -> Column:
    """A row's place in its source's permutation, 48 bits of a hash of id and seed."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long")


def _joined(rows: DataFrame, table: DataFrame, few: int) -> DataFrame:
    """``rows`` with the columns of ``table``, one row per source; sent along if there are at most ``few``."""
    table = table.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(table) if few <= 10_000 else table, F.col("__of").eqNullSafe(F.col("__source")), "left").drop("__source")


_READS = "source string, reads long, rest long, blocks long"
_HEADS = _READS + ", last long, stop long"


def realise(narrow: DataFrame, plan: Plan, id_col: str = "id", source_col: str = "source", tokens_col: str = "tokens",
            seed: int = 5, block_tokens: int = BLOCK_TOKENS) -> list[tuple]:
    """How every source fills its budget: (source, whole reads, rest, blocks, last block, last place).

    A source is read whole as often as its budget allows; the rest goes to the head of one more permutation of its rows.  A
    permutation orders blocks (equal ranges of a hash of id and seed) and rows within them by that hash; rows are taken while the tokens before them
    are fewer than the rest, rows in the same place together.  Blocks are summed first, so only rows of the one
    block in which a budget ends are ordered: no source is sorted as a whole.
    """
    reads = [(n, plan.budgets[n] // t, plan.budgets[n] % t, max(1, t // block_tokens)) for n, t in plan.tokens.items() if n in plan.budgets]
    if not reads:
        return []
    spark = narrow.sparkSession
    rows = narrow.select(F.col(source_col).alias("__of"), F.col(tokens_col).alias("tokens"), _draw(id_col, seed).alias("draw"))
    rows = _joined(rows, spark.createDataFrame(reads, _READS), len(reads)).where("rest > 0").withColumn(
        "block", F.expr("shiftright(draw, 24) * blocks div 16777216"))
    before = Window.partitionBy("__of").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__of", "block").agg(F.sum("tokens").alias("t"), F.max("rest").alias("rest"))
    ends = {r["__of"]: (r.block, r.rest - r.before) for r in sums.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0)))
            .where("before < rest and before + t >= rest").collect()}  # one row per source
    edges = spark.createDataFrame([(n, b, room) for n, (b, room) in ends.items()], "source string, last long, room long")
    inside = (_joined(rows, edges, len(ends)).where("block = last").groupBy("__of", "draw", "room").agg(F.sum("tokens").alias("t")))
    run = Window.partitionBy("__of").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    stops = {r["__of"]: r.stop for r in inside.withColumn("sofar", F.coalesce(F.sum("t").over(run), F.lit(0)))
             .where("sofar < room").groupBy("__of").agg(F.max("draw").alias("stop")).collect()}
    return [(*r, ends[r[0]][0] if r[0] in ends else -1, stops.get(r[0], -1)) for r in reads]


def with_copies(docs: DataFrame, heads: list[tuple], id_col: str = "doc_id", source_col: str = "source", copies_col: str = "copies",
                seed: int = 5) -> DataFrame:
    """``docs`` with the number of times each row is read; sources without weight are read 0 times.  Nothing is shuffled."""
    rows = docs.withColumns({"__of": F.col(source_col), "__draw": _draw(id_col, seed)})
    rows = _joined(rows, docs.sparkSession.createDataFrame(
        heads, _HEADS).select("source", *(F.col(c).alias("__" + c) for c in ("reads", "rest", "blocks", "last", "stop"))), len(heads))
    block = F.expr("shiftright(__draw, 24) * __blocks div 16777216")
    head = (block < F.col("__last")) | ((block == F.col("__last")) & (F.col("__draw") <= F.col("__stop")))
    copies = F.coalesce(F.col("__reads") + F.when((F.col("__rest") > 0) & head, 1).otherwise(0), F.lit(0)).cast("long")
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns if c != copies_col), copies.alias(copies_col))


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", budget_share: float | None = None,
        entropy: float | None = None, repetition: float | None = None, seed: int = 5) -> tuple[DataFrame, list[tuple], Plan]:
    """(id, source, tokens, copies) for every row of ``docs``, the heads behind the copies, and the plan.

    ``budget_share`` is the budget in shares of all tokens; see ``solve`` for the rest.  Null sources are a source of their own,
    a null text has no tokens; rows that repeat an id are read alike; an empty table gives no rows and an empty plan.
    """
    narrow = cut_lineage(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                     word_count(F.col(text_col)).alias("tokens")))
    tokens = source_tokens(narrow)
    budget = None if budget_share is None else int(sum(tokens.values()) * budget_share)
    plan = solve(tokens, budget, entropy, repetition)
    heads = realise(narrow, plan, seed=seed)
    return with_copies(narrow, heads, "id", seed=seed), heads, plan


def reading_order(mixed: DataFrame, id_col: str = "id", source_col: str = "source", seed: int = 5) -> DataFrame:
    """One row per read: ``mixed`` without ``copies``, with ``epoch`` and ``place``; each epoch is another permutation."""
    rows = mixed.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    name = F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return rows.withColumn("place", F.md5(name))
