import hashlib
import math

import pytest
from pyspark.sql import functions as F

from panelcast.llm import mixing

SCHEMA = "doc_id long, text string, source string, id string"


def brute(rows, plan, seed=5):
    out = []
    sources = {s for _, _, s, _ in rows}
    for s in sources:
        mine = sorted((int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:12], 16), n, i, len((t or "").split()))
                      for n, (i, t, src, _) in enumerate(rows) if src == s for i in [i])
        reads, rest = divmod(plan.budgets[s], plan.tokens[s]) if s in plan.budgets else (0, 0)
        for draw, _, i, tokens in mine:
            before = sum(t for d, _, _, t in mine if d < draw)
            out.append((i, s, tokens, reads + (before < rest)))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [dict(budget_share=1.0, entropy=0.95), dict(repetition=1.5), dict(budget_share=0.3),
                                 dict(budget_share=2.5, entropy=0.9, repetition=6.0)])
def test_copies_match_brute_force(spark, how, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 40)
    rows = [(n, "w " * (n % 7), ("big", "mid", "small", None)[0 if n % 3 else 1 + n // 3 % 3], "clash") for n in range(300)]
    rows += [(5, "two words", "big", "x"), (None, "no id", "big", "y"), (900, None, "empty", "z"), (901, "", "empty", "z")]
    mixed, heads, plan = mixing.mix(spark.createDataFrame(rows, SCHEMA), **how)
    got = sorted((tuple(r) for r in mixed.select("id", "source", "tokens", "copies").collect()), key=str)
    assert got == brute(rows, plan)
    assert sum(plan.weights.values()) == pytest.approx(1)


def test_solve_meets_its_targets():
    tokens = {"a": 900, "b": 90, "c": 10, "none": 0}
    plan = mixing.solve(tokens, 1000, entropy=0.8)
    entropy = -sum(w * math.log(w) for w in plan.weights.values()) / math.log(3)
    assert entropy == pytest.approx(0.8, abs=1e-9) and "none" not in plan.weights
    plan = mixing.solve(tokens, 1000, repetition=4.0)
    assert max(plan.budgets[s] / tokens[s] for s in plan.budgets) == pytest.approx(4, abs=0.06)
    plan = mixing.solve(tokens, repetition=1.25)
    assert plan.budgets["a"] == 900 and plan.budgets["c"] == round(12.5)
    assert mixing.solve(tokens, 1000).weights["a"] == 0.9
    assert mixing.solve({}, 10).budgets == {}


def test_reads_fill_the_budget_and_every_epoch_is_another_permutation(spark):
    docs = spark.createDataFrame([(n, "word " * 10, "s", "") for n in range(50)], SCHEMA)
    mixed, _, plan = mixing.mix(docs, budget_share=2.5)
    reads = mixing.reading_order(mixed)
    assert reads.agg(F.sum("tokens")).first()[0] == 1250
    orders = [[r.id for r in reads.where(F.col("epoch") == e).orderBy("place").collect()] for e in (1, 2)]
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]


def test_an_empty_table(spark):
    mixed, heads, plan = mixing.mix(spark.createDataFrame([], SCHEMA), entropy=0.9, budget_share=1.0)
    assert mixed.collect() == [] and heads == [] and plan.weights == {}
