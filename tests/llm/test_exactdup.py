import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from panelcast.llm.exactdup import drop_exact_duplicates, exact_duplicates


def brute(rows):
    """Expected rows as a sorted list."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0))
    out = []
    for norm, members in groups.items():
        members.sort()
        keep = None if members[0][1] else members[0][2]
        for n, (_, missing, i) in enumerate(members):
            out.append((None if missing else i, keep, len(members), n == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, **how):
    return sorted((tuple(r) for r in exact_duplicates(df, **how).collect()), key=str)


HARD = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " \x0b"), (7, "a\xa0b"), (8, "é e"), (9, "ée"), (9, "ée"), (None, "ée  "),
        (None, "alone"), (10, "x" * 300_000), (11, "x " * 300_000), (12, "ab\x1c"), (1, "a b"), (13, "\U0001f600 \U0001f600"), (14, "\U0001f600\U0001f600")]


def test_hard_cases(spark):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in HARD], "doc_id long, text string, keep_id string, hash int").repartition(5)
    assert result(df) == brute(HARD)


@pytest.mark.parametrize("max_rows", [50_000, 1])
def test_collisions_are_told_apart(spark, max_rows):
    rng = random.Random(3)
    rows = [(n, rng.choice("abcde") * rng.randint(0, 3) + " " * rng.randint(0, 4)) for n in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    weak = lambda text: F.substring(F.md5(text), 1, 1)
    assert result(df, hash_of=weak, max_rows=max_rows) == brute(rows)
    assert result(df, hash_of=lambda text: F.lit("same"), max_rows=max_rows) == brute(rows)


def test_smallest_id_without_lengths(spark):
    df = spark.createDataFrame([(5, "a"), (6, "a  "), (4, " b"), (3, "b")], "doc_id long, text string")
    assert {r.doc_id for r in exact_duplicates(df, longest=False).where("kept").collect()} == {5, 3}


def test_drop_keeps_all_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "k"), (2, "a ", "l")], "doc_id long, text string, kept string")
    assert [tuple(r) for r in drop_exact_duplicates(df).collect()] == [(2, "a ", "l")]
    assert exact_duplicates(df.limit(0)).collect() == []


def test_plan_is_native(spark):
    plan = exact_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Pandas" not in plan
