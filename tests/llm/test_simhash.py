import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelcast.llm import simhash
from panelcast.llm.graph import components


def slow(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, near):
    label = dict(zip(nodes, nodes))
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if label[b] < label[a] and near(a, b):
                    label[a], changed = label[b], True
    return label


def test_fingerprint(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    random.seed(2)
    for text in [None, "", " \t\n", "One", "one  two", "ÀB c\x0bd\x1ce f\xa0g", "a b c " * 40,
                 *(" ".join(random.choice("abcXYZé") * random.randint(1, 3) for _ in range(random.randint(1, 60))) for _ in range(40))]:
        assert simhash.fingerprint(text) == slow(text)


@pytest.mark.parametrize("dense", [512, 1])
def test_classes_match_brute_force(spark, dense):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(150)] for _ in range(8)]
    rows = []
    for n in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            words[rng.randrange(150)] = f"x{rng.randint(0, 9)}"
        rows.append((n, " ".join(words), "clash"))
    rows += [(500, None, ""), (501, "", ""), (502, " \n", ""), (7, rows[7][1], ""), (None, rows[9][1], ""), (None, "alone with no id at all", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(6)
    got = simhash.near_duplicates(docs, dense=dense).collect()
    prints = {(i, t): slow(t) for i, t, _ in rows}
    points = {}
    for (i, _), f in prints.items():
        if i is not None:
            points[f] = min(i, points.get(f, i))
    want = classes(sorted(points.values()), lambda a, b, back={v: k for k, v in points.items()}: (back[a] ^ back[b]).bit_count() <= 3)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(
        ((i, f"{f:016x}", want.get(points.get(f))) for (i, t), f in ((k, prints[k]) for k in ((r[0], r[1]) for r in rows))), key=str)
    assert len({r.component_id for r in got}) < 100


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
@pytest.mark.parametrize("dense", [3, 10_000])
def test_links_join_what_all_pairs_join(spark, distance, dense):
    rng = random.Random(distance)
    found = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            f = centre
            for _ in range(rng.randint(0, 3)):
                f ^= 1 << rng.randrange(64 if rng.random() < 0.5 else 32)
            found.add(f)
    prints = dict(enumerate(sorted(found)))
    points = spark.createDataFrame([(n, int(np.uint64(f).astype(np.int64))) for n, f in prints.items()], "node long, fp long")
    got = {r.node: r.component for r in components(simhash.fingerprint_links(points, distance, dense)).collect()}
    want = classes(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= distance)
    assert {n: got.get(n, n) for n in prints} == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(n, n + 1) for n in range(100, 180)] + [(5, n) for n in range(1000, 1300)] + [(7, 7), (None, 3), (180, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{n: 100 for n in range(100, 181)}, 5: 5, **{n: 5 for n in range(1000, 1300)}}
    assert components(spark.createDataFrame([], "a long, b long")).where(F.lit(True)).collect() == []
