import binascii
import hashlib
import heapq
import random
import re

import pytest

from panelcast.llm import repair
from panelcast.llm.queries import damaged, op12_conversation_repair

GRAMMAR = re.compile("(s?(ua)+)?")
FAULTS = {"sound": 0, "blank": 1, "duplicate": 2, "truncated": 3}


def brute(rows):
    """(cost, audit, turns) of (role, text, fault) rows: all prefixes in order of (cost, audit), judged as a whole by the grammar."""
    n = len(rows)
    queue, best = [(0, "", 0, "", ())], None
    done = set()
    while queue:
        cost, audit, i, initials, turns = heapq.heappop(queue)
        if i == n and GRAMMAR.fullmatch(initials):
            return cost, audit, list(turns)
        if not any(GRAMMAR.fullmatch(initials + rest) for rest in ("", "a", "ua")):
            continue
        tail = (i, initials[-1:], len(initials) == 0)
        if (tail, cost, audit) in done:
            continue
        done.add((tail, cost, audit))
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 5, audit + "I", i, initials + role[0], (*turns, (role, ""))))
        if i < n:
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, initials, turns))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, initials + (role[:1] or "-"), (*turns, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, initials + new[0], (*turns, (new, text))))
    return best


def spread(rows):
    """Damage of the query, in plain Python."""
    out = []
    for conv, turn, role, text in rows:
        kind = binascii.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def report(rows):
    """conv_id -> expected row, from damaged rows."""
    found = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        seen, marked = set(), []
        for _, _, role, text in mine:
            said = re.sub("[\x20\x09-\x0d]", "", text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "sound"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, new = brute(marked)
        counts = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in new).encode()).hexdigest())
    return found


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_search_matches_brute_force():
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "", "sudo"]
    for n in range(700):
        weights = rng.choice([(1, 5, 5, 0, 0, 0), (4, 4, 4, 1, 1, 1), (6, 1, 1, 0, 0, 0)])
        rows = [(rng.choices(roles, weights)[0], f"t{k}", rng.choices(list(FAULTS), (8, 1, 1, 2))[0]) for k in range(rng.randint(0, 7))]
        codes = bytes(repair.code(r[:1], FAULTS[f]) for r, _, f in rows)
        cost, audit, turns = brute(rows)
        assert repair.cheapest_edits(codes) == (cost, audit), rows
        new_roles, texts, _ = repair.apply_edits(audit, [r for r, *_ in rows], [t for _, t, _ in rows])
        assert list(zip(new_roles, texts)) == turns


def test_bounds_are_admissible():
    rng = random.Random(6)
    for _ in range(150):
        codes = bytes(rng.randrange(16) for _ in range(rng.randint(0, 6)))
        assert repair.suffix_bounds(codes)[2][0] <= repair.cheapest_edits(codes)[0]


def test_search_is_linear_in_long_conversations():
    rng = random.Random(7)
    codes = bytes(rng.choices([4, 8, 12, 0, 11, 15, 9], (1, 9, 9, 1, 1, 1, 1))[0] for _ in range(60_000))
    cost, audit = repair.cheapest_edits(codes)
    assert len(audit) >= 60_000 and cost > 0


@pytest.mark.parametrize("chars", [1 << 20, 30])
def test_repair_matches_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(repair, "SEGMENT_CHARS", chars)
    rng = random.Random(8)
    texts = ["Hi.", "Go on!", "cut", "", None, "Why? ", " \t", "é.", "long " * 30 + "."]
    rows = [(rng.choice([1, 2, 3, 4, 5, 6, None]), rng.choice([None, *range(9)]), rng.choice(["system", "user", "assistant", "tool", None, ""]), rng.choice(texts))
            for _ in range(60)]
    rows += [(20, t, r, f"{r} {t}.") for t, r in enumerate(["system", *["user", "assistant"] * 4])] + [(21, 3, "user", "same.")] * 5
    rows += [(c, t, r, f"{c} {t}.") for c in range(30, 60) for t, r in enumerate(["user", "assistant"])]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(6)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    plans, turns = repair.repair(df)
    digests = {r.conv_id: r.repaired_sha256 for r in repair.digest_turns(turns).collect()}
    got = {r.conv_id: (*(r[c] for c in COLUMNS[:-1]), digests[r.conv_id]) for r in plans.collect()}
    assert got == report(plain)

    path = f"/tmp/repair-{random.random()}"
    df.write.parquet(f"{path}/conversations.parquet")
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in op12_conversation_repair(spark, path).collect()}
    want = report(spread(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found == {c: want.get(c, nothing) for c in {r[0] for r in rows}}
    assert sorted(map(str, (tuple(r) for r in damaged(df).collect()))) == sorted(map(str, spread(rows)))


def test_query_matches_brute_force_on_the_test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in op12_conversation_repair(spark, "/root/testdata/sf0.001").collect()}
    want = report(spread(rows))
    assert got == {c: want.get(c, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())) for c in {r[0] for r in rows}}


def test_empty_table(spark):
    plans, turns = repair.repair(spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert plans.collect() == [] and turns.collect() == [] and repair.digest_turns(turns).collect() == []
