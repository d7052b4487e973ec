"""Repair of conversation structure: the cheapest edits that make the roles alternate, by branch and bound."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelcast.operators.sizing import cut_lineage

DELETE, INSERT, KEEP, REROLE = "DIKR"
COSTS = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
#: Added for a truncated row that stays.
TRUNCATED_COST = 5
#: What a search state has behind it: nothing, a system row, a user row (an assistant must follow), an assistant row (it may end).
START, SYSTEM, USER, ASSISTANT = range(4)
#: Faults of a row, in the order in which they count.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
#: Characters or rows after which a conversation goes on in another segment.
SEGMENT_CHARS, SEGMENT_ROWS = 1 << 20, 1 << 16
#: Unreachable.
NEVER = 1 << 60


def code(initial: str, fault: int) -> int:
    """One byte that says all the search needs to know of a row: s, u, a or other, and its fault."""
    return (INITIALS.find(initial) + 1 if initial else 0) << 2 | fault


def _stay_cost(fault: int) -> int:
    """What a row costs besides its edit if it stays."""
    return NEVER if fault in (BLANK, DUPLICATE) else TRUNCATED_COST if fault == TRUNCATED else 0


def _after_row(state: int, row: int) -> Iterator[tuple[str, int, int]]:
    """(edit, next state, cost) of what can become of a row, edits in ASCII order."""
    initial, stay = row >> 2, _stay_cost(row & 3)
    yield DELETE, state, COSTS[DELETE]
    if stay < NEVER:
        wanted = ASSISTANT if state == USER else USER
        if initial == wanted:
            yield KEEP, wanted, COSTS[KEEP] + stay
        elif initial == SYSTEM and state == START:
            yield KEEP, SYSTEM, COSTS[KEEP] + stay
        yield REROLE, wanted, COSTS[REROLE] + stay


def suffix_bounds(codes: bytes) -> tuple[list[int], list[int], list[int]]:
    """Lower bounds of the cost of rows i.. for a state that waits for a user row, for one that waits for an assistant, and for the start.

    They belong to a relaxed problem with fewer states, in which a conversation may end after a system row as after an assistant row.
    """
    insert = COSTS[INSERT]
    user, assistant, start = [0], [insert], [0]
    for row in reversed(codes):
        initial, stay = row >> 2, _stay_cost(row & 3)
        gone = COSTS[DELETE]
        on, back, begin = user[-1], assistant[-1], start[-1]
        # As a user row, and as an assistant row: kept or given another role.
        u = gone + on if stay == NEVER else min(gone + on, stay + (initial != USER) * COSTS[REROLE] + back)
        a = gone + back if stay == NEVER else min(gone + back, stay + (initial != ASSISTANT) * COSTS[REROLE] + on)
        # A row may be put in before this one.
        u, a = min(u, insert + a), min(a, insert + u)
        s = min(u, gone + begin)
        if initial == SYSTEM and stay < NEVER:
            s = min(s, stay + on)
        user.append(u)
        assistant.append(a)
        start.append(s)
    return user[::-1], assistant[::-1], start[::-1]


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """(cost, edits) of the cheapest edits after which the role initials read ``(s?(ua)+)?``; of several the first in ASCII order.

    Depth-first search with an explicit stack.  A node is (rows done, state).  Edits are tried in ASCII order, so prefixes are met in that
    order too: one that reaches a node no cheaper than an earlier one is dominated by it, and a whole solution no cheaper
    than the incumbent can't replace it.  A prefix is also left when its cost and the bound of the rest exceed the incumbent's cost.  The first
    incumbent, which has a cost only, comes from a dive along the bounds.
    """
    n = len(codes)
    user, assistant, start = suffix_bounds(codes)
    bound = (start, user, assistant, user)

    def moves(i: int, state: int) -> list[tuple[str, int, int, int]]:
        """(edit, rows done, state, cost) in ASCII order."""
        put = (INSERT, i, ASSISTANT if state == USER else USER, COSTS[INSERT])
        if i == n:
            return [] if state in (START, ASSISTANT) else [put]
        after = [(edit, i + 1, s, cost) for edit, s, cost in _after_row(state, codes[i])]
        return [after[0], put, *after[1:]]

    i, state, best = 0, START, 0
    while options := moves(i, state):
        _, i, state, cost = min(options, key=lambda m: (m[3] + bound[m[2]][m[1]], m[1] == i))
        best += cost
    found: str | None = None

    seen = [NEVER] * (4 * (n + 1))
    edits: list[str] = []
    stack = [(0, "", 0, START, 0)]
    while stack:
        depth, edit, i, state, cost = stack.pop()
        least = cost + bound[state][i]
        if least > best or (found is not None and least == best) or cost >= seen[4 * i + state]:
            continue
        seen[4 * i + state] = cost
        del edits[depth - 1 if depth else 0:]
        if edit:
            edits.append(edit)
        if i == n and state in (START, ASSISTANT):
            best, found = cost, "".join(edits)
            continue
        for edit, i2, state2, more in reversed(moves(i, state)):
            stack.append((depth + 1, edit, i2, state2, cost + more))
    assert found is not None
    return best, found


def apply_edits(edits: str, roles: list[str], texts: list[str], state: int = START) -> tuple[list[str], list[str], int]:
    """The roles and texts that edits make of rows, and the state they end in."""
    new_roles, new_texts, at = [], [], 0
    for edit in edits:
        if edit == DELETE:
            at += 1
            continue
        wanted = ASSISTANT if state == USER else USER
        if edit == KEEP:
            role = roles[at]
            state = SYSTEM if role[:1] == "s" else wanted
        else:
            role, state = ("user" if wanted == USER else "assistant"), wanted
        new_roles.append(role)
        new_texts.append("" if edit == INSERT else texts[at])
        at += edit != INSERT
    return new_roles, new_texts, state


def row_faults(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, digest, fault): rows with the first fault of each, as far as it shows without order among equal rows.

    A null role or text is one space.  Blank: nothing but ``[\\x20\\x09-\\x0D]``.  Duplicate: an earlier turn of the conversation has the same role and
    text, compared by their SHA-256; rows that repeat within one turn are told apart later.  Truncated: the last character that is not one of those is
    none of ``.!?``.  Turns are counted by (conversation, role, digest) before any shuffle; only texts that repeat are joined back.
    """
    rows = df.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
                     *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(name) for c, name in ((role, "role"), (text, "text"))))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    firsts = (rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
              .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
             .when(F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)), DUPLICATE)
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z"), TRUNCATED).otherwise(SOUND))
    return rows.select("conv_id", "turn", "role", "text", "digest", fault.alias("fault"))


def _segment_schema(conv_type: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", conv_type), ("segment", pa.int64()), ("codes", pa.binary()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
                      ("turns", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def segments(faults: DataFrame) -> DataFrame:
    """Runs of rows of one conversation in order, bounded in characters and rows; segment numbers follow the order.

    Rows are ordered by turn, nulls first, then role and digest, and dealt by range of these, so a conversation with a third of
    all rows is spread over many tasks.  Equal rows of one turn always meet in one task, where all but the first become duplicates.
    """
    kind = faults.schema["conv_id"].dataType
    schema = _segment_schema(to_arrow_type(kind))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, chars = TaskContext.get().partitionId(), 0, 0
        before: tuple | None = None
        now: dict | None = None

        def close() -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_pylist([{**now, "segment": part << 32 | made - 1, "codes": bytes(now["codes"])}], schema)

        for batch in batches:
            for conv, turn, role, text, digest, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if fault != BLANK and before == (conv, turn, role, digest):
                    fault = DUPLICATE
                if now and (now["conv_id"] != conv or chars >= SEGMENT_CHARS or len(now["codes"]) >= SEGMENT_ROWS):
                    yield close()
                    now = None
                if now is None:
                    now, chars = {"conv_id": conv, "codes": bytearray(), "first_turn": None, "last_turn": None, "turns": 0, "roles": [], "texts": []}, 0
                if turn is not None and turn != now["last_turn"]:
                    now["first_turn"] = turn if now["first_turn"] is None else now["first_turn"]
                    now["last_turn"] = turn
                    now["turns"] += 1
                now["codes"].append(code(role[:1], fault))
                now["roles"].append(role)
                now["texts"].append(text)
                chars += len(text) + len(role)
                before = (conv, turn, role, digest)
        if now:
            yield close()

    order = ["conv_id", "turn", "role", "digest"]
    return cut_lineage(
        faults.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "digest", "fault").mapInArrow(
            cut, f"conv_id {kind.simpleString()}, segment long, codes binary, first_turn long, last_turn long, turns long, "
                 "roles array<string>, texts array<string>"))


def plan_edits(cut: DataFrame) -> DataFrame:
    """Per conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, pieces).

    ``pieces`` says for each segment which edits are its own and the state before them.  A conversation comes as one byte a row, and no text with it.
    """
    kind = cut.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                        ("audit", pa.string()),
                        ("pieces", pa.list_(pa.struct([("segment", pa.int64()), ("edits", pa.string()), ("state", pa.int32())])))])

    def solve(conv: object, parts: list[tuple]) -> dict:
        codes = b"".join(p[1] for p in parts)
        first = last = None
        turns = 0
        for _, _, low, high, n in parts:
            if low is not None:
                turns += n - (low == last)
                first, last = (low if first is None else first), high
        pairs = zip(codes, codes[1:])
        initials = "\0" + INITIALS
        illegal = sum(initials[a >> 2] + initials[b >> 2] not in LEGAL for a, b in pairs)
        cost, audit = cheapest_edits(codes)
        pieces, at, state = [], 0, START
        for k, (segment, own, *_) in enumerate(parts):
            stop, left = at, len(own)
            while left:
                left -= audit[stop] != INSERT
                stop += 1
            stop = len(audit) if k == len(parts) - 1 else stop
            pieces.append({"segment": segment, "edits": audit[at:stop], "state": state})
            state = _end_state(audit[at:stop], own, state)
            at = stop
        return {"conv_id": conv, "gaps": last - first + 1 - turns if turns else 0, **{
            name: sum(c & 3 == fault for c in codes) for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))},
            "illegal": illegal, "cost": cost, "audit": audit, "pieces": pieces}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = run
        parts: list[tuple] = []
        done: list[dict] = []
        for batch in batches:
            for c, *part in zip(*(column.to_pylist() for column in batch.columns)):
                if c != conv:
                    if parts:
                        done.append(solve(conv, parts))
                    conv, parts = c, []
                parts.append(tuple(part))
            if len(done) >= 512:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if parts:
            done.append(solve(conv, parts))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    ordered = (cut.select("conv_id", "segment", "codes", "first_turn", "last_turn", "turns").repartition("conv_id")
               .sortWithinPartitions("conv_id", "segment"))
    return cut_lineage(ordered.mapInArrow(
        run, f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
             "pieces array<struct<segment:long,edits:string,state:int>>"))


def _end_state(edits: str, codes: bytes, state: int) -> int:
    """The state after a piece of edits."""
    at = 0
    for edit in edits:
        if edit != DELETE:
            kept_system = edit == KEEP and codes[at] >> 2 == SYSTEM
            state = SYSTEM if kept_system else ASSISTANT if state == USER else USER
        at += edit != INSERT
    return state


def repaired_segments(cut: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, segment, roles, texts): what the edits make of each segment; one left without a row has empty arrays."""
    kind = cut.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("segment", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                (row,) = batch.slice(k, 1).to_pylist()
                roles, texts, _ = apply_edits(row["edits"], row["roles"], row["texts"], row["state"])
                yield pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], "segment": row["segment"], "roles": roles, "texts": texts}], schema)

    pieces = plans.select(F.explode("pieces").alias("p")).select("p.segment", "p.edits", "p.state")
    return cut.select("conv_id", "segment", "roles", "texts").join(pieces, "segment").mapInArrow(
        mend, f"conv_id {kind.simpleString()}, segment long, roles array<string>, texts array<string>")


def digest_turns(mended: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of ``role:text`` of all turns joined by line feeds.

    Such a digest is sequential: the segments of a conversation stream through one task, which holds one of them.
    """
    import hashlib

    kind = mended.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = run
        state, begun = None, False
        done: list[dict] = []
        for batch in batches:
            for c, roles, texts in zip(*(column.to_pylist() for column in batch.columns)):
                if c != conv:
                    if state:
                        done.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
                    conv, state, begun = c, hashlib.sha256(), False
                for role, text in zip(roles, texts):
                    state.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
            if len(done) >= 512:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if state:
            done.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    ordered = mended.repartition("conv_id").sortWithinPartitions("conv_id", "segment").select("conv_id", "roles", "texts")
    return ordered.mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(plans, turns): the faults and cheapest edits of every conversation, and the conversations they make, in segments.

    Rows are taken by turn, nulls first, those of one turn by role and digest of the text.  Blank and duplicate rows must go; the roles of what is left must begin
    ``s?(ua)+`` by their first letters, or nothing may be left.  ``gaps`` counts turn numbers missing between the first and
    the last, ``illegal`` neighbours whose initials are none of su, ua, au.  Null roles and texts are one space; rows without a
    conversation id are one conversation; repeated rows are duplicates; an empty table gives no rows; other columns of any name are not
    looked at.  The search gets one byte a row and takes some hundred bytes a row of one conversation; every other step holds a segment.
    """
    cut = segments(row_faults(df, conv, turn, role, text))
    plans = plan_edits(cut)
    return plans, repaired_segments(cut, plans)
