import hashlib

import pytest
from pyspark.sql import functions as F

from panelcast.llm import chat

EVENTS = "conv_id long, seq long, message_id string, kind string, role string, text string"
MESSAGES = "conv_id long, position long, role string, text string"


def joined(formatted):
    rows = formatted.orderBy("conv_id", "part", "segment").collect()
    out = {}
    for r in rows:
        text, masked = out.get(r.conv_id, ("", ""))
        out[r.conv_id] = (text + r.text, masked + "".join(chat.unescape(r.text[s.start:s.end]) for s in r.loss))
    return out


def test_deltas_edits_and_regenerations_fold(spark):
    rows = [(1, 1, "u", "message", "user", "helo"), (1, 2, "a", "message", "assistant", "First"), (1, 3, "a", "delta", None, " an"),
            (1, 4, "a", "delta", None, "swer"), (1, 5, "u", "edit", None, "hello"), (1, 6, "a", "regenerate", None, None),
            (1, 7, "a", "delta", None, "Second"), (1, 7, "a", "delta", None, "Second"), (1, 8, "x", "delta", "tool", "only deltas"),
            (2, 1, None, None, None, None)]
    found = chat.fold_events(spark.createDataFrame(rows, EVENTS)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(1, 1, "user", "hello"), (1, 2, "assistant", "SecondSecond"), (1, 8, "tool", "only deltas"), (2, 1, None, "")], key=str)


def test_an_unknown_event_is_an_error(spark):
    with pytest.raises(Exception, match="unknown event kind"):
        chat.fold_events(spark.createDataFrame([(1, 1, "u", "explode", "user", "x")], EVENTS)).collect()


def test_control_strings_are_escaped_and_read_back(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "\\<|", "a\\n\nb", "<<||", "", "\\\\<|im_end|>\n"]
    rows = [(1, n, ("user", "assistant", "odd\nrole\\n<|")[n % 3], t) for n, t in enumerate(hard)] + [(1, 99, None, None)]
    formatted = chat.format_chats(spark.createDataFrame(rows, MESSAGES))
    text, masked = joined(formatted)[1]
    assert list(chat.read_turns(text)) == [(r or "", t or "") for _, _, r, t in rows]
    assert masked == "".join(t for _, _, r, t in rows if r == "assistant")
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(rows)


def test_digests_of_long_and_repeated_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT_CHARS", 50)
    rows = [(c, n, "assistant" if n % 2 else "user", f"turn {n} of {c} é" * (n % 4)) for c in (1, 2) for n in range(200)]
    rows += [(2, 7, "user", "again"), (2, 7, "user", "again"), (None, 1, "assistant", "no id")]
    found = {r.conv_id: r for r in chat.digest_chats(chat.format_chats(spark.createDataFrame(rows, MESSAGES).repartition(5))).collect()}
    for c in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: r[1:])
        assert found[c].n_turns == len(mine)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in mine).encode()).hexdigest()
        said = "".join(t for _, _, r, t in mine if r == "assistant")
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert found[c].formatted_chars == sum(len(f"<|im_start|>{r}\n{t}<|im_end|>\n") for _, _, r, t in mine)


def test_an_empty_log_gives_nothing_and_other_columns_are_ignored(spark):
    empty = spark.createDataFrame([], EVENTS).withColumn("position", F.lit(1)).withColumn("turn", F.lit("x"))
    assert chat.digest_chats(chat.format_chats(chat.fold_events(empty))).collect() == []
