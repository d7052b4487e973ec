import random
import re

import pytest
from pyspark.sql import functions as F

from panelcast.llm import pii

SCHEMA = "doc_id long, text string, spans string"
BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def right(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in hit.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text or "") if right(k, m[0])]


def random_texts():
    rng = random.Random(6)
    bits = ["a@b.c", "a@b", "x.y+z@mail5.example.com", ".", "..", "@", "-", " ", "  ", "+1 (743) 555-3824", "+", "(", ")", "é", "🙂", "\n", "_", "172.16.0.1",
            "256.1.1.1", "1.2.3.4.5", "0001.2.3.4", "7", "42", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004",
            "6011000000000000004", "12345678", "word", "%", "abc.def"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(1500)]


def test_base_spans_match_brute_force(spark):
    texts = random_texts() + ["", None, "a@b.c_d@e.f", "a@b.c.d_e@f.g@h.i", "1.2.3.4.5.6.7.8.9", "4111111111111111 4111111111111111",
                              " ".join(["4111111111111111"] * 2), "me@x.org " * 700, "0" * 20_000, "a" * 20_000, "1." * 9000, "+1" * 9000,
                              "4111111111111111x" * 600 + "é1.2.3.4" * 600]
    docs = spark.createDataFrame([(n, t, "clash") for n, t in enumerate(texts)], SCHEMA).repartition(8)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] for r in pii.find_spans(docs).collect()}
    for n, t in enumerate(texts):
        assert got[n] == brute(t), repr((t or "")[:200])


def found(spark, text):
    row = pii.find_spans(spark.createDataFrame([(1, text, "")], SCHEMA)).first()
    return [(s.kind, text[s.start:s.end], s.score) for s in row.spans]


def test_checksums_and_context(spark):
    assert found(spark, "pay to DE89 3704 0044 0532 0130 00, or GB82WEST12345698765432.") == [
        ("iban", "DE89 3704 0044 0532 0130 00", 0.8), ("iban", "GB82WEST12345698765432", 0.8)]
    assert found(spark, "my iban is GB82WEST12345698765433") == []
    assert found(spark, "the number 123-45-6789") == []
    assert found(spark, "SSN: 123-45-6789, SSN: 000-12-3456") == [("ssn", "123-45-6789", 0.6)]
    assert found(spark, "call (743) 555-3824 now") == [("local_phone", "(743) 555-3824", 0.6)]
    assert found(spark, "part 743-555-3824 now") == []
    assert [s for _, _, s in found(spark, "a@b.org")] == [0.9] and [s for _, _, s in found(spark, "sample a@b.org")] == [0.7]


def test_redaction(spark):
    rows = [(1, "é a@b.org and 1.2.3.4, +1 (743) 555-3824!", ""), (2, None, ""), (3, "nothing", ""), (None, "x@1.2.3.4", ""), (5, "1.2.3.4", "")]
    got = sorted(((r.doc_id, r.text) for r in pii.redact(pii.find_spans(spark.createDataFrame(rows, SCHEMA)), "doc_id").collect()), key=str)
    assert got == sorted([(1, "é <EMAIL> and <IP>, <PHONE>!"), (2, ""), (3, "nothing"), (None, "<EMAIL>"), (5, "<IP>")], key=str)


def test_empty_and_native(spark):
    empty = pii.find_spans(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    plan = pii.redact(empty, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    with pytest.raises(Exception):
        pii.find_spans(empty.select(F.lit(1).alias("doc_id"))).collect()
