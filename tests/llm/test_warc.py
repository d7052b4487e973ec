import base64
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from panelcast.llm import warc

SCHEMA = "page_id long, url string, html string, record string"
CUT = warc.BETWEEN


def round_trip(spark, pages, tmp_path, **how):
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archive(warc.records(pages, **how), folder)
    return folder, warc.read_chunks(spark, folder)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("chunk_chars", [1 << 20, 7])
@pytest.mark.parametrize("least", [0, 5])
def test_archives_read_back(spark, tmp_path, chunk_chars, least):
    texts = ["WARC/1.1", "x\r\n\r\nWARC/1.1", "\r\n\r\nW", "<html>é</html>", "<html>é</html>", None, "", CUT, "a" + CUT + CUT + "b", "\r\n\r\n", "x\r\n", "WARC/1.1\r\n", "\r\n\r\nWARC/1.1\r", "ab",
             "long " * 30, "🙂" * 9, "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "ab", "<html>é</html>"]
    rows = [(n, f"http://a.b/{n}\r\n%0D" if n % 2 else None, t, "clash") for n, t in enumerate(texts)]
    folder, chunks = round_trip(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), tmp_path, chunk_chars=chunk_chars, least=least)
    got = {r.record_id: r for r in warc.digest_records(chunks).collect()}
    assert len(got) == len(rows)
    for n, t in enumerate(texts):
        r, data = got[f"<urn:page:{n}>"], (t or "").encode()
        same = [m for m, other in enumerate(texts) if (other or "") == (t or "")]
        origin = max(same) if len(data) >= least else n
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(data), digest(t), rows[n][1] or "")
        assert (r.record_type, r.refers_to) == (("response", None) if origin == n else ("revisit", f"<urn:page:{origin}>"))
    longest = chunks.agg(F.max(F.length("data"))).first()[0]
    assert longest <= 4 * chunk_chars
    payloads = {}
    for r in chunks.where("type <> 'revisit'").orderBy("record_id", "serial", "chunk").collect():
        payloads[r.record_id] = payloads.get(r.record_id, b"") + bytes(r.data)
    assert all(v == (texts[int(k[10:-1])] or "").encode() for k, v in payloads.items())


def test_files_are_standard_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 25, ""), (2, None, "y", "")], SCHEMA).coalesce(1)
    folder = f"{tmp_path}/plain"
    warc.write_archive(warc.records(pages, chunk_chars=10), folder, "none")
    left = b"".join(p.read_bytes() for p in (tmp_path / "plain").glob("part-*"))
    kinds = []
    while left:
        head, _, rest = left.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        headers = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        size = int(headers["Content-Length"])
        assert rest[size:size + 4] == b"\r\n\r\n"
        kinds.append((headers["WARC-Type"], headers.get("WARC-Segment-Number"), rest[:size]))
        left = rest[size + 4:]
    assert sorted(kinds, key=str) == sorted([("response", "1", b"x" * 10), ("continuation", "2", b"x" * 10), ("continuation", "3", b"x" * 5),
                                             ("response", None, b"y")], key=str)


def test_repeated_rows_and_missing_ids(spark, tmp_path):
    rows = [(1, "u", "same text", ""), (1, "u", "same text", ""), (None, "u", "same text", ""), (None, None, "other text", ""), (0, "u", "same text", "")]
    _, chunks = round_trip(spark, spark.createDataFrame(rows, SCHEMA), tmp_path, chunk_chars=4)
    got = sorted((r.record_id, r.record_type, r.refers_to, r.payload_digest) for r in warc.digest_records(chunks).select(
        "record_id", "record_type", F.coalesce("refers_to", F.lit("")).alias("refers_to"), "payload_digest").collect())
    same, other = digest("same text"), digest("other text")
    assert got == sorted([("<urn:page:1>", "response", "", same), ("<urn:page:1>", "response", "", same), ("<urn:page:>", "response", "", same),
                          ("<urn:page:>", "response", "", other), ("<urn:page:0>", "revisit", "<urn:page:1>", same)])


def test_damage_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "some long text", "")], SCHEMA)
    _, chunks = round_trip(spark, pages, tmp_path, chunk_chars=4)
    for bad in (chunks.where("chunk <> 2"), chunks.where("chunk <> 4"), chunks.unionByName(chunks), chunks.withColumn("data", F.lit(b"x"))):
        with pytest.raises(Exception, match="missing|damaged"):
            warc.digest_records(bad).collect()


def test_an_empty_table(spark, tmp_path):
    folder, chunks = round_trip(spark, spark.createDataFrame([], SCHEMA), tmp_path)
    assert warc.digest_records(chunks).collect() == []
