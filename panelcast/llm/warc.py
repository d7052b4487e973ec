"""WARC archives with segmented records, written and read as Spark text, payloads kept as chunk rows."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.sizing import checked_broadcast, cut_lineage

VERSION = "WARC/1.1"
#: What ends a record, and what stands between two; the latter occurs nowhere else, see ``pieces_of``.
ENDING, BETWEEN = "\r\n\r\n", f"\r\n\r\n{VERSION}\r\n"
#: Characters of a payload in one record; longer ones go on in continuation records.
CHUNK_CHARS = 1 << 20
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def pieces_of(payload: str, chunk_chars: int) -> str:
    """SQL array of the pieces of a payload, of at most ``chunk_chars`` characters, none of which has the whole version in it.

    So the text that stands between two records occurs nowhere else, whatever a piece begins or ends with.
    """
    parts = f"split({payload}, '(?<=W)(?={VERSION[1:].replace('.', '[.]')})')"
    cut = f"transform(sequence(0, greatest(cast(ceil(length(p) / {chunk_chars}) as int), 1) - 1), i -> substr(p, i * {chunk_chars} + 1, {chunk_chars}))"
    return f"if(contains({payload}, '{VERSION}') or length({payload}) > {chunk_chars}, flatten(transform({parts}, p -> {cut})), array({payload}))"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0,
            chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(record): WARC records, one or more for each page.

    Of the pages with equal payloads of at least ``least`` bytes the one with the largest id is a response, the others are revisits
    that refer to it; smaller payloads are all responses.  Payloads beyond ``chunk_chars`` characters become (page, chunk) rows, and segments as
    the standard has them: a first record, then continuations with ascending segment numbers.  Payloads are compared by SHA-1 and length.
    A null payload is empty, a null url an empty target.  Rows without an id become responses nothing refers to.
    All of it is DataFrame expressions: no payload enters Python, and a written row is one chunk.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("payload")).withColumns(
                            {"sha1": F.sha1(F.encode("payload", "utf-8")), "size": F.octet_length("payload").cast("long")})
    # Equal payloads meet by digest only: no payload is shuffled to find them, and a crowded digest is summed where it is read.
    known = cut_lineage(rows.select("id", "url", "sha1", "size").where(F.col("id").isNotNull() & (F.col("size") >= least)))
    shared = known.groupBy("sha1", "size").agg(F.max("id").alias("origin"), F.count("*").alias("n")).where("n > 1")
    revisits = cut_lineage(known.join(shared, ["sha1", "size"]).where("id <> origin").select("id", "url", "sha1", "size", "origin"))
    again = checked_broadcast(revisits.select("id", "sha1", "size").distinct())
    whole = rows.join(again, ["id", "sha1", "size"], "left_anti").withColumn("serial", F.monotonically_increasing_id())
    pieces = whole.selectExpr("id", "url", "sha1", "size", "serial", f"{pieces_of('payload', chunk_chars)} AS pieces")
    chunks = pieces.selectExpr("id", "url", "sha1", "size", "serial", "size(pieces) AS many", "posexplode(pieces) AS (at, piece)")

    page = "concat('<urn:page:', coalesce(cast(id as string), ''), '>')"
    url = "replace(replace(replace(url, '%', '%25'), char(13), '%0D'), char(10), '%0A')"
    always = [("WARC-Record-ID", page), ("WARC-Date", f"'{DATE}'"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"concat('sha1:', {base32_sql('sha1')})")]
    segment = [("WARC-Type", "if(at = 0, 'response', 'continuation')"), ("WARC-Segment-Number", "if(many > 1, at + 1, null)"),
               # The serial keeps rows apart that repeat an id.
               ("X-Serial", "if(many > 1, serial, null)"),
               *((name, f"if(at = 0, {value}, null)") for name, value in always),
               ("WARC-Record-ID", "if(at > 0, concat('<urn:page:', coalesce(cast(id as string), ''), ':', at + 1, '>'), null)"),
               ("WARC-Date", f"if(at > 0, '{DATE}', null)"), ("WARC-Segment-Origin-ID", f"if(at > 0, {page}, null)"),
               ("WARC-Segment-Total-Length", "if(many > 1 and at + 1 = many, size, null)"), ("Content-Length", "octet_length(piece)")]
    revisit = [("WARC-Type", "'revisit'"), *always, ("WARC-Refers-To", "concat('<urn:page:', origin, '>')"),
               ("WARC-Profile", "'http://netpreserve.org/warc/1.1/revisit/identical-payload-digest'"), ("WARC-Payload-Length", "size"), ("Content-Length", "0")]
    return chunks.selectExpr(f"{_record_sql(segment, 'piece')} AS record").unionByName(revisits.selectExpr(f"""{_record_sql(revisit, "''")} AS record"""))


def base32_sql(digest: str) -> str:
    """SQL of the upper-case base32 of 160 bits in hex: each five hex digits are four letters."""
    five = f"cast(conv(substr({digest}, cast(i div 4 * 5 + 1 as int), 5), 16, 10) as long)"
    letter = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((shiftright({five}, cast(15 - i % 4 * 5 as int)) & 31) + 1 as int), 1)"
    return f"array_join(transform(sequence(0, 31), i -> {letter}), '')"


def _record_sql(headers: list[tuple[str, str]], block: str) -> str:
    """SQL of a record: its headers that are not null, an empty line, the block."""
    lines = ", ".join(f"concat('{name}: ', {value})" for name, value in headers)
    return f"concat(concat_ws('\\r\\n', '{VERSION}', {lines}), '\\r\\n\\r\\n', {block})"


def _value(text: str) -> str:
    return re.sub(r"%(25|0D|0A)", lambda m: chr(int(m[1], 16)), text)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches: the one the session checkpoints into."""
    cut_lineage(spark.range(0))
    return spark.sparkContext.getCheckpointDir()


def write_archive(found: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Write records as WARC files into a folder that every executor reaches; an existing one is an error."""
    found.write.option("lineSep", ENDING).option("compression", compression).text(folder)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, serial, chunk, last, type, url, refers_to, digest, total, data): one row for each record of an archive.

    A response is chunk 1, its continuations follow under the id of the response.  A file is cut where one record ends and the next begins; each record's length is checked.
    """
    lines = spark.read.option("lineSep", BETWEEN).text(folder)
    schema = ("record_id string, serial string, chunk long, last boolean, type string, url string, refers_to string, digest string, "
              "total long, data binary")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                rows.append(_parsed(value.as_py()))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema(
                    [("record_id", pa.string()), ("serial", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("type", pa.string()), ("url", pa.string()),
                     ("refers_to", pa.string()), ("digest", pa.string()), ("total", pa.int64()), ("data", pa.binary())]))

    return lines.mapInArrow(parse, schema)


def _parsed(text: str) -> dict:
    head, _, block = text.removeprefix(VERSION + "\r\n").partition(ENDING)
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.split("\r\n"))
    data = block.encode()
    length = int(headers["Content-Length"])
    # The last record of a file still has its ending.
    if len(data) == length + len(ENDING) and data.endswith(ENDING.encode()):
        data = data[:length]
    if len(data) != length:
        raise ValueError(f"record {headers.get('WARC-Record-ID')} has {len(data)} bytes, not {length}")
    kind, number = headers["WARC-Type"], int(headers.get("WARC-Segment-Number", 1))
    total = headers.get("WARC-Segment-Total-Length", headers.get("WARC-Payload-Length"))
    digest = headers.get("WARC-Payload-Digest")
    return {"record_id": headers.get("WARC-Segment-Origin-ID", headers["WARC-Record-ID"]), "serial": headers.get("X-Serial"), "chunk": number,
            "last": "WARC-Segment-Number" not in headers or "WARC-Segment-Total-Length" in headers, "type": kind,
            "url": _value(headers["WARC-Target-URI"]) if "WARC-Target-URI" in headers else None,
            "refers_to": headers.get("WARC-Refers-To"), "digest": digest and digest.removeprefix("sha1:"),
            "total": None if total is None else int(total), "data": data}


def digest_records(chunks: DataFrame) -> DataFrame:
    """(record_id, record_type, url, refers_to, payload_bytes, payload_digest) per record, digests computed anew.

    Records in one piece are digested where they are read.  Only the chunks of longer ones are brought together, sorted by number, and
    streamed through an incremental digest, one chunk in memory.  A digest or length that differs from the header, a chunk that is missing or
    stands twice is an error.  A revisit has the digest and length its header gives.
    """
    out = "record_id string, record_type string, url string, refers_to string, payload_bytes long, payload_digest string"
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for n in range(len(batch)):
                row = {name: batch.column(k)[n].as_py() for k, name in enumerate(batch.schema.names)}
                if row["type"] == "revisit":
                    done.append((row["record_id"], "revisit", row["url"], row["refers_to"], row["total"], row["digest"]))
                    continue
                if state is None:
                    state = {**row, "sha1": hashlib.sha1(), "bytes": 0, "next": 1, "data": None}
                if (row["record_id"], row["serial"]) != (state["record_id"], state["serial"]) or row["chunk"] != state["next"]:
                    raise ValueError(f"chunk {state['next']} of record {state['record_id']} is missing")
                state["sha1"].update(row["data"])
                state["bytes"] += len(row["data"])
                state["next"] += 1
                if row["last"]:
                    digest = base32_sha1(state["sha1"].digest())
                    if digest != state["digest"] or row["total"] not in (None, state["bytes"]):
                        raise ValueError(f"record {state['record_id']} is damaged")
                    done.append((state["record_id"], "response", state["url"], None, state["bytes"], digest))
                    state = None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
        if state is not None:
            raise ValueError(f"chunk {state['next']} of record {state['record_id']} is missing")

    whole = chunks.where("last and chunk = 1").mapInArrow(run, out)
    parts = chunks.where("not (last and chunk = 1)").repartition("record_id", "serial").sortWithinPartitions("record_id", "serial", "chunk")
    return whole.unionByName(parts.mapInArrow(run, out))
