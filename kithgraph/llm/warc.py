"""Web archives: records with segmented, chunked payloads are written as WARC text files and put together again.

A payload goes into an HTTP response with chunked transfer framing. A long block is cut into segments: the first record
and continuation records that name it as their origin, the last with the total length. Chunks end inside every
occurrence of the version line's text, so that it appears nowhere but at the start of records, and Spark's text reader
takes archives apart there. An archive is compressed as a whole, so one task reads it; PER_FILE bounds its records. Reading groups the segments by origin, orders them by number, checks
the total length, and decodes the framing.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import Scratch, by_rows, new_path, written

VERSION = "WARC/1.1"
#: Characters of a block in one record, and of a payload in one chunk.
SEGMENT, CHUNK = 65_536, 16_384
#: Payloads of fewer bytes are never replaced by revisits.
LEAST = 1_000
#: Records in a file, which bounds what one task must unpack.
PER_FILE = 50_000
#: What the standard asks of a record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTENT = "application/http;msgtype=response"
ONE = "kind string, page string, refers string, digest string, origin string, copy string, segment int, total long, block string"


def chunked(payload: str) -> str:
    """A payload in chunked transfer framing, with a chunk border inside each VERSION in it."""
    cuts = [0]
    for found in re.finditer(re.escape(VERSION), payload):
        cuts.append(found.start() + len(VERSION) // 2)
    cuts.append(len(payload))
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        for i in range(a, b, CHUNK):
            part = payload[i : min(i + CHUNK, b)]
            out.append(f"{len(part.encode()):x}\r\n{part}\r\n")
    return "".join(out) + "0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def record(headers: list[tuple[str, object]], block: str) -> str:
    """A record without the two line ends that close it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"{VERSION}\r\n{lines}Content-Length: {len(block.encode())}\r\n\r\n{block}"


def decisions(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds digest, n_bytes, record_type and refers_to: of equal payloads of LEAST bytes or more, the largest page_id answers.

    Only digests, ids and urls are grouped. Rows that share both the payload and that page_id are all responses; a group
    without any page_id has only responses. What is chosen is a written table, so that Spark can split a payload that a
    large part of the pages share.
    """
    rows = pages.withColumn("digest", F.sha1(F.encode("payload", "UTF-8"))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    chosen = rows.where(F.col("n_bytes") >= LEAST).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("_top"), F.count("*").alias("_n")).where("_n > 1")
    chosen = scratch(chosen.select("digest", F.col("_top.page_id").alias("_first"), F.col("_top.url").alias("_first_url")), "responses")
    again = F.coalesce(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")) & (F.col("n_bytes") >= LEAST), F.lit(False))
    return rows.join(chosen, "digest", "left").select(
        "page_id", "url", "payload", "digest", "n_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"), F.when(again, F.col("_first_url")).alias("refers_url"),
    )


def uri(url: str | None) -> str | None:
    """A url as a header value: no white space or control characters, and not the text that records start with."""
    return quote(url or "", safe=":/?#[]@!$&'()*+,;=%").replace(VERSION, quote(VERSION, safe="")) or None


def records(rows: Iterator[pd.DataFrame], date: str) -> Iterator[pd.DataFrame]:
    part, count = TaskContext.get().partitionId(), 0
    for batch in rows:
        out = []
        for page, url, payload, digest, kind, refers, refers_url in zip(*[batch[c].tolist() for c in ("page", "url", "payload", "digest", "record_type", "refers", "refers_url")], strict=True):
            count += 1
            name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{part}/{count}/{page}')}>"
            block = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + ("" if kind == "revisit" else chunked(payload))
            parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
            total = len(block.encode())
            for i, text in enumerate(parts, 1):
                split = len(parts) > 1
                headers = [
                    ("WARC-Type", kind if i == 1 else "continuation"),
                    ("WARC-Record-ID", name if i == 1 else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{i}')}>"),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", uri(url) or f"urn:page:{page}"),
                    ("Content-Type", CONTENT if i == 1 else None),
                    ("WARC-Payload-Digest", f"sha1:{digest}"),
                    ("WARC-Profile", PROFILE if kind == "revisit" and i == 1 else None),
                    ("WARC-Refers-To-Target-URI", (uri(refers_url) or f"urn:page:{refers}") if kind == "revisit" and i == 1 else None),
                    ("WARC-Refers-To-Date", date if kind == "revisit" and i == 1 else None),
                    ("WARC-Page-ID", page),
                    ("WARC-Refers-To-Page-ID", refers),
                    ("WARC-Segment-Number", i if split else None),
                    ("WARC-Segment-Origin-ID", name if i > 1 else None),
                    ("WARC-Segment-Total-Length", total if split and i == len(parts) else None),
                ]
                out.append(record(headers, text))
        yield pd.DataFrame({"value": out})


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes archives of the pages (page_id, url, html) to a folder, as captured at a date.

    Null html is an empty payload; a null or empty url gives a urn of the page_id; very long payloads are cut into
    segments. Repeated rows are records of their own, equal ids and payloads all responses. An empty table gives archives
    without records. Other columns are ignored, whatever their names.
    """
    with Scratch(pages.sparkSession) as scratch:
        rows = decisions(pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")), scratch)
        write_records(rows, path, date)


def write_records(rows: DataFrame, path: str, date: str) -> None:
    texts = rows.select(F.col("page_id").cast("string").alias("page"), F.col("url").cast("string"), "payload", "digest", "record_type", F.col("refers_to").cast("string").alias("refers"), F.col("refers_url").cast("string"))
    lines = by_rows(texts, lambda rows: records(rows, date), "value string")
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


def parsed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in rows:
        out = []
        for text in batch["value"]:
            head, _, rest = text.partition("\r\n\r\n")
            h = dict(x.split(": ", 1) for x in head.split("\r\n") if ": " in x)
            block = rest[:-4] if rest.endswith("\r\n\r\n") else rest
            if len(block.encode()) != int(h["Content-Length"]):
                raise ValueError(f"record {h.get('WARC-Record-ID')} is cut short")
            number = int(h.get("WARC-Segment-Number", 0))
            out.append((h["WARC-Type"], h.get("WARC-Page-ID"), h.get("WARC-Refers-To-Page-ID"), h.get("WARC-Payload-Digest", "").removeprefix("sha1:"), h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), h["WARC-Record-ID"], number, int(h["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in h else None, block))
        frame = pd.DataFrame(out, columns=["kind", "page", "refers", "digest", "origin", "copy", "segment", "total", "block"])
        yield frame.astype({"total": "Int64"})


def decoded(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in rows:
        out = []
        for kind, page, refers, digest, block in zip(*[batch[c].tolist() for c in ("kind", "page", "refers", "digest", "block")], strict=True):
            _, _, body = block.encode().partition(b"\r\n\r\n")
            payload = None if kind == "revisit" else unchunked(body)
            if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"page {page}: the payload does not match its digest")
            out.append((kind, page, refers, digest, payload))
        yield pd.DataFrame(out, columns=["kind", "page", "refers", "digest", "payload"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives: (page_id, record_type, refers_to, digest, payload as bytes, null for revisits).

    Records without a page come with a null page_id; repeated records each for itself; a folder of empty archives gives none.

    Segments of a record are brought together by the id of their origin; all others are decoded where they are read. A
    group is one record, so its size is one payload's. A missing segment or a wrong length fails the job.
    """
    raw = spark.read.option("lineSep", f"{VERSION}\r\n").text(path).where("length(value) > 0")
    rows = by_rows(raw, parsed, ONE)
    whole = rows.where("segment = 0").select("kind", "page", "refers", "digest", "block")
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    parts = rows.where("segment > 0").groupBy("origin").agg(
        first("kind"), first("page"), first("refers"), first("digest"), F.max("total").alias("total"), F.max("segment").alias("last"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    block = F.array_join(F.transform("parts", lambda x: x["block"]), "")
    right = (F.size("parts") == F.col("last")) & (F.octet_length(block) == F.col("total"))
    joined = parts.select("kind", "page", "refers", "digest", F.when(right, block).otherwise(F.raise_error(F.concat(F.lit("segments missing of "), "origin"))).alias("block"))
    out = by_rows(whole.unionByName(joined), decoded, "kind string, page string, refers string, digest string, payload binary")
    return out.select(F.col("page").cast("long").alias("page_id"), F.col("kind").alias("record_type"), F.col("refers").cast("long").alias("refers_to"), "digest", "payload")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as archives, reads them back and tells of each page what its record holds."""
    path = new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    rows = read(spark, path).select("page_id", "record_type", "refers_to", F.col("digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("own_bytes"))
    with Scratch(spark) as scratch:
        rows = scratch(rows, "read-back")
        # a written table, so that Spark can split a response that a large part of the pages refer to
        told = scratch(rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("own_bytes").alias("their_bytes")), "told")
        out = rows.join(told, ["refers_to", "payload_digest"], "left").select("page_id", F.coalesce("own_bytes", "their_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
        return written(out, "warc-told")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
