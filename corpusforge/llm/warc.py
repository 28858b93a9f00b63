"""WARC archives with revisit resolution.

write_archives hashes every payload, shuffles only the headers (digest, length, id) to find the first
record of each payload, joins that to the pages, and writes WARC/1.1 files with Spark's text writer: its
line separator is the CR LF CR LF that ends a record, so every file is a valid archive, committed by the
same protocol as any Spark output. The first of equal payloads is a response; later ones are revisit
records with fresh headers that name it, without the payload.

read_archives unpacks and parses the files record by record, by Content-Length, inside the tasks; resolve joins revisit records to their
originals by id, so a revisit's length and payload digest come from the archived response.

Defined cases: null html counts as empty; payloads under 100 bytes are always responses; a null page_id
sorts after every number and is written without an id; rows that repeat the first page_id of a payload are
all responses; a null url is left out; line ends in a url are escaped; an empty table gives an empty
archive; further columns are not archived.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import materialise, scratch_path

LEAST_BYTES = 100
#: Payload bytes below which so many records go to one file: no file holds more than 256 MB, or one record that is larger.
SHELVES = ((1 << 16, 2000), (1 << 22, 64), (1 << 62, 1))
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, declared_digest string, date string"
NUMBERS = ("page_id", "refers_to", "payload_bytes")


def headers(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    body = F.coalesce(F.col(html), F.lit(""))
    return pages.select(F.col(page_id).alias("page_id"), F.octet_length(body).cast("long").alias("bytes"), F.sha2(body, 256).alias("digest"))


def originals(heads: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(digest, first_id) of every payload that occurs more than once; copies are counted before the shuffle."""
    return heads.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("digest", "first_id")


def record(date: str) -> Column:
    """The text of a record without its ending; columns page_id, url, body, digest, first_id."""
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    ids = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("body")))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(ids("page_id"), F.lit("<urn:page:none>"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", ids("first_id")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = LEAST_BYTES) -> None:
    """Write pages as gzipped WARC files under path."""
    heads = headers(pages, page_id, html)
    firsts, most = materialise(originals(heads, least)), heads.agg(F.max("bytes")).first()[0] or 0
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    low = 0
    for high, records in SHELVES:
        if low <= most:
            shelf = rows.filter((F.octet_length("body") >= low) & (F.octet_length("body") < high)) if most >= SHELVES[0][0] else rows
            found = shelf.join(firsts, "digest", "left").select(record(date).alias("value"))
            found.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
        low = high


def parse(content: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, by its Content-Length; of a stream, one record is in memory at a time."""
    stream = io.BytesIO(content) if isinstance(content, bytes) else content
    at = 0
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"record {at} does not begin with its version")
        head = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, value = line.decode().split(": ", 1)
            head[name] = value
        size = int(head["Content-Length"])
        block = stream.read(size)
        if len(block) < size or stream.read(len(END)) != END.encode():
            raise ValueError(f"record {at} is cut short")
        yield head, block
        at += 1


def _urn(value: str | None) -> int | None:
    found = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found.lstrip("-").isdigit() else None


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in READ.split(", ")]
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for head, block in parse(gzip.open(io.BytesIO(content))):
                payload = block[block.index(END.encode()) + len(END) :]
                first = head["WARC-Type"] == "response"
                rows.append((
                    _urn(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], _urn(head.get("WARC-Refers-To")), len(payload) if first else None,
                    hashlib.sha256(payload).hexdigest() if first else None, head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Date"],
                ))
            # column by column: a frame made of rows would turn whole numbers beside a missing one into floats
            columns = dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}
            yield pd.DataFrame({n: pd.array(v, dtype="Int64" if n in NUMBERS else "object") for n, v in columns.items()})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: headers, and length and digest of the payloads that are there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(_records, READ)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to; revisits take their original's payload."""
    records = materialise(records)
    responses = records.filter("record_type = 'response'")
    known = responses.groupBy(F.col("page_id").alias("o_id"), F.col("payload_digest").alias("o_digest")).agg(F.max("payload_bytes").alias("o_bytes"))
    revisits = records.filter("record_type = 'revisit'").join(known, (F.col("refers_to") == F.col("o_id")) & (F.col("declared_digest") == F.col("o_digest")), "left")
    found = revisits.select("page_id", "url", F.col("o_bytes").alias("payload_bytes"), F.col("o_digest").alias("payload_digest"), "record_type", "refers_to")
    return responses.select(found.columns).unionByName(found)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolve(read_archives(spark, path)).drop("url")


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM g
"""
