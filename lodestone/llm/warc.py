"""WARC archives: written by Spark's text writer, read back in ranges with boundary-chain verification.

A record is a row of text whose line separator is the blank line that ends a record, so archives go to any store Spark
can write to. Payloads equal to one of an earlier page become revisit records.

Reading splits every archive in ranges. For each range a task finds the places where the record magic stands and parses
a header there; each such candidate names its successor's offset, and the place where following successors first leaves
the range. Magic may also stand inside payloads, so a candidate counts only if the chain from the file's start reaches
it: pointer jumping doubles the jump from range to range until nothing new is reached, then the records between are
marked within their range.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch_dir, small

END = "\r\n\r\n"
URN = "urn:page:"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
FIELD = re.compile(rb"(?m)^([A-Za-z-]+): *([^\r\n]*)\r?$")
#: The fields that are read.
KEYS = (b"content-length", b"warc-type", b"warc-record-id", b"warc-refers-to", b"warc-target-uri", b"warc-payload-digest")
#: Payloads shorter than this are stored again rather than referred to.
REVISIT_FROM = 100


def records(pages: DataFrame, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """page_id, `value`, the WARC record, and `most`, what it takes in bytes at most, for each row of pages(page_id, url,
    html)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload")})
    twice = rows.where(f"n >= {REVISIT_FROM}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c"))
    twice = cut(twice.where("c > 1 and first is not null").select("digest", "first"))
    rows = rows.join(small(twice), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), "n", F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <{URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(f">\r\nWARC-Date: {date}\r\n"), F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), "digest",
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <{URN}"), "first", F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END),
    )
    return rows.select("page_id", F.concat(head, block).alias("value"), _most("payload").alias("most"))


def _most(html: str):
    """Bytes that the record of a page takes at most, for its sizes alone: each \\r and \\n of the url becomes three."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    return F.lit(1024) + size(html) + 3 * size("url")


def write(pages: DataFrame, path: str, file_bytes: int = 64 << 20, record_bytes: int = 16 << 10, step: int = 16) -> None:
    """Write archives of at most file_bytes below path, or of one record that is longer.

    Files are closed after a number of records, so records are written by classes of size: those up to record_bytes, then
    up to step times as many bytes, and so on; each class that occurs is one pass over the pages, in a folder of its own.
    Tasks write where they read, nothing moves but the digests of the pages.
    """
    borders = [record_bytes]
    while borders[-1] < 1 << 33:
        borders.append(borders[-1] * step)
    size_class = sum((F.col("most") > b).cast("int") for b in borders)
    classes = pages.select(_most("html").alias("most")).select(size_class.alias("c")).distinct().collect()
    rows = records(pages)
    for i in sorted(r.c for r in classes) or [0]:
        some = rows.where(size_class == i).select("value")
        some.write.option("lineSep", END).option("maxRecordsPerFile", max(1, file_bytes // borders[i])).text(f"{path}/{i}")


class Heads:
    """Headers of one archive, asked for in order of their offsets. A header ends at the next blank line, however far that
    is; the bytes up to it are searched once, for all candidates before it."""

    def __init__(self, content: bytes):
        self.content, self.end, self.fields = content, None, {}

    def parse(self, at: int) -> tuple | None:
        """(offset of the block, successor, fields) of the record whose magic stands at `at`; None if it is no record."""
        if self.end is None or 0 <= self.end < at:
            self.end = self.content.find(b"\r\n\r\n", at)
            self.fields = {m[1].lower(): (at + m.start(), m[2]) for m in FIELD.finditer(self.content[at : self.end])}
        if self.end < 0:
            return None
        fields = {k: self.fields[k][1] for k in KEYS if k in self.fields and self.fields[k][0] >= at}
        length = fields.get(b"content-length", b"")
        if not length.isdigit() or b"warc-type" not in fields:
            return None
        after = self.end + 4 + int(length)
        return (self.end + 4, after + 4, fields) if self.content[after : after + 4] == b"\r\n\r\n" else None


def _candidates(range_bytes: int, with_payload: bool):
    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                content = data.as_buffer().to_pybytes()
                heads = Heads(content)
                for lo in range(0, len(content), range_bytes):
                    hi = min(lo + range_bytes, len(content))
                    rows = []
                    for m in MAGIC.finditer(content, lo, min(hi + 9, len(content))):
                        if m.start() < hi and (found := heads.parse(m.start())):
                            block, succ, fields = found
                            text = {k: fields[k].decode("utf-8", "replace") for k in fields}
                            body = content[block : succ - 4]
                            http = body.find(b"\r\n\r\n")
                            size = re.search(rb"(?im)^content-length: *(\d+)", body[: max(http, 0)])
                            payload = body[http + 4 :] if http >= 0 else b""
                            full = text[b"warc-type"] != "revisit"
                            digest = hashlib.sha256(payload).hexdigest() if full else text.get(b"warc-payload-digest", "").removeprefix("sha256:")
                            n = len(payload) if full else int(size[1]) if size else 0
                            rows.append([path, lo, m.start(), succ, 0, text[b"warc-type"], text.get(b"warc-record-id"), text.get(b"warc-refers-to"), text.get(b"warc-target-uri"), n, digest] + [payload if full else None] * with_payload)
                    leave = {}
                    for r in reversed(rows):
                        leave[r[2]] = r[4] = leave.get(r[3], r[3])
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types(with_payload))], names=_names(with_payload))

    return run


def _names(with_payload: bool) -> list[str]:
    return ["file", "range", "at", "succ", "leaves", "record_type", "record_id", "refers_to_id", "uri", "payload_bytes", "payload_digest"] + ["payload"] * with_payload


def _types(with_payload: bool) -> list:
    s, i = pa.string(), pa.int64()
    return [s, i, i, i, i, s, s, s, s, i, s] + [pa.binary()] * with_payload


def reached(rows: DataFrame) -> DataFrame:
    """(file, at): entries of ranges that the chain from the file's start reaches, by pointer jumping over `leaves`."""
    jump = rows.select("file", "at", "leaves")
    starts = jump.select("file", F.col("leaves").alias("at")).union(jump.where("at = 0").select("file", "at")).distinct()
    jump = cut(jump.join(starts, ["file", "at"], "left_semi"))
    have = jump.where("at = 0").select("file", "at")
    n = have.count()
    while n:
        more = have.join(jump, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        have = cut(have.union(more).distinct())
        now = have.count()
        if now == n:
            break
        n = now
        on = jump.select(F.col("file"), F.col("at").alias("leaves"), F.col("leaves").alias("then"))
        jump = cut(jump.join(on, ["file", "leaves"], "left").select("file", "at", F.coalesce("then", "leaves").alias("leaves")))
    return have


def _walk(pdf):
    """Of one range: the records that a reached entry leads to."""
    pdf = pdf.sort_values("at")
    live = set(pdf["at"][pdf["entry"]])
    keep = np.zeros(len(pdf), bool)
    for i, (at, succ) in enumerate(zip(pdf["at"], pdf["succ"])):
        if at in live:
            keep[i] = True
            live.add(succ)
    return pdf[keep].drop(columns=["entry"])


def read(spark: SparkSession, path: str, range_bytes: int = 1 << 20, with_payload: bool = False) -> DataFrame:
    """The records of the archives below path, one row each: file, at, record_type, record_id, refers_to_id, uri,
    payload_bytes, payload_digest (SHA-256 of the payload as read; of a revisit as its header says), payload.

    Empty files and files that do not begin with a record give no rows; the chain of a damaged file ends at the damage.
    A task holds one archive at a time, so archives should be of some tens of MB, as `write` makes them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    shape = ", ".join(f"{n} {'binary' if n == 'payload' else 'long' if t == pa.int64() else 'string'}" for n, t in zip(_names(with_payload), _types(with_payload)))
    rows = cut(files.mapInArrow(_candidates(range_bytes, with_payload), shape))
    entries = reached(rows).withColumn("entry", F.lit(True))
    chain = rows.select("file", "range", "at", "succ").join(entries, ["file", "at"], "left").select("file", "range", "at", "succ", F.coalesce("entry", F.lit(False)).alias("entry"))
    kept = chain.groupBy("file", "range").applyInPandas(_walk, "file string, range long, at long, succ long").select("file", "at")
    return rows.join(kept, ["file", "at"], "left_semi").drop("range", "succ", "leaves")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages(page_id, url, html) as archives to the shared scratch folder and read them back.

    page_id, payload_bytes, payload_digest, record_type, refers_to. Of records with equal payloads of at least 100
    bytes the smallest page_id is the response, the others revisit it. Null html is an empty payload, a null url no
    target header. Null page_ids are kept and never referred to. Equal rows are responses both: a page does not revisit
    itself. An empty table gives an empty result. Columns besides the three are not read.
    """
    path = scratch_dir(pages.sparkSession)
    write(pages, path)
    got = read(pages.sparkSession, path)
    number = lambda c: F.regexp_extract(c, rf"^<{URN}(-?\d+)>$", 1)
    ident = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return got.select(ident("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", ident("refers_to_id").alias("refers_to"))
