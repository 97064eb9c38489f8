"""WARC archives written and read by Spark, and captures assembled from their records.

Archives are plain text sinks with the record separator as line end, so any storage that Spark writes to holds
them. Records are read back as whole files of bounded record number, unpacked as a stream.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.llm.common import salted_join, shared_dir, stored

END = "\r\n"
CAPTURES_PER_FILE = 2000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _urn(*parts: Column) -> Column:
    """A record id made of the parts: the same when a lost task runs again."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column]], block: Column, media: str) -> Column:
    """Text of one record without the closing empty lines, which the sink writes. Headers that are NULL are left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}")]
    lines += [F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v)) for name, v in headers]
    lines += [F.lit(f"Content-Type: {media}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), block)


def with_originals(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """`pages` (page_id, url, html) with payload, payload_bytes, payload_digest, original_id and original_uri.

    Of pages with equal payloads of at least `least_bytes`, the largest page_id is the original; the others carry it in
    original_id, originals and smaller payloads have NULL there. A NULL html is an empty payload. A NULL page_id is smaller than any id.
    Rows that repeat page_id and payload of the original are originals too.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.coalesce(F.col("html"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    big = F.col("payload_bytes") >= least_bytes
    # small payloads have a key of their own, so that they spread
    rows = rows.withColumn("_key", F.when(big, F.col("payload_digest")).otherwise(F.concat_ws("-", F.lit("small"), "page_id", F.xxhash64("url"))))
    heads = rows.where(big).groupBy("_key").agg(F.max(F.struct("page_id", "url")).alias("_head"))
    rows = salted_join(rows, heads.hint("shuffle_hash"), ["_key"], F.struct("page_id", "url"), "left")
    revisit = F.coalesce(F.col("_head.page_id") != F.coalesce("page_id", F.lit(-(2**63))), F.lit(False))
    return rows.withColumns(
        {"original_id": F.when(revisit, F.col("_head.page_id")), "original_uri": F.when(revisit, F.col("_head.url"))}
    ).drop("_key", "_head")


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", captures_per_file: int = CAPTURES_PER_FILE) -> None:
    """Request, response (or revisit) and metadata record of every row of `with_originals`, in gzip archives below `path`.

    Request and metadata name the response in WARC-Concurrent-To. A revisit has the headers of its response only; its
    Content-Length tells the size of the payload. Repeated rows get ids of their own. Characters that end a header line are
    percent-coded in the address.
    """
    # drawn once per row and used by the records of that row alone; a lost task writes its file anew as a whole
    rows = pages.withColumn("_nonce", F.uuid())
    uri = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))), r"[\x00-\x20\x7F]", "%20")
    head_uri = F.regexp_replace(F.coalesce("original_uri", F.concat(F.lit("urn:page:"), F.col("original_id").cast("string"))), r"[\x00-\x20\x7F]", "%20")
    revisit = F.col("original_id").isNotNull()
    response = _urn(F.lit("response"), F.col("_nonce"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END + END),
    )
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest"))
    whole = _record("response", [("WARC-Record-ID", response), *common, digest], F.concat(http, "payload"), "application/http; msgtype=response")
    again = _record(
        "revisit",
        [("WARC-Record-ID", response), *common, digest, ("WARC-Profile", F.lit(REVISIT_PROFILE)),
         ("WARC-Refers-To-Target-URI", head_uri), ("WARC-Refers-To-Date", F.lit(date))],
        http, "application/http; msgtype=response",
    )
    linked = lambda kind: [("WARC-Record-ID", _urn(F.lit(kind), F.col("_nonce"))), *common, ("WARC-Concurrent-To", response)]
    host = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    place = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    request = F.concat(F.lit("GET "), F.when(place.startswith("/"), place).otherwise(F.concat(F.lit("/"), place)), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END + END))
    about = F.concat_ws(
        "", F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit(END)),
        F.concat(F.lit("refersToPageId: "), F.col("original_id").cast("string"), F.lit(END)),
    )
    records = F.array(
        _record("request", linked("request"), request, "application/http; msgtype=request"),
        F.when(revisit, again).otherwise(whole),
        _record("metadata", linked("metadata"), about, "application/warc-fields"),
    )
    out = rows.select(F.explode(records).alias("value"))
    out.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures_per_file).text(path)


def _headers(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def _unpacked(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an archive, plain or of one or many gzip members, piece by piece."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        member = zlib.decompressobj(31)
        piece = member.decompress(content, step)
        while True:
            yield piece
            if member.eof or not (piece or member.unconsumed_tail):
                break
            piece = member.decompress(member.unconsumed_tail, step)
        content = member.unused_data


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, by Content-Length; a record cut off at the end is an error."""
    pieces, buffer = _unpacked(content), bytearray()

    def more() -> bool:
        for piece in pieces:
            if piece:
                buffer.extend(piece)
                return True
        return False

    while True:
        while (at := buffer.find(b"\r\n\r\n")) < 0 and more():
            pass
        if at < 0:
            if buffer.strip():
                raise ValueError("archive ends inside of record headers")
            return
        headers = _headers(bytes(buffer[:at]))
        end = at + 4 + int(headers["content-length"])
        while len(buffer) < end + 4 and more():
            pass
        if len(buffer) < end:
            raise ValueError("archive ends inside of a record")
        yield headers, bytes(buffer[at + 4 : end])
        del buffer[: end + 4]


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, payload, size = headers.get("warc-type"), block, None
    fields: dict[str, str] = {}
    if headers.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        fields = _headers(top.partition(b"\r\n")[2])
        fields["start-line"] = top.partition(b"\r\n")[0].decode("utf-8", "replace")
    elif headers.get("content-type", "") == "application/warc-fields":
        fields = _headers(block)
    if kind == "revisit":
        size, digest = int(fields.get("content-length", 0)), re.sub("^sha1:", "", headers.get("warc-payload-digest", ""))
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        told = headers.get("warc-payload-digest")
        if told and told != f"sha1:{digest}":
            raise ValueError(f"payload of {headers.get('warc-record-id')} differs from its digest")
    return (
        headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"),
        size, digest, fields, payload if with_payload else None,
    )


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below `path` (schema RECORD); a payload that differs from its digest is an error."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                got, size = [], 0
                for headers, block in parse_records(bytes(content)):
                    got.append(_row(headers, block, with_payload))
                    size += len(block) * with_payload
                    if len(got) >= 5000 or size > 16_000_000:
                        yield pd.DataFrame(got, columns=RECORD.names)
                        got, size = [], 0
                yield pd.DataFrame(got, columns=RECORD.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: columns capture_id, response, request and metadata (structs of record columns).

    Requests and metadata meet their response through concurrent_to; those whose response is missing make a capture of
    their own with a NULL response, and responses without partners have NULL there. Of several requests (or metadata
    records) that name one response, the one with the smallest record id is taken; a record that is there twice counts once.
    """
    body = F.struct(*[c for c in records.columns if c not in ("record_id", "concurrent_to", "_capture")])

    def of(kinds: list[str], key: str, name: str) -> DataFrame:
        part = records.where(F.col("record_type").isin(kinds) & F.col(key).isNotNull())
        one = F.min_by(F.struct("record_id", body.alias("body")), F.col("record_id"))
        return part.groupBy(F.col(key).alias("capture_id")).agg(one.alias(name)).select(
            "capture_id", F.struct(f"{name}.record_id", f"{name}.body.*").alias(name)
        )

    captures = of(["response", "revisit"], "record_id", "response")
    for kind in ("request", "metadata"):
        captures = captures.join(of([kind], "concurrent_to", kind), "capture_id", "full")
    return captures


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Captures of `pages` after they were written to archives in the shared folder and read back."""
    path = shared_dir(spark, "warc")
    write_warc(with_originals(pages, least_bytes), path)
    return assemble(stored(read_warc(spark, path, with_payload=False), "records"))


def page_rows(captures: DataFrame) -> DataFrame:
    """One row per capture in the terms of `pages`: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    told = lambda name: F.col("metadata.fields")[name].cast("long")
    return captures.select(
        told("pageid").alias("page_id"), "response.payload_bytes", "response.payload_digest", "response.record_type",
        told("referstopageid").alias("refers_to"), F.col("request.fields")["host"].alias("host"),
    )
