"""WARC archives: records written with segments and chunked framing, read back and reassembled.

A page becomes one `response` record, or a `revisit` of the response with the same payload. Long
record blocks are cut into segments: the first record keeps the headers of the page, continuation
records name it as origin and carry their number, the last one the total length. The HTTP message
in a block uses chunked transfer framing.

Archives are written by Spark's text sink, whose line separator is the record terminator, so they go
to any file system Spark can write and survive lost tasks. Reading parses each file by the lengths
in its headers; segments meet by origin, are ordered by number and checked against the total length
before the chunks are decoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import stored

VERSION = "WARC/1.1"
END = "\r\n"
DATE = "2026-01-01T00:00:00Z"
HTTP_HEAD = (
    "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
)


def _bytes(x: Column) -> Column:
    return x.cast("binary")


def _text(x: Column) -> Column:
    """Bytes under the name of text, unchanged; the text sink writes them as they are."""
    return x.cast("string")


def revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, digest, refers_to, refers_uri) of pages whose payload an earlier page has.

    `pages` has page_id, url, payload. Payloads under `min_bytes` bytes are never revisits. Of equal
    payloads (by SHA-256) the smallest page_id is the response. A page_id may repeat with
    several payloads, each of which is judged on its own.
    """
    long = pages.filter((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull())
    keys = long.select("page_id", "url", F.sha2("payload", 256).alias("digest"))
    firsts = keys.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last"))
    firsts = firsts.filter(F.col("last") > F.col("first.page_id")).select(
        "digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_uri")
    )
    return (
        keys.select("page_id", "digest").join(firsts, "digest")
        .filter(F.col("page_id") > F.col("refers_to"))
        .select("page_id", "digest", "refers_to", "refers_uri")
        .distinct()
    )


def records(pages: DataFrame, repeats: DataFrame, segment_bytes: int = 32_768, chunk_bytes: int = 8_192) -> DataFrame:
    """One row `value` per record, a whole record without its terminator.

    `pages` has page_id, url, payload; `repeats` comes from `revisits`. A page is looked up by id and
    payload, as an id may repeat with another payload.
    """
    rows = pages.withColumn("digest", F.sha2("payload", 256)).join(repeats, ["page_id", "digest"], "left")
    rows = rows.withColumns(
        {
            "record_id": F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")),
            "n_bytes": F.octet_length("payload").cast("long"),
        }
    )
    chunks = F.transform(
        F.when(
            F.col("n_bytes") > 0,
            F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(chunk_bytes).cast("long")),
        ).otherwise(F.array().cast("array<bigint>")),
        lambda at: F.concat(
            F.lower(F.hex(F.least(F.lit(chunk_bytes).cast("long"), F.col("n_bytes") - at))),
            F.lit(END),
            _text(F.substring(F.col("payload"), (at + 1).cast("int"), F.lit(chunk_bytes))),
            F.lit(END),
        ),
    )
    body = _bytes(F.array_join(chunks, ""))
    message = F.concat(_bytes(F.lit(HTTP_HEAD)), body, _bytes(F.lit("0\r\n\r\n")))
    block = F.when(F.col("refers_to").isNotNull(), _bytes(F.lit("HTTP/1.1 200 OK\r\n\r\n"))).otherwise(message)
    rows = rows.withColumn("block", block).drop("payload")
    rows = rows.withColumn("total", F.octet_length("block").cast("long"))
    step = F.lit(segment_bytes).cast("long")
    rows = rows.select(
        "*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, step)).alias("segment", "at")
    )
    piece = F.substring(F.col("block"), (F.col("at") + 1).cast("int"), F.lit(segment_bytes))
    first, many = F.col("segment") == 0, F.col("total") > segment_bytes
    last = F.col("at") + segment_bytes >= F.col("total")
    line = lambda name, value, when=None: F.when(
        F.lit(True) if when is None else when,
        F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)),
    )
    one_line = lambda uri: F.regexp_replace(uri, "[\r\n]", " ")
    kind = F.when(~first, "continuation").when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    own = F.when(first, F.col("record_id")).otherwise(
        F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))
    )
    revisit = first & F.col("refers_to").isNotNull()
    head = F.concat_ws(
        "",
        F.lit(VERSION + END),
        line("WARC-Type", kind),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", one_line("url"), first & F.col("url").isNotNull()),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")), first),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit),
        line("WARC-Refers-To-Target-URI", one_line("refers_uri"), revisit & F.col("refers_uri").isNotNull()),
        line("WARC-Refers-To-Date", F.lit(DATE), revisit),
        line("WARC-Refers-To-Page", F.col("refers_to"), revisit),
        line("WARC-Page-ID", F.col("page_id"), first & F.col("page_id").isNotNull()),
        line("WARC-Page-Bytes", F.col("n_bytes"), first),
        line("WARC-Segment-Number", F.col("segment") + 1, many),
        line("WARC-Segment-Origin-ID", F.col("record_id"), many & ~first),
        line("WARC-Segment-Total-Length", F.col("total"), many & last),
        line("Content-Type", F.lit("application/http; msgtype=response"), first),
        line("Content-Length", F.octet_length(piece)),
    )
    return rows.select(_text(F.concat(_bytes(head), _bytes(F.lit(END)), piece)).alias("value"))


def write_archives(made: DataFrame, path: str, records_per_file: int = 20_000, level: str = "BEST_SPEED") -> None:
    """Gzip files of whole records; each record ends with two line ends, as the format asks."""
    (
        made.write.mode("overwrite")
        .option("lineSep", 2 * END)
        .option("compression", "gzip")
        .option("zlib.compress.level", level)
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Plain bytes of a gzip file of any number of members, piece by piece."""
    rest = data
    while rest:
        unzip = zlib.decompressobj(31)
        while rest and not unzip.eof:
            piece = unzip.decompress(rest, step)
            rest = unzip.unconsumed_tail or (unzip.unused_data if unzip.eof else b"")
            if piece:
                yield piece
        tail = unzip.flush()
        if tail:
            yield tail


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record, read by their lengths."""
    held, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]
        at = 0
        held.extend(piece)
        return True

    while True:
        while True:
            end = held.find(b"\r\n\r\n", at)
            if end >= 0 or not more():
                break
        if end < 0:
            if held[at:].strip():
                raise ValueError("archive ends inside the headers of a record")
            return
        lines = bytes(held[at:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:80]!r}")
        headers = {}
        for text in lines[1:]:
            name, _, value = text.partition(":")
            headers[name.strip().lower()] = value.strip()
        at = end + 4
        size = int(headers["content-length"])
        while len(held) - at < size + 4 and more():
            pass
        if len(held) - at < size:
            raise ValueError("archive ends inside a record")
        yield headers, bytes(held[at : at + size])
        at = min(at + size + 4, len(held))


SEGMENTS = (
    "record_id string, kind string, page_id long, refers_to long, url string, digest string, "
    "n_bytes long, origin string, number int, total long, block binary"
)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives under `path`."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = SEGMENTS.split(", ")
        columns = [n.split(" ")[0] for n in names]

        def frame(rows: list) -> pd.DataFrame:
            made = pd.DataFrame(rows, columns=columns)
            return made.astype({c: "Int64" for c in ("page_id", "refers_to", "n_bytes", "number", "total")})

        for batch in batches:
            for data in batch["content"]:
                rows, held = [], 0
                for h, block in parsed(inflated(data)):
                    number = lambda name: int(h[name]) if name in h else None  # noqa: B023, E731
                    rows.append(
                        (h["warc-record-id"], h["warc-type"], number("warc-page-id"), number("warc-refers-to-page"),
                         h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha256:"),
                         number("warc-page-bytes"), h.get("warc-segment-origin-id"),
                         number("warc-segment-number"), number("warc-segment-total-length"), block)
                    )
                    held += len(block)
                    if held > 8_000_000:
                        yield frame(rows)
                        rows, held = [], 0
                yield frame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(read, SEGMENTS)


def reassembled(found: DataFrame) -> DataFrame:
    """One row per page record with its whole block; raises where segments are lacking.

    Only records in segments are moved. The segments of one record are as bounded as the record.
    """
    whole = found.filter("number is null").drop("origin", "number", "total")
    parts = found.filter("number is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    piece = F.struct("number", "block")
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    joined = parts.groupBy("origin").agg(
        *[first(c) for c in ("record_id", "kind", "page_id", "refers_to", "url", "digest", "n_bytes")],
        F.max("total").alias("total"),
        F.max("number").alias("most"),
        F.sort_array(F.collect_list(piece)).alias("pieces"),
    )
    block = _bytes(F.array_join(F.transform("pieces", lambda p: _text(p["block"])), ""))
    joined = joined.withColumn("block", block)
    sound = (
        (F.size("pieces") == F.col("most")) & (F.octet_length("block") == F.col("total")) & F.col("record_id").isNotNull()
    )
    checked = F.when(sound, F.col("block")).otherwise(
        F.raise_error(F.concat(F.lit("segments do not add up: "), F.col("origin"))).cast("binary")
    )
    return whole.unionByName(joined.withColumn("block", checked).select(whole.columns))


def unchunked(message: bytes) -> bytes:
    """Payload of an HTTP message; its chunks, if it is framed so, put together."""
    head, _, body = message.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk does not end where its size says")
        at = end + 4 + size


def payloads(whole: DataFrame) -> DataFrame:
    """(page_id, url, kind, refers_to, digest, n_bytes, payload); revisits have an empty payload.

    The payload of a response is checked against its digest.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["block"] = [unchunked(b) for b in batch["block"]]
            yield batch

    asked = whole.select("page_id", "url", "kind", "refers_to", "digest", "n_bytes", "block")
    out = asked.mapInPandas(decode, asked.schema).withColumnRenamed("block", "payload")
    sound = (F.col("kind") == "revisit") | (F.sha2("payload", 256) == F.col("digest"))
    return out.withColumn(
        "payload",
        F.when(sound, F.col("payload")).otherwise(
            F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("digest"))).cast("binary")
        ),
    )


def archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
            min_bytes: int = 100, **sizes) -> DataFrame:
    """Write `pages` as archives under `path` and read them back; the columns of `payloads`.

    Null html is an empty payload, a null url has no target line. A null page_id has no page line
    and reads back as null; such pages are always responses. Rows that repeat a page_id are written
    as often as they occur. Line ends in a url become blanks. No rows: no records, an empty result.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    )
    repeats = stored(revisits(rows, min_bytes), "revisits")
    write_archives(records(rows, repeats, **sizes), path)
    return payloads(reassembled(segments(pages.sparkSession, path)))
