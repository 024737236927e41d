"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: a record ends with two line ends, which is the text writer's separator, so each task's file is an
archive and Spark's commit protocol makes it whole. Copies of a payload become revisits of one response.

Reading: the text reader cuts the files at every ``WARC/1.`` it meets, in records' payloads too; files are
split among tasks. A task walks its pieces in order and emits candidate records: the offset within the
split, and the successor that the record's own length gives. With the splits' sums these become offsets in
the file. Pointer jumping from the start of each file then doubles the verified stretch of its chain in
each turn; what isn't on the chain was magic inside a payload. Only offsets take part. A record whose
payload was cut apart is put together again from the pieces between it and its successor.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.llm.common import discard, keep, scratch

MAGIC = b"WARC/1."
STEP = len(MAGIC)
END = "\r\n\r\n"
PAGE = "urn:x-page:"


def with_keepers(pages: DataFrame, id_col: str, html_col: str, url_col: str, least_bytes: int) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, keep_id: the largest identifier of the equal
    payloads of at least ``least_bytes``, null where a payload is smaller or alone. The groups are counted
    before anything wide moves; the join on the digest leaves a hot payload to Spark's skew splitting."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\\r\\n]", " ").alias("url"), html.alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("copies"), F.max("page_id").alias("keep_id"))
    return rows.join(groups.where("copies > 1").drop("copies"), ["payload_digest", "payload_bytes"], "left")


def record(rows: DataFrame, date: str) -> Column:
    """The record of a row of ``with_keepers``, without the two line ends behind it. An identifier that
    owns its payload twice (repeated rows) is a response each time."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    of_page = lambda c: F.concat(F.lit(f"<{PAGE}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    again = F.col("keep_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", of_page("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", of_page("keep_id")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(again, "").otherwise(F.col("html")),
    )


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1_000, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 50_000, compression: str = "gzip") -> None:
    """Writes one record for each row to archives under ``path``, at most ``records_per_file`` in each."""
    rows = with_keepers(pages, id_col, html_col, url_col, least_bytes)
    out = rows.select(record(rows, date).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file)
    out.option("compression", compression).text(path)


def head_of(content: bytes) -> tuple[dict[str, str], int, int] | None:
    """Headers, the start of the block and the length of the record, from what follows the magic; None
    if it can't be a record."""
    if content[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    end = content.find(b"\r\n\r\n")
    if end < 0:
        return None
    named = (line.partition(b":") for line in content[3:end].split(b"\r\n"))
    headers = {name.strip().lower().decode("utf-8", "replace"): value.strip().decode("utf-8", "replace") for name, _, value in named}
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    return headers, end + 4, end + 4 + int(length) + 4


FIELDS = "record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, digest_ok boolean, complete boolean, payload binary"


def fields_of(content: bytes, headers: dict[str, str], start: int, total: int, with_payload: bool) -> tuple:
    """The values of FIELDS. A revisit's payload is the one it refers to: its length and digest are the
    recorded ones."""
    block = content[start : total - 4]
    http, digest = b"", headers.get("warc-payload-digest", "").removeprefix("sha1:")
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    n, ok = len(payload), None
    if headers.get("warc-type") == "revisit":
        lengths = [line.partition(b":")[2].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        n = int(lengths[0]) if lengths and lengths[0].isdigit() else None
        payload = None
    else:
        found = hashlib.sha1(payload).hexdigest()
        ok, digest = (found == digest if digest else None), found
    complete = len(content) >= total and content[total - 4 : total] == b"\r\n\r\n"
    return (headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), n, digest or None, ok, complete, payload if with_payload else None)


def table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=names)


PIECE = f"file string, split long, within long, size long, total long, content binary, {FIELDS}"


def scan(with_content: bool, with_payload: bool):
    """Candidate records of each split in order. ``within``: where the piece begins in its split;
    ``total``: the length that its header gives, null if it's no record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, within = None, 0
        for batch in batches:
            rows = []
            for file, split, content in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("content"), strict=True):
                content = content.as_py()
                if (file, split) != last:
                    last, within = (file, split), 0
                head = head_of(content)
                values = (None,) * 9 if head is None else fields_of(content, *head, with_payload)
                rows.append((file, split, within, len(content), head and head[2], content if with_content else None, *values))
                within += len(content) + STEP
            yield table(rows, PIECE)

    return run


def reparse(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, at, parts in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), batch.column("parts"), strict=True):
                content = MAGIC.join(part["content"] for part in parts.as_py())
                rows.append((file, at, *fields_of(content, *head_of(content), with_payload)))
            yield table(rows, f"file string, at long, {FIELDS}")

    return run


def chain(candidates: DataFrame) -> DataFrame:
    """(file, at): the candidates (file, at, to) that the chain from each file's start reaches.

    Pointer jumping: in each turn every reached record reaches the end of its pointer, and every pointer
    becomes the pointer of where it points; so after k turns 2^k records of each chain are reached. It ends
    when a turn reaches nothing new.
    """
    nodes = keep(candidates.withColumn("reached", F.col("at") == STEP))
    reached = nodes.where("reached").count()
    while True:
        ends = nodes.select("file", F.col("at").alias("to"), F.col("to").alias("after"))
        pointers = nodes.join(ends, ["file", "to"], "left").select("file", "at", F.col("after").alias("to"), "reached")
        hits = nodes.where("reached and to is not null").select("file", F.col("to").alias("at"), F.lit(None).cast("long").alias("to"), F.lit(True).alias("reached"), F.lit(False).alias("known"))
        both = pointers.withColumn("known", F.lit(True)).unionByName(hits)
        before, nodes = nodes, keep(both.groupBy("file", "at").agg(F.max("to").alias("to"), F.max("reached").alias("reached"), F.max("known").alias("known")).where("known").drop("known"))
        discard(before)
        now = nodes.where("reached").count()
        if now == reached:
            return nodes.where("reached").select("file", "at")
        reached = now


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``: file, offset (of its magic) and FIELDS.

    Files may be compressed (then each is read by one task). ``payload`` is null for revisits and unless
    ``with_payload``. ``digest_ok`` tells whether the payload has the recorded digest (null without one);
    a record that the file's end cuts off is ``complete = false``. A file that doesn't begin with a record
    gives no rows, as do an empty file and what follows a broken link of the chain.
    """
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    text = text.select(F.col("value").cast("binary").alias("content"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    pieces = keep(text.mapInArrow(scan(False, with_payload), PIECE).drop("content"))
    lengths = pieces.groupBy("file", "split").agg(F.sum(F.col("size") + STEP).alias("length"))
    ahead = F.sum("length").over(Window.partitionBy("file").orderBy("split")) - F.col("length")  # of a file's splits
    bases = keep(lengths.select("file", "split", ahead.alias("base")))
    at = F.col("base") + F.col("within")
    placed = pieces.join(bases, ["file", "split"]).withColumn("at", at)
    narrow = keep(placed.select("file", "at", "size", "total"))
    reached = keep(chain(narrow.where("total is not null").select("file", "at", (F.col("at") + F.col("total") + STEP).alias("to"))))
    fields = [c.split()[0] for c in FIELDS.split(", ")]
    out = ["file", (F.col("at") - STEP).alias("offset"), *fields]
    records = placed.join(reached, ["file", "at"])
    cut = keep(narrow.where("total > size").join(reached, ["file", "at"]).select("file", F.col("at").alias("owner"), (F.col("at") + F.col("total")).alias("end")))
    if cut.isEmpty():
        return records.select(*out)
    # a magic in their payload has cut these records: the pieces up to the successor belong to them
    starts = narrow.join(cut.select("file").distinct(), "file", "left_semi").join(cut.withColumn("at", F.col("owner")), ["file", "at"], "left")
    of = Window.partitionBy("file").orderBy("at")  # offsets of one file, no contents
    owned = starts.withColumn("owner", F.last("owner", True).over(of)).withColumn("end", F.last("end", True).over(of)).where("at < end").select("file", "at", "owner")
    contents = text.mapInArrow(scan(True, False), PIECE).select("file", "split", "within", "content").join(bases, ["file", "split"]).withColumn("at", at)
    parts = contents.join(owned, ["file", "at"]).groupBy("file", F.col("owner").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "content"))).alias("parts"))
    whole = parts.mapInArrow(reparse(with_payload), f"file string, at long, {FIELDS}")
    return records.where("total <= size").select(*out).unionByName(whole.select(*out))


def page_of(record_id: Column) -> Column:
    """The page identifier that ``write_warc`` put into a record's."""
    return F.regexp_extract(record_id, f"^<{PAGE}(-?[0-9]+)>$", 1).try_cast("long")


def archived_pages(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    Null html counts as empty, a null url is an empty one, null identifiers are kept; rows repeated with
    one identifier give a record each; an empty table gives no rows.
    """
    path = scratch(pages.sparkSession)
    write_warc(pages, path, **options)
    found = read_warc(pages.sparkSession, path, with_payload=False)
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
