"""WARC archives: written record by record as gzip members, read back by byte ranges.

Writing. Each record is one gzip member, so an archive can be entered at any record. Spark's text sink
puts a separator after each row; here the separator is the byte 00, and every value is a member less
its last byte, which is 00 (the top byte of the uncompressed size). A member of 16 MiB and more ends
otherwise; it is followed by an empty member less its last byte. So the files are plain concatenated
gzip members, written through Spark's commit protocol to whatever store it can reach.

Reading. Spark's text source splits files into byte ranges; with the gzip magic number as separator
each task scans its range for magic bytes and owns the pieces that start inside it. A piece is a
candidate member: it stands only if its header decodes (method, reserved flags), the data inflate
with a right check sum, and the content begins with a WARC version line. Magic bytes inside
compressed data fail that test, and the pieces around them are joined again until a member is
complete. Where such a false start is a range's first, or a member's pieces reach over its end, the
fragments leave the task as they are and are joined in file order afterwards.

Archives must not have a name that Spark takes for compressed (.gz): it would then hand out decoded
text in one range. Damaged members are dropped from their start to the next good member; empty members are skipped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.shared import cut

# Gzip magic with method 8, the empty member, and WARC's version line.
MAGIC = b"\x1f\x8b\x08"
EMPTY = bytes.fromhex("1f8b08000000000000ff0300" + "00" * 8)
VERSION = b"WARC/1.0\r\n"
EPOCH = "1970-01-01T00:00:00Z"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, date string, content_length long, payload binary"


def member(content: bytes) -> bytes:
    """A gzip member (or two) whose last byte is 00."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(content) + z.flush()
    return out if out[-1] == 0 else out + EMPTY


def record(record_id: str, kind: str, uri: str | None, refers_to: str | None, digest: str, payload: bytes, date: str = EPOCH) -> bytes:
    """A response record with its payload, or a revisit record without one."""
    body = payload if kind == "response" else b""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(body)}", "Content-Type: text/html; charset=utf-8"]
    if uri is not None:
        head.insert(2, "WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write(records: DataFrame, path: str) -> None:
    """records: record_id, record_type, target_uri, refers_to, payload_digest (hex), payload -> archives under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for r in range(0, batch.num_rows, 64):
                rows = zip(*(batch.column(names.index(c)).slice(r, 64).to_pylist() for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload")), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([member(record(*x[:5], x[5] or b""))[:-1] for x in rows], pa.binary())], names=["value"])

    out = records.select("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload").mapInArrow(run, "value binary")
    out.select(F.col("value").cast("string")).write.option("lineSep", "\x00").text(path)


def inflate(piece: bytes) -> tuple[str, bytes]:
    """("good", content), ("short", b"") if the member goes on after the piece, ("unsure", b"") if it may, as it
    ends before the version line does, or ("bad", b"").

    piece: bytes that begin with MAGIC.
    """
    if len(piece) > 3 and piece[3] & 0xE0:
        return "bad", b""
    z = zlib.decompressobj(31)
    parts = []
    try:
        parts.append(z.decompress(piece[:256], 64))
        if parts[0] and not VERSION.startswith(parts[0][: len(VERSION)]):
            return "bad", b""
        rest = z.unconsumed_tail + piece[256:]
        parts.append(z.decompress(rest) if rest else b"")
    except zlib.error:
        return "bad", b""
    content = b"".join(parts)
    if z.eof:
        return "good", content
    # Before any content there is no telling a header's fields from data that look like one: only the next pieces tell.
    first = content[: len(VERSION)]
    return ("short" if first == VERSION else "unsure" if VERSION.startswith(first) else "bad"), b""


def parse(content: bytes) -> dict | None:
    """The columns of RECORD, or None if the content is no WARC record."""
    head, gap, body = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not fields.get("content-length", "").isdigit():
        return None
    n = int(fields["content-length"])
    if n > len(body):
        return None
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    digest = fields.get("warc-payload-digest")
    return {"record_id": bare("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "refers_to": bare("warc-refers-to"), "payload_digest": digest.removeprefix("sha1:") if digest else None, "date": fields.get("warc-date"), "content_length": n, "payload": body[:n]}


def assemble(pieces: Iterator[bytes], at_start: bool, at_end: bool) -> Iterator[tuple[str, bytes | dict]]:
    """("record", columns) of each member, or ("head" | "tail", bytes) of what belongs to another range.

    pieces: what lies between magic numbers, in order. at_start, at_end: the pieces begin or end with the file.
    """
    held: list[bytes] = []  # the pieces of a member that has not ended
    sure = False  # whether they hold a version line
    head = not at_start
    pieces = iter(pieces)
    todo: list[bytes] = []  # pieces to look at (again), the next one last
    while True:
        if todo:
            one = todo.pop()
        elif (piece := next(pieces, None)) is not None:
            one = MAGIC + piece
        elif held and not sure and at_end:
            # No start after all: what was held behind it has its turn.
            if head:
                yield "head", held[0]
            todo, held = held[:0:-1], []
            continue
        else:
            break
        # Within a member that goes on, the magic bytes may be data; taken as a start they must give a whole member.
        state, content = inflate(one)
        if held:
            joined = inflate(b"".join(held) + one)
            if joined[0] == "good":
                held, head = [], False
                if made := parse(joined[1]):
                    yield "record", made
                continue
            if joined[0] in ("short", "unsure") and state != "good":
                held.append(one)
                if joined[0] == "short":
                    sure, head = True, False
                continue
            if not sure:  # no start: data of a member before it, or damaged
                if head:
                    yield "head", held[0]
                todo += [one, *held[:0:-1]]
                held = []
                continue
            held = []  # damaged: it ends here
        if state == "good":
            head = False
            if made := parse(content):
                yield "record", made
        elif state in ("short", "unsure"):
            held, sure = [one], state == "short"
            head = head and not sure
        elif head:
            yield "head", one
    if held and not at_end:
        # Whether an unsure start belongs to a member before the range is settled with the fragments before it.
        for k, x in enumerate(held):
            yield "head" if head or k else "tail", x


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path, in the columns of RECORD."""
    raw = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    meta = F.col("_metadata")
    raw = raw.select(F.col("value").cast("binary").alias("value"), meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), (meta["file_block_start"] + meta["file_block_length"] >= meta["file_size"]).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        number = count()

        def rows() -> Iterator[tuple[tuple, bytes]]:
            for batch in batches:
                keys = zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)
                for key, value in zip(keys, batch.column(0), strict=True):
                    yield key, value.as_py()

        def out(found: Iterator[tuple[str, bytes | dict]], key: tuple) -> Iterator[dict]:
            for kind, x in found:
                yield {"file": key[0], "start": key[1], "seq": next(number), "part": kind, "rest": None if kind == "record" else x, **(x if kind == "record" else dict.fromkeys(names))}

        held, size = [], 0
        for key, range_ in by_range(rows()):
            pieces = range_
            if key[1] == 0:
                next(pieces, None)  # what stands before the first magic number
            for row in out(assemble(pieces, key[1] == 0, key[2]), key):
                held.append(row)
                size += len(row["payload"] or row["rest"] or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("part", pa.string()), ("rest", pa.binary())] + [(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", "))])
    return raw.mapInArrow(run, f"file string, start long, seq long, part string, rest binary, {RECORD}")


def by_range(rows: Iterator[tuple[tuple, bytes]]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Runs of rows of one byte range, as (key, iterator of values); each run must be used up before the next."""
    for key, run in groupby(rows, key=lambda x: x[0]):
        yield key, (v for _, v in run)


def records(spark: SparkSession, path: str, found: DataFrame | None = None) -> DataFrame:
    """read(), with the members that lie over range ends put together from their fragments.

    found: a table of read()'s rows; without it the archives are read for the records and again for the fragments.
    """
    found = read(spark, path) if found is None else found
    names = [x.split()[0] for x in RECORD.split(", ")]
    whole = found.where("part = 'record'").select(names)
    # Fragments are the exception: about one piece in 16 million bytes is a false start. They meet by the
    # member they belong to: the last tail of its file that starts before them.
    w = Window.partitionBy("file").orderBy("start", "seq")
    rest = found.where("part != 'record'").withColumn("member", F.sum(F.when(F.col("part") == "tail", 1).otherwise(0)).over(w))
    joined = rest.groupBy("file", "member").agg(F.array_sort(F.collect_list(F.struct("start", "seq", "rest"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [m for x in batch.column(0).to_pylist() for _, m in assemble((p["rest"][len(MAGIC) :] for p in x), True, True)]
            yield pa.RecordBatch.from_pylist(good, schema=pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", "))]))

    return whole.unionByName(joined.select("x").mapInArrow(run, RECORD))


def archive_pages(pages: DataFrame, path: str, min_revisit: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each page. Of equal payloads of min_revisit bytes and more the largest id is the response.

    Null html is an empty payload; null urls give no target. Rows that share id and payload are written alike.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("payload_digest", F.sha1("payload")).withColumn("long", F.length("payload") >= min_revisit)
    largest = p.where("long").groupBy(F.col("payload_digest").alias("d")).agg(F.max("id").alias("chief"), F.count("id").alias("n")).where("n > 1")
    p = p.join(cut(largest, "repeated"), F.col("long") & (F.col("payload_digest") == F.col("d")), "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    revisit = F.coalesce(F.col("chief") != F.col("id"), F.lit(False))
    write(p.select(F.coalesce(urn(F.col("id")), F.lit("urn:page:")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(revisit, urn(F.col("chief"))).alias("refers_to"), "payload_digest", F.when(~revisit, F.col("payload")).alias("payload")), path)
