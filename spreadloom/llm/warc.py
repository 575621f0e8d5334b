"""WARC archives with revisit records, read back by verifying the chain of record boundaries.

Every record is a gzip member of its own. A reading task takes one block of a file and tries each gzip magic in it; one
that opens a record gives the offset of its successor. Magic bytes also occur inside payloads, and may even open a
whole record there, so a candidate counts only if it is reachable from the start of its file: each block reduces its
chains to entry and exit, pointer jumping over these finds the true entries in a logarithmic number of rounds, and
each block then walks from its entry.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, shuffle_partitions, table, written
from .token_files import _store

MAGIC = b"\x1f\x8b\x08"
BLOCK = 4 << 20
VERSION = b"WARC/1.1\r\n"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record with its HTTP header; a revisit keeps the header, and so the payload's length, but no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    uri = "".join(c for c in url or "" if c.isprintable() and c != " ")
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {uri}"] if uri else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple | None:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record; None if it isn't one."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(VERSION):
        return None
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head[len(VERSION) :].decode("utf-8", "replace").split("\r\n"))}
    try:
        n = int(fields["content-length"])
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            return None
        body, number = rest[:n], lambda x: int(x.removeprefix("<urn:page:").removesuffix(">")) if x != "<urn:page:>" else None
        http, _, payload = body.partition(b"\r\n\r\n")
        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        page, kind = number(fields["warc-record-id"]), fields["warc-type"]
        if kind == "revisit":
            return page, size, fields["warc-payload-digest"].removeprefix("sha1:"), kind, number(fields["warc-refers-to"])
        return (page, len(payload), digest(payload), kind, None) if len(payload) == size else None
    except (KeyError, ValueError, StopIteration):
        return None


def write_archives(pages: DataFrame, *, folder: str | None = None, least_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns one row a file: name, bytes.

    Of records with equal payloads of at least ``least_bytes`` the one with the largest page_id holds it and the others
    refer to it. Null html is an empty payload, null urls are left out, null ids are kept (and never the largest).
    Rows that repeat the largest page_id are all responses. Other columns are ignored; no rows give no files.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha2("html", 256))
    shared = rows.where(F.octet_length("html") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
    shared = shared.where("n > 1").select("key", "holder")
    joined = rows.join(shared, "key", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")))
    fs, path = _store(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, size = TaskContext.get(), None, 0
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        fs, path = _store(folder)
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
                packer = zlib.compressobj(level, wbits=31)
                data = packer.compress(record(page.as_py(), url.as_py(), html.as_py().encode("utf-8", "replace"), refers.as_py())) + packer.flush()
                out.write(data)
                size += len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [f"{folder}/{name}"], "bytes": [size]})

    return written(joined.select("page_id", "url", "html", "refers_to").mapInArrow(write, "name string, bytes long"), "warc_files")


CANDIDATES = f"name string, block long, found array<struct<at: long, next: long, exit: long, {RECORD.replace(' ', ': ').replace(',:', ',')}>>"


def candidates(files: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """One row a block: the records that magic bytes in it open, with successor and exit from the block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _store(row["name"])
                begin = row["block"] * block
                with fs.open_input_file(path) as f:
                    end = min(begin + block, f.size())
                    f.seek(begin)
                    data = f.read(end - begin + len(MAGIC) - 1)
                    found, at = [], data.find(MAGIC)
                    while 0 <= at < end - begin:
                        got = _open(f, data, at, begin)
                        if got:
                            found.append({"at": begin + at, "next": got[0], **dict(zip(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), got[1], strict=True))})
                        at = data.find(MAGIC, at + 1)
                exits: dict[int, int] = {}
                for x in reversed(found):  # successors lie behind, so their exits are known
                    x["exit"] = exits[x["at"]] = exits.get(x["next"], -1) if x["next"] < end else x["next"]
                yield pa.RecordBatch.from_pydict({"name": [row["name"]], "block": [row["block"]], "found": [found]}, schema=schema)

    record_type = pa.struct([("at", pa.int64()), ("next", pa.int64()), ("exit", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    schema = pa.schema([("name", pa.string()), ("block", pa.int64()), ("found", pa.list_(record_type))])
    blocks = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block))))
    blocks = blocks.select("name", "block").repartition(shuffle_partitions(files.sparkSession), "name", "block")
    return written(blocks.mapInArrow(scan, CANDIDATES), "warc_candidates")


def _open(f, data: bytes, at: int, begin: int) -> tuple[int, tuple] | None:
    """Successor's offset and fields if a record opens at ``at``; reads on behind the block where the record does."""
    unpacker, out, used = zlib.decompressobj(wbits=31), [], at
    try:
        out.append(unpacker.decompress(data[at : at + 1024]))  # most false candidates fail here
        if not VERSION.startswith(out[0][: len(VERSION)]):
            return None
        used = min(len(data), at + 1024)
        while not unpacker.eof:
            if used < len(data):
                piece, used = data[used : used + (1 << 16)], min(len(data), used + (1 << 16))
            else:
                f.seek(begin + used)
                piece = f.read(1 << 16)
                used += len(piece)
            if not piece:
                return None
            out.append(unpacker.decompress(piece))
    except zlib.error:
        return None
    fields = parse(b"".join(out))
    return fields and (begin + used - len(unpacker.unused_data), fields)


def true_entries(found: DataFrame) -> DataFrame:
    """(name, at) of the first true record of each block, by pointer jumping from the start of each file."""
    jumps = found.select("name", F.explode("found").alias("x")).select("name", F.col("x.at").alias("at"), F.col("x.exit").alias("to")).where("to >= 0")
    landings = jumps.select("name", F.col("to").alias("at")).distinct()
    jumps = written(jumps.join(landings, ["name", "at"], "left_semi").unionByName(jumps.where("at = 0")).distinct(), "warc_jumps")
    reached = found.select("name", F.lit(0).cast("long").alias("at")).distinct()
    n = -1
    while True:
        ahead = reached.join(jumps, ["name", "at"]).select("name", F.col("to").alias("at"))
        reached = written(reached.unionByName(ahead).distinct(), "warc_reached")
        before, n = n, reached.count()
        if n == before:
            return reached
        jumps = written(jumps.join(jumps.select("name", F.col("at").alias("to"), F.col("to").alias("far")), ["name", "to"]).select("name", "at", F.col("far").alias("to")), "warc_jumps")


def read_archives(files: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every true record of the files."""
    found = candidates(files, block=block)
    entries = true_entries(found).withColumn("block", F.floor(F.col("at") / block))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for row in batch.to_pylist():
                by, at, rows = {x["at"]: x for x in row["found"]}, row["at"], []
                while at in by:
                    rows.append(by[at])
                    at = by[at]["next"]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in zip(names, types, strict=True)], names=list(names))

    return found.join(entries, ["name", "block"]).select("at", "found").mapInArrow(walk, RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages")))
