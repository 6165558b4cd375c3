"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id into shards whose number follows the payload bytes; a shard is one
task that writes gzip members (one a record, without time stamps) and rolls to the next file by
compressed size. Headers, digests and record ids are made anew from the rows, so the same rows
give the same bytes. Each attempt of a task writes under names of its own; only the names that
the successful attempts report reach the manifest, a second job renames these to their final
names (again and again without harm), and readers see final names alone. A lost executor thus
leaves at most stray temporary files. A later write into the same folder replaces the files of the
one before: equal names are exchanged and those that the new manifest lacks are deleted. It is
safe to repeat, but while it runs a reader may meet files of both.

Of records with equal payloads of at least ``least`` bytes the one with the smallest id is the
response and the others are revisits of it, without a body; shorter ones are all responses.

Edge cases: null html is an empty payload; a null url is an empty target; rows repeated in id
and payload: the first in sort order is the response; records without an id come last and are a
response only if no equal payload has an id; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, scratch_path, staged

SHARD_BYTES = 32 << 20  # payload bytes of a shard
ROLL_BYTES = 16 << 20  # compressed bytes after which a file ends
BROADCAST_ROWS = 100_000  # repeated payloads (a digest and an id each) that may be broadcast
DATE = "2000-01-01T00:00:00Z"  # records carry no clock time, so that files repeat
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "temporary string, final string, records long, bytes long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, n: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{n}')}>"


def record(page_id, url: str, payload: bytes, digest: str, first, n: int, response: bool) -> bytes:
    """One WARC record; ``first`` is the id of the response, ``n`` counts equal rows."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, n)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if not response:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(archive: bytes):
    """(headers, block) of every record of one file."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive)), 1 << 20)
    while line := f.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while line := f.readline().strip():
            k, _, v = line.decode().partition(":")
            head[k] = v.strip()
        block = f.read(int(head["Content-Length"]))
        if f.read(4) != b"\r\n\r\n" or head["WARC-Block-Digest"] != "sha1:" + sha1_base32(block):
            raise ValueError(f"damaged record {head.get('WARC-Record-ID')}")
        yield head, block


def _writer(folder: str, least: int, roll: int):
    def write(batches):
        fs, root = FileSystem.from_uri(folder)
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        done, out, size, count, last = [], None, 0, 0, None

        def close():
            out.close()
            final = f"part-{shard:06d}-{len(done):05d}.warc.gz"
            done.append((f".{final}.{attempt}.tmp", final, count, size))

        for b in batches:
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in b.columns)):
                n = last[2] + 1 if last and last[:2] == (page_id, digest) else 0
                last = (page_id, digest, n)
                response = len(payload) < least or (page_id == first and n == 0)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(record(page_id, url or "", payload, digest, first, n, response)) + pack.flush()
                if out is None:
                    out, size, count = fs.open_output_stream(f"{root}/.part-{shard:06d}-{len(done):05d}.warc.gz.{attempt}.tmp"), 0, 0
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["temporary", "final", "records", "bytes"])

    return write


def _committer(folder: str):
    def commit(batches):
        fs, root = FileSystem.from_uri(folder)
        for b in batches:
            for old, new in zip(*(c.to_pylist() for c in b.select(["temporary", "final"]).columns)):
                # without its temporary file a name has been exchanged by an earlier attempt
                if fs.get_file_info(f"{root}/{old}").type.name != "NotFound":
                    if fs.get_file_info(f"{root}/{new}").type.name != "NotFound":
                        fs.delete_file(f"{root}/{new}")
                    fs.move(f"{root}/{old}", f"{root}/{new}")
            yield b

    return commit


def _remover(folder: str):
    def remove(batches):
        fs, root = FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column("final").to_pylist():
                if fs.get_file_info(f"{root}/{name}").type.name != "NotFound":
                    fs.delete_file(f"{root}/{name}")
            yield b

    return remove


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0, roll: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` as the WARC files of ``folder``; returns the manifest."""
    spark = prepare(pages.sparkSession)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))

    @F.arrow_udf("string")
    def payload_digest(col: pa.Array) -> pa.Array:
        return pa.array([sha1_base32(x.as_py()) for x in col], pa.string())

    base = base.withColumn("digest", payload_digest("payload"))
    sums = [F.min("page_id").alias("first"), F.sum(F.length("payload").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("n")]
    groups = staged(base.groupBy("digest").agg(*sums), "payloads")
    total, repeated = groups.agg(F.sum("bytes"), F.count_if(F.col("n") > 1)).first()
    shards = max(1, -(-(total or 0) // SHARD_BYTES))
    # only payloads that repeat have to be looked up; few of them need no shuffle of the payloads
    known = groups.where("n > 1").select(F.col("digest").alias("__d"), "first")
    known = F.broadcast(known) if repeated <= BROADCAST_ROWS else known
    first = F.when(F.col("__d").isNotNull(), F.col("first")).otherwise(F.col("page_id"))
    rows = base.join(known, base["digest"] == known["__d"], "left").select("page_id", "url", "payload", "digest", first.alias("first"))
    order = [F.col("page_id").asc_nulls_last(), F.col("digest")]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "url")
    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    older = fs.get_file_info(f"{root}/_manifest").type.name != "NotFound"
    # names alone, kept apart as the manifest is overwritten
    older = staged(spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("final"), "older") if older else None
    rows.mapInArrow(_writer(folder, least, roll), MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    manifest.mapInArrow(_committer(folder), MANIFEST).agg(F.sum("records")).first()
    if older is not None:
        older.join(manifest, "final", "left_anti").mapInArrow(_remover(folder), "final string").agg(F.count("final")).first()
        discard(older)
    discard(groups)
    return manifest


def read_warc(spark, folder: str) -> DataFrame:
    """One row per record: page_id, record_id, record_type, url, refers_to_record, payload, digest.

    A revisit's payload is null; that of the record it refers to is its own.
    """
    schema = "page_id long, record_id string, record_type string, url string, refers_to_record string, payload binary, digest string"
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches):
        for b in batches:
            for archive in b.column("content"):
                rows, size = [], 0
                for head, block in parse(archive.as_py()):
                    kind, page_id = head["WARC-Type"], head.get("X-Page-Id")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    digest = sha1_base32(payload) if kind == "response" else head["WARC-Payload-Digest"].removeprefix("sha1:")
                    rows.append((None if page_id is None else int(page_id), head["WARC-Record-ID"], kind, head["WARC-Target-URI"], head.get("WARC-Refers-To"), payload, digest))
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], arrow)

    arrow = pa.schema([(n, pa.int64() if n == "page_id" else pa.binary() if n == "payload" else pa.string()) for n in names])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("content").mapInArrow(read, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write the archives, read them back and resolve revisits: id, payload_bytes,
    payload_digest, record_type, refers_to of every record."""
    spark = prepare(pages.sparkSession)
    folder = folder or scratch_path(spark, "warc")
    write_warc(pages, folder, id_col, url, html, least)
    records = read_warc(spark, folder).select("page_id", "record_id", "record_type", "refers_to_record", F.length("payload").cast("long").alias("bytes"), "digest")
    records = staged(records, "records")
    own = records.where("record_type = 'response'")
    seen = own.groupBy(F.col("record_id").alias("__r")).agg(F.min("page_id").alias("__p"), F.min("bytes").alias("__b"), F.min("digest").alias("__g"))
    revisits = records.where("record_type = 'revisit'")
    revisits = revisits.join(seen, revisits["refers_to_record"] == seen["__r"], "left")
    out = own.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    out = out.unionByName(revisits.select("page_id", F.col("__b").alias("payload_bytes"), F.col("__g").alias("payload_digest"), "record_type", F.col("__p").alias("refers_to")))
    return out.withColumnRenamed("page_id", id_col)
