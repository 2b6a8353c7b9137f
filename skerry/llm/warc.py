"""Operator 1: WARC archives of individually compressed records with a trained Zstandard dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import new_path, released, small_batches

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: An archive is closed when its records have so many bytes before compression.
ARCHIVE_BYTES = 48 << 20
#: A dictionary has so many bytes at most and is trained on the archive's first records, to so many bytes.
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 4 << 20
LEVEL = 3


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, kind: str, refers_to, sha: str) -> bytes:
    """A WARC/1.1 record; a revisit has no block, and says how long its payload is."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}", f"WARC-X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    block = payload if kind == "response" else b""
    return "\r\n".join([*head, "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few or too small samples the samples themselves, which compress as raw content."""
    total = sum(map(len, samples))
    size = min(DICTIONARY_BYTES, total // 16)
    if len(samples) >= 16 and size >= 1024:
        try:
            return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too much alike or too few to train on
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


def archive(records: list[bytes]) -> bytes:
    """The skippable frame with the dictionary, then each record as a frame of its own."""
    samples, n = [], 0
    for r in records:
        if n >= SAMPLE_BYTES:
            break
        samples.append(r[: SAMPLE_BYTES - n])
        n += len(samples[-1])
    words = dictionary(samples)
    zd = zstandard.ZstdCompressionDict(words)
    z = zstandard.ZstdCompressor(level=LEVEL, dict_data=zd, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(words)), words, *map(z.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends: its header and block headers tell, nothing is decompressed."""
    end = at + zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        word = int.from_bytes(data[end : end + 3], "little")
        last = bool(word & 1)
        end += 3 + (1 if word >> 1 & 3 == 1 else word >> 3)  # a run of one byte holds that byte only
    return end + 4 * (data[at + 4] >> 2 & 1)  # a checksum


def read_archive(data: bytes):
    """Every record of an archive as (headers, block)."""
    at, z, view = 0, None, memoryview(data)
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic == DICTIONARY_MAGIC:
            z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        end = frame_end(view, at)
        raw = z.decompressobj().decompress(view[at:end])
        at = end
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def write_warc(pages: DataFrame, path: str, revisit_from: int = 0) -> DataFrame:
    """Writes a record for every row of (page_id, url, html) to archives under path, a URI that pyarrow's file systems reach from every executor.

    Of records with equal payloads of at least revisit_from bytes, that with the largest page_id is a response and the others revisit it; smaller payloads are
    all responses. html is stored in UTF-8, null as empty. Rows that repeat both the response's page_id and payload are responses too; a null page_id
    is below all others. Returns the manifest (archive, records, bytes) of the archives whose tasks succeeded, which is also kept as a
    Parquet table under path + "/manifest"; archives that a lost task left are not in it. Other columns are ignored.
    """
    spark = small_batches(pages.sparkSession)
    src = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    skinny = src.where(F.octet_length("html") >= revisit_from).select("page_id", "sha")
    best = skinny.groupBy("sha").agg(F.max("page_id").alias("best"))
    # only what revisits goes to the join with the pages
    revisits = skinny.distinct().join(best, "sha").where(~F.col("page_id").eqNullSafe(F.col("best"))).select(F.col("page_id").alias("rid"), F.col("sha").alias("rsha"), "best", F.lit(True).alias("again"))
    joined = src.join(revisits, F.col("page_id").eqNullSafe(F.col("rid")) & (F.col("sha") == F.col("rsha")), "left").select("page_id", "url", "html", "again", "best")

    @released
    def write(batches):
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        context, part, held, size = TaskContext.get(), 0, [], 0
        name = f"pages-{context.partitionId():06d}-{uuid.uuid4().hex[:12]}"

        def close():
            nonlocal part, held, size
            data, file = archive(held), f"{name}-{part:04d}.warc.zst"
            with store.open_output_stream(f"{root}/{file}.part", compression=None) as out:
                out.write(data)
            store.move(f"{root}/{file}.part", f"{root}/{file}")
            row = pa.RecordBatch.from_pydict({"archive": [file], "records": [len(held)], "bytes": [len(data)]}, schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
            part, held, size = part + 1, [], 0
            return row

        for batch in batches:
            for page_id, url, html, again, best in zip(*(batch.column(i).to_pylist() for i in range(5))):
                payload = html.encode()
                held.append(record(page_id, url, payload, "revisit" if again else "response", best, digest(payload)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if held:
            yield close()

    joined.mapInArrow(write, "archive string, records long, bytes long").write.parquet(f"{path}/manifest")
    return spark.read.schema("archive string, records long, bytes long").parquet(f"{path}/manifest")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in path's manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null for revisits).

    A response's size and digest are taken from its stored payload anew; a revisit's come from its header.
    """
    files = spark.read.schema("archive string, records long, bytes long").parquet(f"{path}/manifest")
    # an archive is a unit of work: spread them over the tasks
    files = files.select("archive").repartition(max(1, spark.sparkContext.defaultParallelism * 2))

    @released
    def read(batches):
        store, root = fs.FileSystem.from_uri(path)
        of = lambda x: int(x) if (x := x[len("<urn:page:") : -1]) else None
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])
        for batch in batches:
            for file in batch["archive"].to_pylist():
                with store.open_input_stream(f"{root}/{file}", compression=None) as f:
                    data = f.read()
                rows, size = [], 0
                for head, block in read_archive(data):
                    kind = head["WARC-Type"]
                    full = kind == "response"
                    rows.append((of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), len(block) if full else int(head["WARC-X-Payload-Length"]), digest(block) if full else head["WARC-Payload-Digest"].removeprefix("sha1:"), kind, None if full else of(head["WARC-Refers-To"]), block.decode() if full else None))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: op1 in DuckDB: 5 bits of the digest's 40 hexadecimal digits make a letter each.
SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((strpos('0123456789abcdef', x[5 * i // 4 + 1]) - 1) * 16 + strpos('0123456789abcdef', x[5 * i // 4 + 2]) - 1) >> (3 - i % 4)) % 32, 1)), '') AS payload_digest,
 CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM d"""
