"""What the operators of this subpackage share: durable intermediate tables, hashed words and shingles, linked groups."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer single text makes a pass of its own.
CHUNK_BYTES = 1 << 20
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine's, if Spark runs on this machine alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("skerry.shared.dir", "")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skerry-")
        spark.conf.set("skerry.shared.dir", base)
    return base.rstrip("/")


class _Named(threading.local):
    """Paths in the shared folder that this thread has named, in their order."""

    def __init__(self):
        self.paths: list[str] = []


_named = _Named()


def new_path(spark: SparkSession, name: str) -> str:
    _named.paths.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _named.paths[-1]


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it back: later stages don't compute it again, nor lose it with an executor."""
    return stored(df, new_path(df.sparkSession, name))


def cut_alone(df: DataFrame, name: str, since: int) -> DataFrame:
    """As cut; then drops all that this thread has named in the shared folder after the first `since` paths (see named_paths): what df was made of."""
    out = cut(df, name)
    for path in _named.paths[since:-1]:
        drop_path(df.sparkSession, path)
    del _named.paths[since:-1]
    return out


def named_paths() -> int:
    return len(_named.paths)


#: Rows of an Arrow batch at most, where texts are read: batches are otherwise of ten thousand rows, however long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """Bounds the session's Arrow batches by BATCH_ROWS."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    return spark


def released(run):
    """run, a function from batches to batches in a task, gives memory back when it ends: workers live on for other tasks, and what they have freed otherwise stays theirs."""

    @functools.wraps(run)
    def wrapped(batches, *args, **kwargs):
        try:
            yield from run(batches, *args, **kwargs)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if _trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
                _trim(0)

    return wrapped


def grouped(batches, column: str, most: int):
    """Lists of batches with so many bytes in a column, or the first batch beyond."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch[column].nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that part words where punctuation doesn't count: all of ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BYTE = mix(_LOWER)
_POW = np.cumprod(np.full(256, 0x5851F42D4C957F2D, np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = np.cumprod(np.full(max(n, 2 * len(_POW)), 0x5851F42D4C957F2D, np.uint64))
    return _POW


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copies and each row's offsets in them; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if offsets else np.zeros(len(col) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), off


def chunks(col: pa.Array, most: int = CHUNK_BYTES):
    """Runs (first row, end row) of a string column with at most so many bytes, one row at least."""
    _, off = text_bytes(col)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, len(col))
        i = j


def words(col: pa.Array, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row, by default [^\\x20\\x09-\\x0D]+: (words before each row and in all, start byte in its row, end byte, 64-bit hash with A-Z lower-cased)."""
    data, off = text_bytes(col)
    base = int(off[0])
    b, off = data[base : int(off[-1])], off - base
    if not len(b):
        z = np.zeros(0, np.int64)
        return np.zeros(len(off), np.int64), z, z, np.zeros(0, np.uint64)
    space = apart[b]
    first = np.ones(len(b) + 1, bool)
    first[1:-1] = space[:-1]
    first[off] = True
    start = np.flatnonzero(~space & first[:-1])
    last = np.ones(len(b) + 1, bool)
    last[:-1] = space
    last[off] = True
    end = np.flatnonzero(~space & last[1:]) + 1
    if not len(start):
        z = np.zeros(0, np.int64)
        return np.zeros(len(off), np.int64), z, z, np.zeros(0, np.uint64)
    length = end - start
    rank = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[b[~space]] * _powers(int(length.max()))[rank], np.cumsum(length) - length)
    before = np.searchsorted(start, off)
    shift = np.repeat(off[:-1], np.diff(before))
    return before, start - shift, end - shift, mix(h)


def shingle_hashes(before: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles before each row, hashes) of n successive words; a row with fewer words has them all as one, a row without words none."""
    count = np.diff(before)
    many = np.where(count == 0, 0, np.maximum(1, count - n + 1))
    ptr = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(before[:-1], many) + np.arange(ptr[-1]) - np.repeat(ptr[:-1], many)
    size = np.repeat(np.minimum(count, n), many)
    out = mix(size.astype(np.uint64))
    with np.errstate(over="ignore"):
        for m in np.unique(size).tolist():
            rows = slice(None) if m == n and size.min() == n else np.flatnonzero(size == m)
            first, some = at[rows], out[rows]
            for j in range(m):
                some = mix(some * np.uint64(31) + h[first + j])
            out[rows] = some
    return ptr, out


def shingle_sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(pointer, hashes): every row's distinct shingles in ascending order of their 64-bit hash."""
    before, _, _, h = words(col)
    ptr, s = shingle_hashes(before, h, n)
    row = np.repeat(np.arange(len(ptr) - 1, dtype=np.int64), np.diff(ptr))
    for i, j in zip(ptr[:-1], ptr[1:]):
        s[i:j].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(ptr) - 1))]).astype(np.int64), s[keep]


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


#: Bits of a map of bit_map at least and at most. Maps only save work: values that share a bit are told apart later.
MAP_BITS = (1 << 20, 1 << 28)


def bit_map(df: DataFrame, column: str, values: int) -> np.ndarray:
    """A map of bits of the values in a long column, by their lowest bits; it has 8 bits or more for each of so many values, up to MAP_BITS, which bounds what the driver gathers."""
    bits = min(MAP_BITS[1], max(MAP_BITS[0], 1 << (8 * values).bit_length()))
    low = df.select((F.col(column).bitwiseAND(F.lit(bits - 1)) + 1).alias("bit"))  # Spark's maps start at 1
    out = np.zeros(bits // 8, np.uint8)
    for bucket, found in low.groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).collect():
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(found, np.uint8)
    return out


def in_map(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    v = (values & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[v >> 3] >> (v & 7).astype(np.uint8)) & 1 > 0


def _files(path: str, equal: dict) -> tuple[fs.FileSystem, list[str]]:
    store, root = fs.FileSystem.from_uri(path)
    for k, v in equal.items():  # in the order of the partitions: only their folder is listed
        root = f"{root}/{k}={v}"
    return store, [f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file and f.base_name.endswith(".parquet")]


def batches_of(path: str, columns: list[str], most: int, **equal):
    """As read_rows, in batches of so many rows at most: whole columns are never held."""
    store, files = _files(path, equal)
    for f in files:
        with store.open_input_file(f) as at:
            yield from pq.ParquetFile(at, buffer_size=1 << 20).iter_batches(most, columns=columns)


def read_rows(path: str, columns: list[str], **equal) -> pa.Table:
    """Rows of a small Parquet table in the shared folder, as a task reads them; equal picks values of columns that it is partitioned by."""
    store, files = _files(path, equal)
    return pa.concat_tables([pq.ParquetFile(store.open_input_file(f)).read(columns) for f in files]) if files else pa.table({c: [] for c in columns})


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Edges that keep the linked groups of n nodes: at most n - 1 of the given pairs."""
    top = list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


#: Edges that a task links at once before they are shuffled.
LINKED_AT_ONCE = 200_000


def local_stars(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same linked groups: every stretch of a task's edges is replaced by stars around its groups' smallest nodes."""
    schema = edges.schema

    def run(batches):
        kind, top = None, {}

        def find(x):
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        def stars():
            rows = [(x, r) for x in top if (r := find(x)) != x]
            back = (lambda x: dict(zip(kind.names, x))) if pa.types.is_struct(kind) else (lambda x: x)
            return pa.RecordBatch.from_arrays([pa.array([back(r[i]) for r in rows], kind) for i in (0, 1)], ["u", "v"])

        def plain(column):
            return list(zip(*(column.field(i).to_pylist() for i in range(column.type.num_fields)))) if pa.types.is_struct(column.type) else column.to_pylist()

        for batch in batches:
            kind = batch["u"].type
            for u, v in zip(plain(batch["u"]), plain(batch["v"])):
                top.setdefault(u, u)
                top.setdefault(v, v)
                x, y = find(u), find(v)
                if x != y:
                    top[max(x, y)] = min(x, y)
            if len(top) > LINKED_AT_ONCE:
                yield stars()
                top.clear()
        if top:
            yield stars()

    return edges.mapInArrow(run, schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (a, b), component the smallest node reachable.

    Alternating large and small stars; each round goes to the shared folder. Tasks link what they hold before it is shuffled, so that few rounds are needed. Every
    round groups and joins on nodes, and the joined side has one row a node, so a hub's rows can be split over tasks.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    edges = stored(local_stars(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v")).distinct(), path)
    print_of = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    seen = edges.agg(*print_of).first()
    for _ in range(max_rounds):
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("CASE WHEN v = m THEN u ELSE v END AS u", "m AS v").where("u <> v")
        last, path = path, new_path(spark, "edges")
        edges = stored(local_stars(small).distinct(), path)
        drop_path(spark, last)
        now = edges.agg(*print_of).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("linked groups did not settle")
    return edges.selectExpr("u AS node", "v AS component").unionByName(edges.selectExpr("v AS node", "v AS component").distinct())
