"""Operator 9: bytes of repeated long strings, by suffix arrays of shards built with induced sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import as_long, bit_map, chunks, cut, in_map, mix, released, small_batches, text_bytes

LENGTH = 200
#: Bytes of an anchor. Every string of LENGTH bytes has LENGTH - ANCHOR + 1 of them, and is filed under the one with the least hash.
ANCHOR = 40
#: A shard's suffix array is built over so many bytes or so; an anchor whose surroundings have more than HOT_BYTES is compared window by window.
SHARD_BYTES, HOT_BYTES = 1 << 20, 1 << 20
_SEED = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = mix(np.arange(900, 910, dtype=np.uint64)) | np.uint64(1)


# Suffix arrays -----------------------------------------------------------------------------------------------------------------------------------------------


def _induce(s: np.ndarray, sa: np.ndarray, ends: np.ndarray, smaller: np.ndarray) -> None:
    """Fills sa, which has sorted leftmost-smaller suffixes at their buckets' ends, with all suffixes: larger ones from the left, then smaller ones from the right.

    A bucket is read in runs: what a run adds to its own bucket is the next run.
    """
    starts = np.concatenate([[0], ends[:-1]])
    for forward in (True, False):
        kept = np.concatenate([[0], np.cumsum(np.bincount(s[~smaller], minlength=len(ends)))])
        larger = starts + np.diff(kept)  # where a bucket's smaller suffixes begin
        free = starts.copy() if forward else ends.copy()
        for c in range(len(ends)) if forward else range(len(ends) - 1, -1, -1):
            if starts[c] == ends[c]:
                continue
            if forward:
                done, rest = starts[c], (larger[c], ends[c])
            else:
                done, rest = ends[c], (starts[c], larger[c])
            while True:
                if (now := free[c]) != done:
                    run, done = (sa[done:now], now) if forward else (sa[now:done][::-1], now)
                elif rest is not None:
                    run = sa[rest[0] : rest[1]] if forward else sa[rest[0] : rest[1]][::-1]
                    run, rest = run[run >= 0], None
                else:
                    break
                before = run[run > 0] - 1
                before = before[smaller[before] != forward]
                if not len(before):
                    continue
                into = s[before]
                order = np.argsort(into, kind="stable")
                before, into = before[order], into[order]
                first = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]]))
                size = np.diff(np.append(first, len(into)))
                rank = np.arange(len(into)) - np.repeat(first, size)
                if forward:
                    sa[free[into] + rank] = before
                    free[into[first]] += size
                else:
                    sa[free[into] - 1 - rank] = before
                    free[into[first]] -= size
        if forward:  # the leftmost-smaller ones have served; smaller suffixes come anew
            sa[smaller[sa]] = -1
            sa[0] = len(sa) - 1


def suffix_array(text: np.ndarray, reach: int) -> np.ndarray:
    """Suffixes of text (small positive integers) in the order of their first `reach` symbols at least.

    Suffixes are classified as smaller or larger than the next; leftmost-smaller substrings are sorted by induction and named; names are sorted recursively, in pairs
    of doubled reach, until they differ or reach far enough; then they induce all suffixes in linear time.
    """
    s = np.append(text.astype(np.int64), 0)
    n = len(s)
    same = np.append(s[1:] == s[:-1], False)
    rise = np.append(s[:-1] < s[1:], True)
    change = np.flatnonzero(~same)
    smaller = rise[change[np.searchsorted(change, np.arange(n))]]
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ends = np.cumsum(np.bincount(s))

    def placed(order: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1)
        c = s[order]
        by = np.argsort(c, kind="stable")
        group = np.cumsum(np.bincount(c, minlength=len(ends)))[c[by]]
        sa[ends[c[by]] - (group - np.arange(len(by)))] = order[by]
        _induce(s, sa, ends, smaller)
        return sa

    sa = placed(lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    # equal substrings get equal names: compare neighbours symbol by symbol up to their ends
    stop = np.append(lms[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[lms] = stop - lms + 1
    a, b = order[:-1], order[1:]
    equal = length[a] == length[b]
    live = np.flatnonzero(equal)
    k = 0
    while len(live):
        live = live[length[a[live]] > k]
        differ = s[a[live] + k] != s[b[live] + k]
        equal[live[differ]] = False
        live = live[~differ]
        k += 1
    name = np.zeros(n, np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~equal)])
    rank, span = name[lms], 1
    while len(lms) > 1 and rank.max() < len(lms) - 1 and span <= reach:
        pair = rank * (rank.max() + 2) + np.append(rank[span:] + 1, np.zeros(min(span, len(rank)), np.int64))[: len(rank)]
        rank = np.unique(pair, return_inverse=True)[1]
        span *= 2
    return placed(lms[np.argsort(rank, kind="stable")])


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, length): for each position, the suffix sorted before it and how long a prefix they share, exact up to `most`.

    In text order the lengths fall by one at most, so only those are compared whose left neighbours differ, and others follow from them.
    """
    n = len(text)
    before = np.full(n + 1, n)
    before[sa[1:]] = sa[:-1]
    before = before[:n]
    wide = np.append(text, np.zeros(most + 8, text.dtype))
    left = np.append(np.append(text, -2)[before - 1], 0)[:n]
    own = np.concatenate([[-1], text[:-1]])
    fresh = np.flatnonzero((before == 0) | (np.arange(n) == 0) | (left != own) | (before == n))
    size = np.zeros(len(fresh), np.int64)
    live = np.flatnonzero(before[fresh] < n)
    k = 0
    while len(live) and k < most:
        p, q = fresh[live], before[fresh[live]]
        ok = (np.maximum(p, q) + k < n) & (wide[p + k] == wide[q + k])
        live = live[ok]
        k += 1
        size[live] = k
    length = np.zeros(n, np.int64)
    at = np.maximum.accumulate(np.where(np.isin(np.arange(n), fresh), np.arange(n), 0))
    value = np.zeros(n, np.int64)
    value[fresh] = size
    length = np.maximum(0, value[at] - (np.arange(n) - at))
    return before, length


def repeated_starts(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string, which of its substrings of that length also start anywhere else in the strings."""
    size = np.array([len(x) for x in strings])
    at = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 2
    text[at[1:] - 1] = 1
    sa = suffix_array(text, length)
    before, shared = common_prefixes(text, sa, 2 * int(size.max()) + 2)
    again = np.zeros(len(text) + 1, bool)
    long = shared >= length
    again[:-1] |= long
    again[before[long]] = True
    return [again[i : i + max(0, n - length + 1)] for i, n in zip(at, size)]


# Anchors -------------------------------------------------------------------------------------------------------------------------------------------------------


def anchors(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, anchor hash) of every run of windows with one anchor; positions in b. off parts b into texts; b has under 2^24 bytes."""
    none = np.zeros(0, np.int64)
    if len(b) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = {1: _SEED[b]}
        for k in (1, 2, 4, 8, 16):
            x = h[k]
            h[2 * k] = x[:-k] * _STEP[k.bit_length()] + x[k:]
            if k not in (4,):
                h.pop(k, None) if k != 8 else None
        f = mix(h[32][: len(b) - ANCHOR + 1] * _STEP[0] + h[8][32:][: len(b) - ANCHOR + 1])
    least = (f & ~np.uint64((1 << 24) - 1)) | np.arange(len(f), dtype=np.uint64)
    width = LENGTH - ANCHOR + 1
    k = 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < width:
        least = np.minimum(least[: len(least) - (width - k)], least[width - k :])
    size = np.maximum(0, np.diff(off) - LENGTH + 1)
    window = np.repeat(off[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    if not len(window):
        return none, none, none, none.astype(np.uint64)
    row = np.repeat(np.arange(len(size)), size)
    p = (least[window] & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(first[1:], len(p)) - 1
    return row[first], window[first], window[last], f[p[first]]


def pieces(col: pa.Array):
    """(first row, end row, bytes, offsets, bytes of the row before these): chunks of whole texts, and parts of a very long text with all its windows."""
    for i, j in chunks(col):
        data, off = text_bytes(col.slice(i, j - i))
        b, off = data[off[0] : off[-1]], off - off[0]
        if j - i > 1 or len(b) < 1 << 23:
            yield i, j, b, off, 0
            continue
        for at in range(0, max(1, len(b) - LENGTH + 1), 1 << 22):
            part = b[at : at + (1 << 22) + LENGTH - 1]
            yield i, j, part, np.array([0, len(part)]), at


def text_keys(col: pa.Array) -> np.ndarray:
    """Two 64-bit keys of every text."""
    data, off = text_bytes(col)
    raw = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(off[:-1], off[1:]))
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left) of every row of docs.

    Texts are UTF-8 bytes, null as empty. Removed is every byte covered by a string of LENGTH bytes that also starts anywhere else, in the same text or another; overlaps count,
    strings are judged on the input, and none crosses texts. Repeated rows and copies are each other's repeats, so that of LENGTH bytes or more nothing stays; null ids are rows
    like others. Other columns are ignored.

    A text's windows are filed under anchors that their bytes determine, so that equal windows meet under equal anchors with their surroundings. Anchors that occur once are left out.
    Surroundings are counted once for all copies; different ones of the same anchor go to shards, whose suffix arrays find the windows that repeat. An anchor with very many
    different surroundings is dealt out again, a window at a time. Texts with removals, but for copies, are then joined with their spans.
    """
    spark = small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = src.select("text")

    @released
    def digests(batches):
        for batch in batches:
            for i, j in chunks(batch["text"], 8 << 20):
                col = batch["text"].slice(i, j - i)
                t, (data, off) = text_keys(col), text_bytes(col)
                yield pa.RecordBatch.from_arrays([batch["id"].slice(i, j - i), as_long(t[:, 0].copy()), as_long(t[:, 1].copy()), pa.array(np.diff(off)), pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:])], pa.string())], ["id", "t1", "t2", "n_bytes", "sha"])

    rows = cut(src.mapInArrow(digests, f"id {kind}, t1 long, t2 long, n_bytes long, sha string"), "digests")

    @released
    def count_anchors(batches):
        for batch in batches:
            for _, _, b, off, _ in pieces(batch["text"]):
                f, n = np.unique(anchors(b, off)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([as_long(f), pa.array(n)], ["f", "n"])

    again = texts.mapInArrow(count_anchors, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).where("n > 1")
    windows_of = rows.agg(F.sum("n_bytes")).first()[0] or 0
    # an anchor is the least of its window's for 80 bytes or so, and counts if it occurs twice
    sent = spark.sparkContext.broadcast(bit_map(again, "f", windows_of // 160))

    @released
    def surroundings(batches):
        seen_texts: set[int] = set()
        seen: set[int] = set()
        for batch in batches:
            keys = text_keys(batch["text"])
            new = np.array([k not in seen_texts and not seen_texts.add(k) for k in keys[:, 0].tolist()], bool)  # copies in one task repeat the first: see `copied`
            for i, _, b, off, at in pieces(batch["text"]):
                row, lo, hi, f = anchors(b, off)
                some = in_map(sent.value, f) & new[i + row]
                row, lo, hi, f = (x[some] for x in (row, lo, hi, f))
                around = [b[x : y + LENGTH].tobytes() for x, y in zip(lo, hi)]
                c = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in around], np.uint64)
                fresh = [k not in seen and not seen.add(k) for k in (c ^ f).tolist()]
                if len(seen) > 500_000:
                    seen.clear()
                start = lo - off[row] + at
                yield pa.RecordBatch.from_arrays([as_long(keys[i + row, 0]), as_long(keys[i + row, 1]), as_long(f), as_long(c), pa.array(start), pa.array(start + hi - lo), pa.array([x if y else None for x, y in zip(around, fresh)], pa.binary())], ["t1", "t2", "f", "c", "lo", "hi", "around"])
            if len(seen_texts) > 200_000:
                seen_texts.clear()

    found = cut(texts.mapInArrow(surroundings, "t1 long, t2 long, f long, c long, lo long, hi long, around binary"), "anchors")
    contexts = cut(found.groupBy("f", "c").agg(F.count("*").alias("n"), F.first("around", ignorenulls=True).alias("around")), "contexts")
    by_anchor = contexts.groupBy("f").agg(F.count("*").alias("m"), F.sum("n").alias("all"), F.sum(F.length("around")).alias("size")).where("all > 1")
    held = contexts.join(by_anchor, "f")
    whole = held.where("n > 1").select("f", "c", F.lit(0).cast("long").alias("a"), (F.length("around") - LENGTH).cast("long").alias("z"))

    @released
    def shards(batches):
        part: list[tuple] = []
        size = 0

        def close():
            f, c, n, strings = zip(*part)
            out = []
            for x, y, k, again in zip(f, c, n, repeated_starts(list(strings))):
                if k == 1 and again.any():  # the others are in `whole`
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
                    out += [(x, y, int(u), int(v) - 1) for u, v in zip(edge[::2], edge[1::2])]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (zip(*out) if out else ([],) * 4)], ["f", "c", "a", "z"])

        for batch in batches:
            for f, c, n, around in zip(*(batch[k].to_pylist() for k in ("f", "c", "n", "around"))):
                if size > SHARD_BYTES and part[-1][0] != f:
                    yield close()
                    part, size = [], 0
                part.append((f, c, n, around))
                size += len(around)
        if part:
            yield close()

    cold = held.where((F.col("m") > 1) & (F.col("size") <= HOT_BYTES)).select("f", "c", "n", "around").repartition("f").sortWithinPartitions("f").mapInArrow(shards, "f long, c long, a long, z long")

    @released
    def windows(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                f, c, n, a, w1, w2 = [], [], [], [], [], []
                for x, y, m, around in zip(*(some[v].to_pylist() for v in ("f", "c", "n", "around"))):
                    for i in range(len(around) - LENGTH + 1):
                        d = hashlib.blake2b(around[i : i + LENGTH], digest_size=16).digest()
                        f.append(x), c.append(y), n.append(m), a.append(i)
                        w1.append(int.from_bytes(d[:8], "little", signed=True)), w2.append(int.from_bytes(d[8:], "little", signed=True))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (f, c, n, a, w1, w2)], ["f", "c", "n", "a", "w1", "w2"])

    spread = held.where((F.col("m") > 1) & (F.col("size") > HOT_BYTES)).select("f", "c", "n", "around").repartition("f", "c").mapInArrow(windows, "f long, c long, n long, a long, w1 long, w2 long")
    same = spread.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1")
    hot = spread.join(same.select("w1", "w2"), ["w1", "w2"]).where("n = 1").select("f", "c", "a", F.col("a").alias("z"))

    hits = cut(whole.unionByName(cold).unionByName(hot), "hits")
    copied = rows.groupBy("t1", "t2").agg(F.count("*").alias("copies"))
    spans = found.join(hits, ["f", "c"]).select("t1", "t2", F.struct((F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("z") + LENGTH).alias("z")).alias("span")).groupBy("t1", "t2").agg(F.collect_list("span").alias("spans"))
    once = copied.where("copies = 1").join(spans, ["t1", "t2"]).select("t1", "t2", "spans")
    once = cut(once, "spans")
    wanted = spark.sparkContext.broadcast(bit_map(once, "t1", once.count()))

    @released
    def bring(batches):
        for batch in batches:
            keys = text_keys(batch["text"])
            some = pa.array(in_map(wanted.value, keys[:, 0].copy()))
            yield pa.RecordBatch.from_arrays([as_long(keys[:, 0].copy()).filter(some), as_long(keys[:, 1].copy()).filter(some), batch["text"].filter(some)], ["t1", "t2", "text"])

    @released
    def strip(batches):
        for batch in batches:
            out = []
            for t1, t2, text, spans in zip(*(batch[k].to_pylist() for k in ("t1", "t2", "text", "spans"))):
                raw, kept, at, removed, runs = text.encode(), [], 0, 0, 0
                for a, z in sorted((s["a"], s["z"]) for s in spans):
                    if a > at or not runs:
                        kept.append(raw[at:a])
                        runs += 1
                        removed += z - a
                    else:
                        removed += max(0, z - at)
                    at = max(at, z)
                kept = b"".join([*kept, raw[at:]])
                out.append((t1, t2, removed, runs, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([],) * 5, (pa.int64(),) * 4 + (pa.string(),))], ["t1", "t2", "n_removed", "n_spans", "kept_sha256"])

    answer = texts.mapInArrow(bring, "t1 long, t2 long, text string").join(once, ["t1", "t2"]).mapInArrow(strip, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string")
    out = rows.join(copied.where(F.col("copies") > 1), ["t1", "t2"], "left").join(answer, ["t1", "t2"], "left")
    gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH)
    none = hashlib.sha256(b"").hexdigest()
    cols = [F.col("id").alias(id_col), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(gone, none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")]
    return out.select(*cols)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
