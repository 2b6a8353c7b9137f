"""Operator 6: exact Jaccard self-join on word shingles by PartEnum signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm.common import as_long, bit_map, chunks, components, cut, forest, in_map, mix, released, shingle_sets, small_batches

#: Second level of PartEnum: so many parts in each first-level partition, of which one may differ.
PARTS = 3
#: One first-level partition more than need be for so many differences, so that signatures of few shingles can be left out.
SPARE = 8
#: A block of compared sets has about so many sets and so many shingles at most (a longer set makes a block of its own).
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
#: Sets that share signatures under one smallest set are sifted pair by pair in blocks of so many or so. A task that holds HELD signatures of one bucket links groups of more without sifting.
SIFTED = 4096
#: Words of bit maps that one numpy pass compares.
AT_ONCE = 1 << 19
#: Sets of a cluster's size band, about, that are compared with all its blocks at first.
ANCHORS = 8
#: Keys of so many rows may be sent to all tasks.
BROADCAST_ROWS = 1_000_000
#: Signatures that a task gathers before it deals them out, that a bucket has or so, and that a task holds of one bucket before it links the largest groups.
GATHERED, BUCKET, HELD = 1 << 19, 1 << 18, 1 << 23
#: Of a signature that so many sets of one task's share, all but one are linked to that one at once.
SHARED_AT_ONCE = 512
#: Bits of a set's key that candidates carry; sets that share them only meet in a cluster more.
KEY_BITS = 40
#: Groups of so many are compared as whole numbers, larger ones as arrays.
FEW = 8


def bands(num: int, den: int, most: int) -> np.ndarray:
    """First sizes of the size bands: sets in bands more than one apart can't reach num / den."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * den // num + 1)
    return np.array([*out, out[-1] * den // num + 1], np.int64)


def set_keys(ptr: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of every set, that don't depend on order."""
    n = np.diff(ptr)
    sums = np.zeros((2, len(n)), np.uint64)
    if len(s):
        at = np.minimum(ptr[:-1], len(s) - 1)
        for i in range(2):
            sums[i] = np.where(n > 0, np.add.reduceat(mix(s + np.uint64(i + 1)), at), np.uint64(0))
    with np.errstate(over="ignore"):
        return tuple(mix(x ^ (n.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))) for x in sums)


def signatures(ptr: np.ndarray, s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature): sets with |A & B| / |A | B| >= num / den share one at least.

    A set in size band i signs for bands i and i + 1. Two sets of band b, or of b - 1 and b, differ in at most k shingles, so that of n1 partitions of the shingles m = n1 - k // 2 have
    one difference at most, and of such a partition's 3 parts two have none: each two parts of a partition make a signature. Signatures of fewer than c shingles, which strangers
    share, are left out by sets that are safe at c: those with fewer than m partitions where two parts could have fewer than c. Each set takes the largest c, up to a bound, at
    which it is safe, or else makes all (c = 0). Of two sets, the one of larger c has in one of their m partitions a signature of c shingles that both have and neither leaves out.
    """
    n = np.diff(ptr)
    edge = bands(num, den, int(n.max(initial=1)))
    own = np.searchsorted(edge, n, "right") - 1
    rows, sigs = [], []
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s))])
    for step in (0, 1):
        band = own + step
        top = edge[np.minimum(band + 1, len(edge) - 1)] - 1
        k = (den - num) * 2 * top // (den + num)
        groups = np.where(k == 0, 1, k // 2 + 1 + -(-k // SPARE))
        least = np.where(k == 0, 0, np.clip(top // groups // PARTS, 1, PARTS))
        parts = np.where(n > 0, np.where(k == 0, 1, groups * PARTS), 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        per = np.repeat(parts, n).astype(np.uint64)
        slot = np.repeat(base[:-1], n) + (((s >> np.uint64(32)) * per) >> np.uint64(32)).astype(np.int64)
        count = np.bincount(slot, minlength=base[-1])
        end = np.cumsum(count)  # slots ascend with the shingles
        sums = upto[end] - upto[end - count]
        row = np.repeat(np.arange(len(n)), parts)
        pos = np.arange(base[-1]) - np.repeat(base[:-1], parts)
        keep = np.ones(len(row), bool)
        many = np.flatnonzero((pos % PARTS == 0) & (parts[row] > 1))
        with np.errstate(over="ignore"):
            if len(many):
                third = many[:, None] + np.arange(PARTS)
                each = count[third]
                total, owner = each.sum(1), row[many]
                sums[third] = sums[third].sum(1, dtype=np.uint64)[:, None] - sums[third]
                two, level = total - each.max(1), np.zeros(len(n), np.int64)
                for c in range(1, PARTS + 1):
                    level[(np.bincount(owner, two < c, len(n)) < groups - k // 2) & (c <= least)] = c
                keep[third] = total[:, None] - each >= level[owner][:, None]
            sig = mix(sums ^ mix(band[row].astype(np.uint64) * np.uint64(1 << 40) + pos.astype(np.uint64)))
        rows.append(row[keep])
        sigs.append(sig[keep])
    return np.concatenate(rows), np.concatenate(sigs)


def bit_sets(ptr: np.ndarray, s: np.ndarray) -> list[bytes]:
    """Each set as a map of bits, one or two a shingle, in whole powers of two: a bit is set if an odd number of shingles fall on it. A map of half the size is the sum of its halves, without carry."""
    n = np.diff(ptr)
    log = np.maximum(6, np.ceil(np.log2(np.maximum(1, n))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(1 << (log - 3))])
    out = np.zeros(base[-1], np.uint8)
    at = (mix(s + np.uint64(99)) & np.repeat((np.uint64(1) << log.astype(np.uint64)) - np.uint64(1), n)).astype(np.int64)
    np.bitwise_xor.at(out, np.repeat(base[:-1], n) + (at >> 3), (1 << (at & 7)).astype(np.uint8))
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(base[:-1], base[1:])]


def near_by_bits(sizes: np.ndarray, maps: list[bytes], num: int, den: int, group: np.ndarray | None = None) -> np.ndarray:
    """Pairs of places, a spanning forest, of the sets whose maps don't rule out num / den: every bit that differs is a shingle that does, if not all such shingles show. Sets of one group are linked already.

    The smallest map's width counts for all: sets should be of like sizes."""
    width = min(map(len, maps))
    bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, width // 8), axis=0) for m in maps])
    top = np.arange(len(maps)) if group is None else group.copy()
    values, count = np.unique(top, return_counts=True)
    most = values[np.argmax(count)]
    found, rest = [], np.flatnonzero(top != most)  # of the largest group no two need be compared, and others come to it
    for at in range(0, len(rest), step := max(1, AT_ONCE // bits.size)):
        some = rest[at : at + step]
        apart = np.bitwise_count(bits[some][:, None] ^ bits[None]).sum(axis=2, dtype=np.int64)
        n, m = sizes[some][:, None], sizes[None]
        near = (apart * (den + num) <= (den - num) * (n + m)) & (np.minimum(n, m) * den >= np.maximum(n, m) * num) & (top[some][:, None] != top[None])
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            i = int(some[k])
            hit = np.flatnonzero(near[k] & (top != top[i]))
            if len(hit):
                other, first = np.unique(top[hit], return_index=True)
                found += [(i, j) for j in hit[first].tolist()]
                top[np.isin(top, np.append(other, top[i]))] = most if most in other else top[i]
    return np.array(found, np.int64).reshape(-1, 2)


def near_two(n: int, a: bytes, m: int, b: bytes, num: int, den: int) -> bool:
    """near_by_bits for two sets."""
    if min(n, m) * den < max(n, m) * num:
        return False
    x, y, p, q = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(a), len(b)
    while p > q:
        p //= 2
        x = x >> 8 * p ^ x & (1 << 8 * p) - 1
    while q > p:
        q //= 2
        y = y >> 8 * q ^ y & (1 << 8 * q) - 1
    return (x ^ y).bit_count() * (den + num) <= (den - num) * (n + m)


def link_sets(ids: list, sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int) -> list[tuple]:
    """A spanning forest of the pairs that reach num / den; with sides, of those between the sides only."""
    size = np.array([len(x) for x in sets], np.int64)
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.full(len(values), -1)
    rank[count > 1] = np.arange((count > 1).sum())
    width = max(1, -(-int((count > 1).sum()) // 64))
    bits = np.zeros((len(sets), width), np.uint64)
    row, col = np.repeat(np.arange(len(sets)), size), rank[inverse]
    row, col = row[col >= 0], col[col >= 0]
    np.bitwise_or.at(bits, (row, col >> 6), np.uint64(1) << (col & 63).astype(np.uint64))
    found = []
    for i in range(len(sets) - 1):
        other = np.arange(i + 1, len(sets))
        fits = (np.minimum(size[other], size[i]) * den >= np.maximum(size[other], size[i]) * num) & (True if side is None else side[other] != side[i])
        other = other[fits]
        for part in np.array_split(other, max(1, len(other) * width >> 20)):
            if len(part):
                both = np.bitwise_count(bits[part] & bits[i]).sum(axis=1, dtype=np.int64)
                hit = part[both * den >= num * (size[part] + size[i] - both)]
                found.append(np.stack([np.full(len(hit), i), hit], 1))
    return [(ids[a], ids[b]) for a, b in forest(len(sets), np.concatenate(found) if found else np.zeros((0, 2), int))]


def deal(sig: np.ndarray, k: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, kind, body) of a task's signatures and their sets' keys, which have KEY_BITS.

    A signature's upper half names its bucket; body has the lower halves and then the keys. Kind 0 are all sets of a signature, kind 1 one that stands for many; the
    others of those many are linked to it by kind 2, whose body has pairs of keys.
    """
    order = np.argsort(sig)
    sig, k = sig[order], k[order]
    first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0)
    size = np.diff(np.append(first, len(sig)))
    many, hub = np.repeat(size > SHARED_AT_ONCE, size), np.repeat(np.minimum.reduceat(k, first) if len(k) else k, size)
    bucket = (((sig >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    rows = []
    for kind, some in ((0, ~many), (1, many & (k == hub)), (2, many & (k != hub))):
        b, low, keys, to = bucket[some], sig[some].astype(np.uint32), k[some], hub[some]
        edge = np.flatnonzero(np.diff(b, prepend=-1, append=-1))
        for i, j in zip(edge[:-1], edge[1:]):
            body = [keys[i:j], to[i:j]] if kind == 2 else [low[i:j], keys[i:j].astype(np.uint32), (keys[i:j] >> np.uint64(32)).astype(np.uint8)]
            rows.append((int(b[i]), kind, b"".join(x.tobytes() for x in body)))
    cols = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "body"])


@released
def meet(batches):
    """From the rows of `deal` in order of their buckets, rows (hub, k, all): the keys k of sets that share a signature, under the smallest (hub), itself included; with `all`, of so
    many that they are linked without being sifted."""

    def table(hub, k, every):
        return pa.RecordBatch.from_arrays([as_long(hub), as_long(k), pa.array(every, pa.bool_())], ["hub", "k", "all"])

    def close(held: list[tuple], last: bool):
        """(rows, what is left of the bucket): all groups at its end, before that only those of over SIFTED, of which one set stays."""
        low, k, stands = (np.concatenate(x) for x in zip(*held))
        if last:  # most signatures are one set's alone
            alike = np.sort(low)
            alike = alike[1:][alike[1:] == alike[:-1]]
            some = np.flatnonzero(alike[np.minimum(np.searchsorted(alike, low), len(alike) - 1)] == low) if len(alike) else alike.astype(np.int64)
            low, k, stands = low[some], k[some], stands[some]
        order = np.lexsort((k, low))
        low, k, stands = low[order], k[order], stands[order]
        new = np.append(True, (low[1:] != low[:-1]) | (k[1:] != k[:-1]))
        new = new[: len(low)]
        stands = np.logical_or.reduceat(stands, np.flatnonzero(new)) if len(low) else stands
        low, k = low[new], k[new]
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1])[: len(low)])
        size = np.diff(np.append(first, len(low)))
        many = np.repeat((np.logical_or.reduceat(stands, first) if len(low) else stands) | ((size > SIFTED) & (not last)), size)
        hub, met = np.repeat(k[first], size), np.repeat(size > 1, size)
        out = met & (last | many)
        hub, key, every = hub[out], k[out], many[out]
        order = np.lexsort((every, key, hub))
        hub, key, every = hub[order], key[order], every[order]
        new = np.append(True, (hub[1:] != hub[:-1]) | (key[1:] != key[:-1]) | (every[1:] != every[:-1]))[: len(hub)]
        stay = ~many | (k == np.repeat(k[first], size))
        return table(hub[new], key[new], every[new]), [] if last else [(low[stay], k[stay], many[stay])]

    own, held, n, most = None, [], 0, HELD
    for batch in batches:
        for bucket, kind, body in zip(*(batch[c].to_pylist() for c in ("bucket", "kind", "body"))):
            if kind == 2:
                k, hub = np.frombuffer(body, np.uint64).reshape(2, -1)
                yield table(hub, k, np.ones(len(k), bool))
                continue
            if held and (bucket != own or n > most):
                rows, held = close(held, bucket != own)
                n = sum(len(x[0]) for x in held)
                most = max(HELD, 2 * n)
                yield rows
            own, m = bucket, len(body) // 9
            low = np.frombuffer(body, np.uint32, m)
            k = np.frombuffer(body, np.uint32, m, 4 * m).astype(np.uint64) | np.frombuffer(body, np.uint8, m, 8 * m).astype(np.uint64) << np.uint64(32)
            held.append((low, k, np.full(m, kind == 1)))
            n += m
    if held:
        yield close(held, True)[0]


def ngram_jaccard(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose sets of n-word shingles reach a Jaccard similarity of num / den, directly or over others.

    Returns one row per input row: id, n_shingles (size of its set), component_id (smallest id reachable by links, itself included).
    Words are runs of other than white space with A-Z lower-cased; a text with fewer than n words has them all as its one shingle; a text that is
    null, empty or without words links with nothing. Repeated rows and copies share a set and so a component; a null id takes part and is never the
    smallest id unless its component has no other. Other columns are ignored.

    Equal sets make one class. PartEnum signatures of the classes' sets find every pair that can reach the threshold; classes that share a signature are gathered under the smallest of
    them, and of those under one class pairs stay whose bit maps don't rule it out. Such classes, directly or over others, make a cluster; within a cluster, blocks of sets are compared exactly, first each alone and with some sets of all; in clusters that
    are not one group then, those outside the largest are compared with all of equal or neighbouring size bands. Each comparison of two blocks returns a spanning forest, never
    its pairs. Shingles are compared by 64-bit hashes and sets by 128 bits.
    """
    spark = small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    @released
    def keys(batches):
        for batch in batches:
            for i, j in chunks(batch["text"]):
                ptr, s = shingle_sets(batch["text"].slice(i, j - i), n)
                k1, k2 = set_keys(ptr, s)
                yield pa.RecordBatch.from_arrays([batch["id"].slice(i, j - i), pa.array(np.diff(ptr)), as_long(k1), as_long(k2), pa.array(bit_sets(ptr, s), pa.binary())], ["id", "n", "k1", "k2", "bits"])

    rows = cut(src.mapInArrow(keys, T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n", "k1", "k2")), T.StructField("bits", T.BinaryType())])), "sets")
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.first("n").alias("n"), F.min("id").alias("low"), F.first("bits").alias("bits")).withColumn("k", F.col("k1").bitwiseAND(F.lit((1 << KEY_BITS) - 1)))

    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(1024, total // BUCKET)

    @released
    def sign(batches):
        seen: set[int] = set()
        held: list[tuple] = []
        gathered = 0
        for batch in batches:
            for i, j in chunks(batch["text"], 1 << 19):
                ptr, s = shingle_sets(batch["text"].slice(i, j - i), n)
                k = set_keys(ptr, s)[0] & np.uint64((1 << KEY_BITS) - 1)
                row, sig = signatures(ptr, s, num, den)
                new = np.array([x not in seen and not seen.add(x) for x in k.tolist()], bool)  # a copy in the same task signs once
                if len(seen) > 200_000:
                    seen.clear()
                keep = new[row]
                held.append((sig[keep], k[row[keep]]))
                gathered += len(held[-1][0])
                if gathered > GATHERED:
                    yield deal(*(np.concatenate(x) for x in zip(*held)), buckets)
                    held, gathered = [], 0
        if held:
            yield deal(*(np.concatenate(x) for x in zip(*held)), buckets)

    signed = src.select("text").mapInArrow(sign, "bucket int, kind int, body binary")
    # sets that share any signature under one smallest key make one group: pairs (hub, k) count once
    met = cut(signed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "hub long, k long, all boolean").groupBy("hub", "k").agg(F.max("all").alias("all")), "met")

    edges = bands(num, den, 1 << 40)

    @released
    def sift(batches):
        held: list[tuple] = []
        top: dict[int, int] = {}  # what this task has linked already

        def find(x):
            while (y := top.setdefault(x, x)) != x:
                top[x] = top[y]
                x = top[x]
            return x

        def close(rows):
            out = []
            i = 0
            while i < len(rows):
                j = i
                while j < len(rows) and rows[j][0] == rows[i][0]:
                    j += 1
                if j - i <= FEW:
                    for a in range(i + 1, j):
                        for b in range(i, a):
                            x, y = find(rows[a][1]), find(rows[b][1])
                            if x != y and near_two(*rows[a][2:], *rows[b][2:], num, den):
                                top[x] = y
                                out.append((rows[a][1], rows[b][1]))
                else:  # by size bands, each with the next, so that maps are of like widths
                    band = np.searchsorted(edges, [r[2] for r in rows[i:j]], "right")
                    for b in np.unique(band):
                        some = [rows[i + k] for k in np.flatnonzero((band == b) | (band == b + 1))]
                        if len(set(roots := [find(r[1]) for r in some])) > 1:
                            for x, y in near_by_bits(np.array([r[2] for r in some]), [r[3] for r in some], num, den, np.array(roots)).tolist():
                                x, y = find(some[x][1]), find(some[y][1])
                                if x != y:
                                    top[x] = y
                                    out.append((x, y))
                i = j
            a, b = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            held += zip(*(batch[c].to_pylist() for c in ("name", "k", "n", "bits")))
            last = held[-1][0] if held else None
            whole = [r for r in held if r[0] != last]
            if whole:
                held = [r for r in held if r[0] == last]
                yield close(whole)
        if held:
            yield close(held)

    pairs = met.where("NOT all").select("hub", "k").unionByName(met.where("NOT all").selectExpr("hub", "hub AS k")).distinct()
    # groups of more than SIFTED are compared by pairs of blocks
    large = cut(pairs.groupBy("hub").agg(F.ceil(F.count("*") / SIFTED).cast("int").alias("own")).where("own > 1"), "large")
    pairs = pairs.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "hub", "left").withColumn("block", F.pmod(F.xxhash64("k"), F.coalesce("own", F.lit(1))))
    blocks = F.explode(F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda j: F.xxhash64("hub", F.least("block", j.cast("long")), F.greatest("block", j.cast("long")))))
    few = pairs.where("own IS NULL").select(F.col("hub").alias("name"), "k").unionByName(pairs.where("own > 1").select(blocks.alias("name"), "k")).join(classes.select("k", "n", "bits"), "k")
    near = few.repartition("name").sortWithinPartitions("name").mapInArrow(sift, "a long, b long").unionByName(met.where("all AND k <> hub").selectExpr("k AS a", "hub AS b"))
    cluster = cut(components(near).withColumnRenamed("node", "k"), "clusters")

    # sets of the clusters' classes: a fixed bit map of their keys goes to the tasks that read the texts, an exact join follows
    sent = spark.sparkContext.broadcast(bit_map(cluster, "k", cluster.count()))

    @released
    def members(batches):
        seen: set[int] = set()
        for batch in batches:
            for i, j in chunks(batch["text"]):
                ptr, s = shingle_sets(batch["text"].slice(i, j - i), n)
                k1, k2 = set_keys(ptr, s)
                hit = in_map(sent.value, k1)
                rows = [r for r in np.flatnonzero(hit & (np.diff(ptr) > 0)) if int(k1[r]) not in seen and not seen.add(int(k1[r]))]
                if len(seen) > 200_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([as_long(k1[rows]), as_long(k2[rows]), pa.array([s[ptr[r] : ptr[r + 1]].tobytes() for r in rows], pa.binary())], ["k1", "k2", "items"])

    edge = [int(x) for x in bands(num, den, 1 << 40)]
    # the band of a size as an expression: how many first sizes it has reached
    band = F.aggregate(F.lit(edge), F.lit(-1), lambda acc, x: acc + (F.col("n") >= x).cast("int"))
    items = src.select("text").mapInArrow(members, "k1 long, k2 long, items binary").groupBy("k1", "k2").agg(F.first("items").alias("items"))
    named = classes.drop("bits").join(cluster, "k").withColumn("band", band).select("k1", "k2", "n", "component", "band")
    named = cut(named.join(items, ["k1", "k2"]), "members")

    def in_blocks(df: DataFrame, unit: list[str]) -> tuple[DataFrame, DataFrame]:
        """(df with block and met, units with own): each unit's sets in `own` blocks, met the unit's number of sets."""
        sizes = df.groupBy(*unit).agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("own"), F.count("*").alias("met"))
        sizes = cut(sizes, "units")
        some = sizes.where("own > 1")  # others have block 0
        few = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
        return df.join(few, unit, "left").withColumns({"own": F.coalesce("own", F.lit(1)), "block": F.pmod(F.xxhash64("k1", "k2"), F.coalesce("own", F.lit(1))).cast("int")}), sizes

    task = ["component", "ba", "fa", "ia", "bb", "fb", "ib"]
    # first each block alone, and some sets with all blocks of their unit: groups of near copies are found whole
    placed, _ = in_blocks(named, ["component", "band"])
    anchor = F.coalesce(F.pmod(F.xxhash64("k2", "k1"), "met") < ANCHORS, F.lit(False))
    blocks = F.explode(F.when(anchor, F.sequence(F.lit(0), F.col("own") - 1)).otherwise(F.array("block")))
    alone = placed.withColumn("ia", blocks).select("component", F.col("band").alias("ba"), F.lit(0).alias("fa"), "ia", F.col("band").alias("bb"), F.lit(0).alias("fb"), F.col("ia").alias("ib"), F.lit(0).alias("side"), "k1", "k2", "items")

    def compare(table: pa.Table) -> pa.Table:
        ids = list(zip(table["k1"].to_pylist(), table["k2"].to_pylist()))
        sets = [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()]
        one = all(table[f"{x}a"][0] == table[f"{x}b"][0] for x in "bfi")
        got = link_sets(ids, sets, None if one else np.array(table["side"].to_pylist()), num, den)
        return pa.table([pa.array([f(e) for e in got], pa.int64()) for f in (lambda e: e[0][0], lambda e: e[0][1], lambda e: e[1][0], lambda e: e[1][1])], ["a1", "a2", "b1", "b2"])

    def linked(df: DataFrame) -> DataFrame:
        return df.groupBy(*task).applyInArrow(compare, "a1 long, a2 long, b1 long, b2 long")

    def grouped_by(links: DataFrame) -> DataFrame:
        return components(links.selectExpr("struct(a1 AS k1, a2 AS k2) AS a", "struct(b1 AS k1, b2 AS k2) AS b")).selectExpr("node.k1", "node.k2", "component AS g")

    first = cut(linked(alone), "links")
    # then, in clusters that aren't one group yet, all sets with those outside the largest group, in bands that can be similar
    so_far = named.select("component", "k1", "k2").join(grouped_by(first), ["k1", "k2"], "left").withColumn("g", F.coalesce("g", F.struct("k1", "k2")))
    groups = cut(so_far.groupBy("component", "g").agg(F.count("*").alias("size")), "groups")
    open_ = groups.groupBy("component").agg(F.count("*").alias("groups"), F.max_by("g", F.struct("size", "g")).alias("main")).where("groups > 1").select("component", "main")
    left = cut(so_far.join(open_, "component").select("component", "k1", "k2", (F.col("g") == F.col("main")).cast("int").alias("f")), "open")
    placed, units = in_blocks(named.join(left, ["component", "k1", "k2"]), ["component", "band", "f"])
    a, b = (units.select("component", F.col("band").alias(f"b{x}"), F.col("f").alias(f"f{x}"), F.col("own").alias(f"own{x}")) for x in "ab")
    near_units = a.withColumn("bb", F.explode(F.array("ba", F.col("ba") + 1))).join(b, ["component", "bb"]).where("fa + fb < 2 AND (ba < bb OR fa <= fb)")  # four at most of a cluster's band
    both = near_units.withColumn("ia", F.explode(F.sequence(F.lit(0), F.col("owna") - 1)))
    both = both.withColumn("ib", F.explode(F.sequence(F.when((F.col("ba") == F.col("bb")) & (F.col("fa") == F.col("fb")), F.col("ia")).otherwise(0), F.col("ownb") - 1)))
    sides = both.select(*task, F.col("ba").alias("band"), F.col("fa").alias("f"), F.col("ia").alias("block"), F.lit(0).alias("side"))
    sides = cut(sides.unionByName(both.where("ba <> bb OR fa <> fb OR ia <> ib").select(*task, F.col("bb").alias("band"), F.col("fb").alias("f"), F.col("ib").alias("block"), F.lit(1).alias("side"))), "tasks")
    second = placed.join(sides, ["component", "band", "f", "block"]).select(*task, "side", "k1", "k2", "items")
    group = grouped_by(first.unionByName(linked(second)))
    # Two keys name a group; groups without links are their own.
    lowest = classes.drop("bits").join(group, ["k1", "k2"], "left").withColumn("g", F.coalesce("g", F.struct("k1", "k2")))
    low = cut(lowest.select("k1", "k2", "g", "low"), "groups")
    top = low.groupBy("g").agg(F.min("low").alias("component_id"))
    answer = low.join(top, "g").select("k1", "k2", "component_id")
    return rows.join(answer, ["k1", "k2"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def first_of_groups(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs without all but one of each group that ngram_jaccard finds: the one with the smallest doc_id stays, of rows with the same doc_id the same text by its hash,
    and of rows that share both any one.

    Rows whose texts are null, empty or without words are no group's and stay. A null doc_id counts as the largest. All columns stay as they are; names that begin with __ are ours.
    """
    text = F.col("text").cast("string")
    named = docs.withColumn("__id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")))
    groups = ngram_jaccard(named, n, num, den, id_col="__id").where("n_shingles > 0").groupBy("__id").agg(F.first("component_id").alias("first"), F.count("*").alias("rows"))
    marks = cut(groups.select("__id", (F.col("__id") != F.col("first")).alias("__goes"), "rows").where("__goes OR rows > 1").drop("rows"), "marks")
    count = marks.agg(F.count("*"), F.count_if(~F.col("__goes"))).first()
    joined = named.join(F.broadcast(marks) if count[0] <= BROADCAST_ROWS else marks, "__id", "left")  # else the texts are shuffled to them
    out = joined.where("__goes IS NULL")
    if count[1]:
        out = out.unionByName(joined.where("NOT __goes").dropDuplicates(["__id"]))
    return out.select(*docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: op6 in DuckDB, by shared shingles.
SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS u, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 90 * u), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id AS d, doc_id AS m FROM s UNION SELECT e.b, r.m FROM r JOIN e ON r.d = e.a), c AS (SELECT d, min(m) AS m FROM r GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m AS component_id FROM s JOIN c ON doc_id = d"""
