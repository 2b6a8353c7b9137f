"""Operator 4: benchmark passages in documents, by SimHash of item-sized windows and multi-index Hamming blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import PUNCTUATION, chunks, grouped, mix, new_path, read_rows, released, shingle_hashes, small_batches, words

WORDS, NUM, DEN = 5, 4, 5
#: Fingerprints within so many of 64 bits are candidates; in one of 8 blocks of 8 bits they then differ by RADIUS // 8 bits at most.
RADIUS, BLOCKS = 23, 8
#: The benchmark is cut to parts of so many bytes of text or so; a task that has several to go through gathers texts of GROUP_BYTES for each round.
PART_BYTES, GROUP_BYTES = 4 << 20, 64 << 20
#: Pairs of a window and an item that are looked at in one numpy pass.
PAIRS_AT_ONCE = 1 << 22
_NEAR = np.array([[bin(a ^ b).count("1") <= RADIUS // BLOCKS for b in range(256)] for a in range(256)])
_SIFT = 1 << 22


def fingerprints(h: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """SimHash of the windows of `size` shingle hashes at the starts, each occurrence of a shingle with weight one."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = (sums[starts + size] - sums[starts]) * 2 > size
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()


def need(a: int, b: int) -> int:
    """The least number of common shingles that multisets of a and b must have for NUM / DEN."""
    return -(-NUM * (a + b) // (NUM + DEN))


def near_prints(fp: np.ndarray, fps: np.ndarray, tables: list[np.ndarray]):
    """(window, item, bits) of all pairs within RADIUS: those that the blocks' tables find, compared. So many windows at a time that memory is bounded."""
    for at in range(0, len(fp), step := max(1, PAIRS_AT_ONCE // len(fps))):
        blocks = fp[at : at + step].view(np.uint8).reshape(-1, BLOCKS)
        found = tables[0][blocks[:, 0]]
        for b in range(1, BLOCKS):
            found |= tables[b][blocks[:, b]]
        w, i = np.nonzero(found)
        far = np.bitwise_count(fp[at + w] ^ fps[i])
        yield from zip(*(x[far <= RADIUS].tolist() for x in (at + w, i, far)))


class Items:
    """A part of the benchmark, indexed."""

    def __init__(self, ids: list, texts: list[str]):
        before, _, _, h = words(pc.utf8_lower(pa.array(texts, pa.string())), PUNCTUATION)
        self.groups: dict[int, dict] = {}  # by the length of shingles: the items' shingles, and items by number of shingles
        for i, (a, b) in enumerate(zip(before[:-1], before[1:])):
            if a == b:
                continue
            n = min(WORDS, b - a)
            _, s = shingle_hashes(np.array([0, b - a]), h[a:b], n)
            g = self.groups.setdefault(int(n), {"all": [], "by_size": {}})
            g["all"].append(s)
            values, counts = np.unique(s, return_counts=True)
            fp = fingerprints(mix(s), len(s), np.zeros(1, np.int64))[0]
            g["by_size"].setdefault(len(s), []).append((ids[i], values, counts, fp))
        for g in self.groups.values():
            g["all"] = np.unique(np.concatenate(g["all"]))
            g["sift"] = np.zeros(_SIFT, bool)
            g["sift"][g["all"] & np.uint64(_SIFT - 1)] = True
            for size, items in g["by_size"].items():
                fps = np.array([x[3] for x in items], np.uint64)
                blocks = fps.view(np.uint8).reshape(-1, BLOCKS)
                # for each block, the items that each value of it finds
                g["by_size"][size] = items, fps, [_NEAR[:, blocks[:, b]] for b in range(BLOCKS)]

    def find(self, col: pa.Array) -> list[tuple]:
        """(row, item id, first word, words, Hamming distance, similarity) of the best window of each row and item that reaches NUM / DEN."""
        before, _, _, h = words(pc.utf8_lower(col), PUNCTUATION)
        out = []
        for n, g in self.groups.items():
            ptr, s = shingle_hashes(before, h, n)
            at = np.flatnonzero(g["sift"][s & np.uint64(_SIFT - 1)])
            place = np.minimum(np.searchsorted(g["all"], s[at]), len(g["all"]) - 1)
            at = at[g["all"][place] == s[at]]
            row_of = np.searchsorted(ptr, at, "right") - 1
            for row in np.unique(row_of):
                own, base = s[ptr[row] : ptr[row + 1]], ptr[row]
                hits = np.zeros(len(own) + 1, np.int64)
                hits[at[row_of == row] - base + 1] = 1
                hits = np.cumsum(hits)
                best: dict = {}
                mixed = None
                for size, (items, fps, tables) in g["by_size"].items():
                    width = min(size, len(own))
                    if hits[-1] < need(size, width):
                        continue
                    # windows with too few of the benchmark's shingles can't reach the similarity with any item
                    starts = np.flatnonzero(hits[width:] - hits[:-width] >= need(size, width))
                    if not len(starts):
                        continue
                    mixed = mix(own) if mixed is None else mixed
                    lo = int(starts[0])
                    fp = fingerprints(mixed[lo : int(starts[-1]) + width], width, starts - lo)
                    for w, i, d in near_prints(fp, fps, tables):
                        item, values, counts, _ = items[i]
                        have, times = np.unique(own[starts[w] : starts[w] + width], return_counts=True)
                        p = np.minimum(np.searchsorted(values, have), len(values) - 1)
                        both = int(np.minimum(times, counts[p])[values[p] == have].sum())
                        either = size + width - both
                        if both * DEN >= NUM * either:
                            key = (-both / either, int(starts[w]))
                            if (size, i) not in best or key < best[size, i][0]:
                                best[size, i] = key, (int(row), item, int(starts[w]), width + n - 1, d, both / either)
                out += [x for _, x in best.values()]
        return out


def in_parts(benchmark: DataFrame) -> tuple[str, int]:
    """(path, number): where the shared folder has the benchmark's distinct items in parts of PART_BYTES of text or so."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    n = max(1, -(-int(b.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    path = new_path(small_batches(b.sparkSession), "benchmark")
    b.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")).repartition("part").write.partitionBy("part").parquet(path)
    return path, n


def leaks_of(batches, text_col: str, path: str, parts: int):
    """(batch, leaks) of every batch; leaks as Items.find has them, row a row of the batch. Each part of the benchmark is read and indexed once a group of batches."""

    def index(part: int) -> Items:
        rows = read_rows(path, ["item_id", "text"], part=part)
        order = sorted(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist()), key=lambda x: (x[0] is None, x))
        return Items([x[0] for x in order], [x[1] for x in order])

    def find(items: Items, col: pa.Array) -> list[tuple]:
        return [(i + row, *rest) for i, j in chunks(col) for row, *rest in items.find(col.slice(i, j - i))]

    if parts == 1:
        one = index(0)
        yield from ((batch, find(one, batch[text_col])) for batch in batches)
        return
    for group in grouped(batches, text_col, GROUP_BYTES):
        found = [[] for _ in group]
        for part in range(parts):
            items = index(part)
            for batch, out in zip(group, found):
                out += find(items, batch[text_col])
        yield from zip(group, found)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, item_id, start_word, n_words, hamming, similarity): the best window of each document and benchmark item that it holds.

    Words are runs of ASCII letters and digits and of other characters beyond ASCII, all lower-cased. A window has an item's number of words, or is the whole of
    a shorter text; similarity is the weighted Jaccard of their five-word shingles (an item of fewer words is one shingle), a shingle's weight its number of
    occurrences, and 0.8 at least. All windows of a text are looked at whose shingles could reach that; of these all within RADIUS bits of an item's
    SimHash are found by blocks and then compared exactly. The best is the most similar, then the first. Null and empty texts and items match
    nothing; repeated rows and copies each give their rows; an empty benchmark gives none. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    path, parts = in_parts(benchmark)
    names, kinds = ["item_id", "start_word", "n_words", "hamming", "similarity"], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())

    @released
    def run(batches):
        for batch, got in leaks_of(batches, "text", path, parts):
            cols = list(zip(*got)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds))], ["doc_id", *names])

    return src.mapInArrow(run, "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double").withColumnRenamed("doc_id", id_col)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, whole, in which find_leaks finds nothing; also those with null or empty texts."""
    path, parts = in_parts(benchmark)

    @released
    def run(batches):
        for batch, got in leaks_of(batches, text_col, path, parts):
            clean = np.ones(batch.num_rows, bool)
            clean[[x[0] for x in got]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
