"""Operator 8: packing by lexical retrieval: BM25 neighbours of a seed fill its window."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm.common import _powers as powers_of
from skerry.llm.common import cut, mix, released, small_batches

WINDOW, END_ID = 2048, 1
#: A shard of the inverted index holds so many tails; what it leaves over goes to the next shard.
SHARD_TAILS = 512
#: A tail is filed under so many of its heaviest terms, one a round, of those that so many tails have. In all rounds but the last a neighbour's score is so much of the seed's own at least. A
#: term's tails are dealt to shards of so many or so.
KEYS, LEAST_DF, LEAST_SHARE, SPREAD = 2, 8, 0.1, 4096
K1, B = 1.2, 0.75
#: Words that a worker remembers with their ids before it starts anew.
CACHE_WORDS = 800_000

_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa0-įı-ſ]*")
#: Where these follow, an apostrophe parts a word otherwise than by kinds of characters.
_APOSTROPHE = re.compile(r"'[strvmld]")
#: Kinds of _PLAIN's characters: white space, letters that go together, numbers that stand alone, others that go together.
_KIND = np.array([0 if chr(c).isspace() else 1 if chr(c).isalpha() else 2 if chr(c).isnumeric() else 3 for c in range(0x180)], np.uint8)
_UNIT = mix(np.arange(0x180, dtype=np.uint64))


class WordTokenizer:
    """ids of texts as tokenizers gives them. This vocabulary reads word for word, so each word is encoded once and remembered by two hashes of 64 bits in all
    (a second one tells words of one hash apart, but for those that share both); texts with characters beyond _PLAIN, with contractions or with one of the vocabulary's
    special tokens are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.size = len(self.ends)
        self._forget()

    def _forget(self):
        self.keys, self.codes = np.zeros(1 << 21, np.uint64), np.full(1 << 21, -1)
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, new: list[str]) -> None:
        parts, sizes = [], []
        for k in range(0, len(new), 2000):
            some = new[k : k + 2000]
            ids = np.array(self.whole.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(some) or len(ids) != stop[-1]:  # not word for word after all
                each = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(some, add_special_tokens=False)]
                ids, stop = np.concatenate(each), np.cumsum([len(x) for x in each])
            parts.append(ids)
            sizes.append(np.diff(stop, prepend=0))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))])
        self.flat = np.concatenate([self.flat, *parts])

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Codes of hashes, -1 of new ones."""
        mask = np.uint64(len(self.keys) - 1)
        slot = h & mask
        out, left = self.codes[slot], np.arange(len(h))
        while True:
            left = left[(self.keys[slot[left]] != h[left]) & (self.codes[slot[left]] >= 0)]
            if not len(left):
                return out
            slot[left] = (slot[left] + np.uint64(1)) & mask
            out[left] = self.codes[slot[left]]

    def _keep(self, h: np.ndarray, code: int) -> None:
        mask, slot, left = np.uint64(len(self.keys) - 1), h & np.uint64(len(self.keys) - 1), np.arange(len(h))
        while len(left):
            free = left[self.codes[slot[left]] < 0]
            self.codes[slot[free]] = code + free
            won = free[self.codes[slot[free]] == code + free]
            self.keys[slot[won]] = h[won]
            left = np.setdiff1d(left, won)
            slot[left] = (slot[left] + np.uint64(1)) & mask

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        big = "\n".join(t.lower() for t in texts) + "\n"
        unit = np.frombuffer(big.encode("utf-16-le"), np.uint16)
        kind = _KIND[unit]
        begins = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == 2)) & (kind > 0)
        start = np.flatnonzero(begins)
        if not len(start):
            return [np.zeros(0, np.uint32)] * len(texts)
        inside = np.flatnonzero(kind)
        first = np.searchsorted(inside, start)
        size = np.diff(np.append(first, len(inside)))
        rank = np.arange(len(inside)) - np.repeat(first, size)
        with np.errstate(over="ignore"):
            h = mix(np.add.reduceat(_UNIT[unit[inside]] * powers_of(int(size.max()))[rank], first))
        code = self._find(h)
        missing = np.flatnonzero(code < 0)
        if len(missing):
            new, where = np.unique(h[missing], return_index=True)
            base = len(self.at) - 1
            self._learn([big[start[i] : start[i] + size[i]] for i in missing[where].tolist()])
            self._keep(new, base)
            code[missing] = base + np.searchsorted(new, h[missing])
        n = self.at[code + 1] - self.at[code]
        ids = self.flat[np.repeat(self.at[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        bounds = np.cumsum([len(t.lower()) + 1 for t in texts])
        upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, bounds)]
        return np.split(ids, upto[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.at) > CACHE_WORDS:
            self._forget()
        plain = [bool(_PLAIN.fullmatch(t)) and not _APOSTROPHE.search(low := t.lower()) and not any(x in low for x in self.special) for t in texts]
        got = iter(self._plain([t for t, p in zip(texts, plain) if p]) if any(plain) else [])
        return [next(got) if p else np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) for t, p in zip(texts, plain)]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def key_terms(ids: np.ndarray, idf: np.ndarray, df: np.ndarray, row: int) -> list[int]:
    """The tail's KEYS heaviest terms by BM25 among those that LEAST_DF tails have, as numbers of shards: terms of many tails have many, of SPREAD tails or so. Missing terms share some."""
    some, tf = np.unique(ids, return_counts=True)
    weight = np.where(df[some] >= LEAST_DF, idf[some] * tf * (K1 + 1) / (tf + K1), 0)
    best = [int(some[i]) for i in np.argsort(-weight, kind="stable")[:KEYS] if weight[i] > 0]
    salt = int(mix(np.array([row], np.uint64))[0] >> np.uint64(33))
    return [t << 32 | salt % (1 + int(df[t]) // SPREAD) for t in best] + [-1 - salt % (1 << 20)] * (KEYS - len(best))


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Fills windows of one partition, shard by shard."""

    def __init__(self, idf: np.ndarray, mean: float, first: int):
        self.idf, self.mean, self.next, self.rows = idf, mean, first, []
        self.left: list[tuple] = []  # (doc_id, start, ids, doc_tokens, keys)

    def sequence(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total, _ in pieces:
            self.rows.append((doc, start, len(ids), crc(ids), total, self.next, at))
            at += len(ids)
        self.next += 1

    def shard(self, tails: list[tuple], share: float = 0.0) -> None:
        """Packs the tails and what was left over; leaves less than a window. With a share, windows are closed only around seeds whose unused neighbours with that share of
        the seed's own score fill them, and the other tails are left."""
        tails = self.left + tails
        n = len(tails)
        size = np.array([len(t[2]) for t in tails])
        ids = np.concatenate([t[2] for t in tails]).astype(np.int64)
        key, tf = np.unique(ids * n + np.repeat(np.arange(n), size), return_counts=True)
        term, doc = key // n, key % n
        weight = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / self.mean))
        some = weight > 0
        term, doc, weight = term[some], doc[some], weight[some]
        terms, first, count = np.unique(term, return_index=True, return_counts=True)  # the inverted index
        by_doc = np.argsort(doc, kind="stable")
        own = np.searchsorted(doc[by_doc], np.arange(n + 1))
        slot = np.searchsorted(terms, term)[by_doc]
        used, tried = np.zeros(n, bool), np.zeros(n, bool)
        alone: list[tuple] = []  # what cuts have left of tails that no window was closed around
        rest = int(size.sum())
        carried: tuple | None = None  # what a cut has left of a tail; it seeds the next window
        k = 0
        while rest >= WINDOW:
            if carried is None:
                while k < n and (used[k] or tried[k]):
                    k += 1
                if k == n:
                    break
                seed, carried = k, tails[k]
                tried[k] = used[k] = True
            window, room, own_tail = [carried], WINDOW - len(carried[2]), carried
            carried = None
            mine = slot[own[seed] : own[seed + 1]]
            c = count[mine]
            at = np.repeat(first[mine] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            score = np.bincount(doc[at], weight[at], n)
            least = share * score[seed]
            score[used] = -1
            if share and size[score >= max(least, 1e-9)].sum() < room:
                if own_tail is tails[seed]:
                    used[seed] = False  # it may yet be another's neighbour
                else:
                    alone.append(own_tail)
                    rest -= len(own_tail[2])
                continue
            order = np.argsort(-score, kind="stable")
            for x in order:
                if not room:
                    break
                if used[x]:
                    continue
                used[x] = True
                d, start, tail, total, keys = tails[x]
                window.append((d, start, tail[:room], total, keys))
                if len(tail) > room:
                    carried, seed = (d, start + room, tail[room:], total, keys), int(x)
                room -= len(window[-1][2])
            self.sequence(window)
            rest -= WINDOW
        self.left = ([carried] if carried else []) + alone + [t for t, u in zip(tails, used) if not u]

    def finish(self) -> None:
        """The last pieces: sequences at powers of two need no padding."""
        left, self.left = self.left, []
        for room in powers(sum(len(t[2]) for t in left)):
            window = []
            while room:
                d, start, ids, total, keys = left.pop(0)
                window.append((d, start, ids[:room], total, keys))
                if len(ids) > room:
                    left.insert(0, (d, start + room, ids[room:], total, keys))
                room -= len(window[-1][2])
            self.sequence(window)


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document's tokens, and an end id, into sequences of WINDOW tokens; a row for each piece.

    doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens (with the end id), sequence_id, offset. path names a tokenizer file of whole words;
    None takes public_tokenizers' word_bpe_49k.json. Null and empty texts have only their end id. Repeated rows and null ids are documents of their own.
    Other columns are ignored. An empty table gives no pieces.

    Whole windows are cut from a document first. The tails are filed under their heaviest terms by BM25, whose document frequencies are of all tails; terms of many tails have several
    shards. A shard has an inverted index: a tail seeds a window and its unused BM25 neighbours, best first, fill it, the last one cut. Tails whose neighbours don't fill a
    window go on to the shards of their next term, with those of other shards, and last to those of the first again, where all are packed; a partition's last tokens make
    sequences at powers of two. The vocabulary bounds what is broadcast.
    """
    spark = small_batches(docs.sparkSession)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("row", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType())), T.StructField("tail", T.BinaryType())])

    @released
    def encode(batches):
        t, row = tokenizer(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                ids = [np.append(x, np.uint32(END_ID)) for x in t.encode(some["text"].to_pylist())]
                whole = [len(x) // WINDOW * WINDOW for x in ids]
                yield pa.RecordBatch.from_arrays([
                    some["doc_id"], pa.array(range(row, row + len(ids)), pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([[crc(x[j : j + WINDOW]) for j in range(0, w, WINDOW)] for x, w in zip(ids, whole)], pa.list_(pa.int64())),
                    pa.array([x[w:].astype("<u2" if t.size <= 1 << 16 else "<u4").tobytes() for x, w in zip(ids, whole)], pa.binary()),
                ], names=["doc_id", "row", "doc_tokens", "crcs", "tail"])
                row += len(ids)

    rows = cut(src.mapInArrow(encode, schema), "tails")
    size = tokenizer(path).size
    width = "<u2" if size <= 1 << 16 else "<u4"

    @released
    def frequencies(batches):
        df, n, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for tail in batch["tail"].to_pylist():
                ids = np.frombuffer(tail, width)
                df[np.unique(ids)] += 1
                n, total = n + (len(ids) > 0), total + len(ids)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [n, total]))], ["term", "n"])

    counts = {r.term: r.n for r in rows.select("tail").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the vocabulary's size at most
    n, total = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(size)
    df[list(counts)] = list(counts.values())
    sent = spark.sparkContext.broadcast((np.where(df > 0, np.maximum(0, np.log((n - df + 0.5) / (df + 0.5))), 0), df))
    mean = max(1.0, total / max(1, n))

    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    out = T.StructType([T.StructField("doc_id", kind), *longs("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    held = [T.StructField("tail", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]

    @released
    def windows(batches):
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            crcs = batch["crcs"].combine_chunks() if isinstance(batch["crcs"], pa.ChunkedArray) else batch["crcs"]
            size = np.array([len(x) for x in crcs.to_pylist()], np.int64)
            row = np.repeat(np.arange(len(size)), size)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            at = pa.array(row)
            full = np.full(len(row), WINDOW)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), pa.array(rank * WINDOW), pa.array(full), crcs.flatten(), batch["doc_tokens"].take(at), pa.array(n + np.arange(len(row))), pa.array(0 * full)], names=out.fieldNames())
            n += len(row)

    @released
    def file(batches):
        idf, df = sent.value
        for batch in batches:
            start = pa.array([len(x) * WINDOW for x in batch["crcs"].to_pylist()], pa.int64())
            keys = [key_terms(np.frombuffer(x, width), idf, df, row) for x, row in zip(batch["tail"].to_pylist(), batch["row"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], start, batch["doc_tokens"], batch["tail"], pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "start", "doc_tokens", "tail", "keys"])

    def filler(turn: int):
        """Packs a turn's shards. Before the last, tails that find no neighbours are returned, with their keys."""

        @released
        def fill(batches):
            p = Packer(sent.value[0], mean, turn << 56 | TaskContext.get().partitionId() << 32)
            share = LEAST_SHARE if turn <= KEYS else 0.0
            own: list[tuple] = []
            kind_in = None

            def flush():
                rows, p.rows = [(*r, None, None) for r in p.rows], []
                if share:
                    rows += [(doc, start, len(ids), None, total, None, None, ids.astype(width).tobytes(), keys) for doc, start, ids, total, keys in p.left]
                    p.left = []
                cols = list(zip(*rows)) if rows else [[]] * 9
                return pa.RecordBatch.from_arrays([pa.array(cols[0], kind_in), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.binary()), pa.array(cols[8], pa.list_(pa.int64()))], names=[*out.fieldNames(), "tail", "keys"])

            for batch in batches:
                kind_in = batch["doc_id"].type
                for doc, start, tokens, tail, keys in zip(*(batch[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "tail", "keys"))):
                    own.append((doc, start, np.frombuffer(tail, width), tokens, keys))
                    if len(own) >= SHARD_TAILS:
                        p.shard(own, share)
                        own = []
                        yield flush()
            if kind_in is not None:
                if own:
                    p.shard(own, share)
                if not share:
                    p.finish()
                yield flush()

        return fill

    tails = rows.where(F.octet_length("tail") > 0).mapInArrow(file, T.StructType([T.StructField("doc_id", kind), *longs("start", "doc_tokens"), *held]))
    done = [rows.select("doc_id", "doc_tokens", "crcs").where(F.size("crcs") > 0).mapInArrow(windows, out)]
    for turn in range(1, KEYS + 2):
        key = F.get("keys", F.lit(turn - 1 if turn <= KEYS else 0))
        packed = tails.repartition(key).sortWithinPartitions(key).mapInArrow(filler(turn), T.StructType([*out, *held]))
        if turn <= KEYS:
            packed = cut(packed, "turn")
            tails = packed.where("tail IS NOT NULL").select("doc_id", "start", "doc_tokens", "tail", "keys")
        done.append(packed.where("tail IS NULL").select(*out.fieldNames()))
    pieces = done[0]
    for x in done[1:]:
        pieces = pieces.unionByName(x)
    return pieces.withColumnRenamed("doc_id", id_col)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
