"""Operator 12: phrases that hold together, mined by Misra-Gries summaries of hash partitions and counted exactly in a second pass."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import CHUNK_BYTES, bit_map, chunks, cut, in_map, mix, released, small_batches, text_bytes, words

#: Words of a phrase at most.
LONGEST = 5
#: N-grams that a task holds before it folds equal ones and sends them on.
HELD = 1 << 21
#: Hash partitions for each of Spark's, so that these get about the same; and n-grams of a packed row at most.
DEALT, PACKED = 4, 4096
#: Counters of a summary at least; more as its mass asks for.
LEAST_COUNTERS = 1 << 16
_SEP = np.zeros(256, bool)
_SEP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _SEP.copy()
_APART[[0x20, 0x09]] = True


def _own_parts(col: pa.Array, most: int):
    """(rows, index of their first, end of what they own): runs of rows of so many bytes; a longer text comes in parts.

    A part ends after a separator where there is one; else after a word, and then holds LONGEST - 1 words more, which begin no n-gram of its own.
    """
    for i, j in chunks(col, most):
        part = col.slice(i, j - i)
        data, off = text_bytes(part)
        if j - i > 1 or off[1] - off[0] <= most:
            yield part, i, None
            continue
        text, begin = data[off[0] : off[1]], 0
        while begin < len(text):
            end = begin + most
            if end >= len(text):
                own = end = len(text)
            elif len(at := np.flatnonzero(_SEP[text[begin:end]])):
                own = end = begin + int(at[-1]) + 1
            else:
                own = next_end = _word_end(text, end, most)
                for _ in range(LONGEST - 1):
                    next_end = _word_end(text, next_end, most)
                end = next_end
            yield pa.array([text[begin:end].tobytes()], pa.binary()).cast(pa.string()), i, own - begin
            begin = own


def _word_end(text: np.ndarray, at: int, step: int) -> int:
    """Where the first word that ends behind `at` does."""
    while at < len(text) and _APART[text[at]]:
        at += 1
    while at < len(text):
        found = np.flatnonzero(_APART[text[at : at + step]])
        if len(found):
            return at + int(found[0])
        at += step
    return len(text)


@functools.lru_cache(4096)
def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class _Grams:
    """N-grams of some rows: hashes by their first word, and which of them lie within a piece."""

    def __init__(self, part: pa.Array, langs: list[str], own: int | None):
        before, self.start, self.end, h = words(part, _APART)
        self.data, off = text_bytes(part)
        self.row = np.repeat(np.arange(len(part)), np.diff(before))
        self.base = off[self.row]
        at = self.start + self.base - off[0]
        self.piece = np.cumsum(_SEP[self.data[off[0] : off[-1]]])[at] + self.row if len(at) else at
        self.own = np.ones(len(h), bool) if own is None else self.start < own
        self.words = h
        self.seeds = np.array([_seed(x) for x in langs], np.uint64)

    def __iter__(self):
        """(n, hashes, which count) for n from 1 to LONGEST."""
        with np.errstate(over="ignore"):
            h = mix(self.words + self.seeds[self.row]) if len(self.words) else self.words
            for n in range(1, LONGEST + 1):
                if n > 1:
                    h = mix(h[:-1] * np.uint64(31) + self.words[n - 1 :]) if len(h) else h
                yield n, h, self.own[: len(h)] & (self.piece[n - 1 :] == self.piece[: len(h)])

    def text(self, i: int, n: int) -> str:
        raw = self.data[self.base[i] + self.start[i] : self.base[i] + self.end[i + n - 1]].tobytes().lower()
        return " ".join(w for w in raw.replace(b"\t", b" ").decode().split(" ") if w)


def _rows(batches):
    """Grams of every row of (text, lang) and their rows' languages."""
    for batch in batches:
        langs = batch["lang"].to_pylist()
        for part, i, own in _own_parts(batch["text"], CHUNK_BYTES):
            own_langs = langs[i : i + len(part)]
            yield _Grams(part, own_langs, own), own_langs


def fold(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order, and the sums of their counts."""
    if not len(h):
        return h, c
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(c, first)


class Summary:
    """A Misra-Gries summary that any others can be merged into: every value of `least` or more survives.

    The counters kept exceed mass / least. When twice as many are held, the count of the first one beyond them is taken from all, which takes at least that count times the counters from the
    mass; what was ever taken from a value stays below `least`, else more counters are kept instead. So a value's count is at most what is held and `taken`.
    """

    def __init__(self, least: int, counters: int = LEAST_COUNTERS):
        self.least, self.floor, self.mass, self.taken = least, counters, 0, 0
        self.h, self.c, self.waiting, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, h: np.ndarray, c: np.ndarray) -> None:
        self.waiting.append((h, c))
        self.held += len(h)
        if self.held >= HELD:
            self.settle()

    def settle(self) -> None:
        self.mass += int(sum(c.sum() for _, c in self.waiting))
        self.h, self.c = fold(np.concatenate([self.h, *(h for h, _ in self.waiting)]), np.concatenate([self.c, *(c for _, c in self.waiting)]))
        self.waiting, self.held = [], 0
        counters = max(self.floor, 2 * (self.mass // self.least + 1))
        if len(self.h) > 2 * counters:
            beyond = int(np.partition(self.c, len(self.c) - counters - 1)[len(self.c) - counters - 1])
            if self.taken + beyond < self.least:
                self.taken += beyond
                keep = self.c > beyond
                self.h, self.c = self.h[keep], self.c[keep] - beyond
            else:
                self.floor = len(self.h)

    def survivors(self) -> np.ndarray:
        """Values that may have `least` or more."""
        self.settle()
        return self.h[self.c + self.taken >= self.least]


def _summed(texts: DataFrame, sizes: range, least: int, frequent: tuple | None) -> DataFrame:
    """Hashes (h) of the n-grams of these sizes that may occur `least` times; frequent are maps of pairs that longer ones must be made of.

    Tasks fold equal n-grams and deal them to hash partitions as packed numbers; each partition keeps one summary.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @released
    def deal(batches):
        held, size = [], 0

        def send():
            h, c = fold(np.concatenate(held), np.ones(size, np.int64))
            part = (h % np.uint64(DEALT * parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            h, c, part = h[order], c[order].astype(np.uint32), part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            cuts = np.unique(np.concatenate([first, *(np.arange(a, b, PACKED) for a, b in zip(first, [*first[1:], len(h)]))]))
            blobs = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(h)])], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(part[cuts]), blobs(h), blobs(c)], ["part", "h", "c"])

        for grams, _ in _rows(batches):
            pairs = None
            for n, h, ok in grams:
                if n == 2 and frequent is not None:
                    pairs = _in_maps(frequent, h)
                if n > 2 and pairs is not None:
                    ok = ok & np.logical_and.reduce([pairs[k : k + len(h)] for k in range(n - 1)])
                if n in sizes:
                    held.append(h[ok])
                    size += len(held[-1])
                if n == sizes[-1]:
                    break
            if size >= HELD:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    @released
    def summarise(batches):
        summary = Summary(least)
        for batch in batches:
            for h, c in zip(batch["h"], batch["c"]):
                summary.add(np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(summary.survivors().view(np.int64))], ["h"])

    dealt = texts.mapInArrow(deal, "part int, h binary, c binary")
    return dealt.repartition(parts, "part").mapInArrow(summarise, "h bigint")


ENTRY = pa.struct([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _counted(texts: DataFrame, maps: dict[int, tuple], least: int) -> DataFrame:
    """(lang, n, phrase, f): exact counts of the n-grams that their size's maps let through and that occur `least` times; n = 0 has a language's words.

    Tasks count by hash, and deal phrases with their counts to hash partitions in lists; each partition adds up its own phrases, word for word.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @released
    def count(batches):
        known, counts, told, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}, {}

        def send():
            rows = [(x % (DEALT * parts), (*told[x], c)) for x, c in zip(known.tolist(), counts.tolist())] + [(_seed(lang) % (DEALT * parts), (lang, 0, "", c)) for lang, c in total.items()]
            rows.sort(key=lambda x: x[0])
            part = np.array([x[0] for x in rows])
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(rows)]
            cuts = sorted({*cuts, *(i for a, b in zip(cuts, cuts[1:]) for i in range(a, b, PACKED // 4))})
            entries = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*(e for _, e in rows)), ENTRY)], fields=list(ENTRY))
            return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), entries)], ["part", "entries"])

        for grams, langs in _rows(batches):
            found = []
            for n, h, ok in grams:
                if n == 1:
                    for row, c in enumerate(np.bincount(grams.row[ok], minlength=len(langs)).tolist()):
                        if c:
                            total[langs[row]] = total.get(langs[row], 0) + c
                at = np.flatnonzero(ok)
                at = at[_in_maps(maps[n], h[at])]
                u, first, c = np.unique(h[at], return_index=True, return_counts=True)
                for x, i in zip(u.tolist(), at[first].tolist()):
                    if x not in told:
                        told[x] = (langs[grams.row[i]], n, grams.text(i, n))
                found.append((u, c))
            known, counts = fold(np.concatenate([known, *(u for u, _ in found)]), np.concatenate([counts, *(c for _, c in found)]))
            if len(known) > HELD // 8:
                yield send()
                known, counts, told, total = known[:0], counts[:0], {}, {}
        if len(known) or total:
            yield send()

    @released
    def add(batches):
        own: dict[tuple, int] = {}
        for batch in batches:
            entries = batch["entries"].flatten()
            for *key, f in zip(*(entries.field(c.name).to_pylist() for c in ENTRY)):
                key = tuple(key)
                own[key] = own.get(key, 0) + f
        rows = [(*k, f) for k, f in own.items() if k[1] == 0 or f >= least]
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + 50_000]), ENTRY)], [f.name for f in ENTRY])

    dealt = texts.mapInArrow(count, "part int, entries array<struct<lang:string, n:int, phrase:string, f:bigint>>")
    return dealt.repartition(parts, "part").mapInArrow(add, "lang string, n int, phrase string, f bigint")


def _maps(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two maps of the hashes found, by their lowest bits and by others, of 64 bits or more for each; together they let through one of thousands besides."""
    n = 8 * found.count()
    return bit_map(found, "h", n), bit_map(found.select(F.shiftrightunsigned("h", 32).alias("h")), "h", n)


def _in_maps(maps: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    return in_map(maps[0], h) & in_map(maps[1], h >> np.uint64(32))


def phrase_counts(docs: DataFrame, least: int = 100) -> DataFrame:
    """(lang, n, phrase, f) of every phrase of 1 to 5 words that occurs `least` times in its language's texts, exactly; n = 0 has the language's words in all.

    Two rounds of summaries find what may be frequent: words and pairs, then longer phrases, which are made of frequent pairs. Then all are counted. Summaries and maps go by 64-bit hashes,
    which only let phrases in; within a task phrases of one hash are taken as one.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    short = cut(_summed(texts, range(1, 3), least, None), "grams")
    bits = _maps(short)
    more = _maps(cut(_summed(texts, range(3, LONGEST + 1), least, bits), "grams"))
    return _counted(texts, {n: bits if n < 3 else more for n in range(1, LONGEST + 1)}, least)


def mine(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """Each language's `top` phrases of 2 to 5 words by how much they hold together: lang, rank, phrase, a, l, r, n, score.

    The score of a cut is floor(1000 * a * n / (l * r)), a phrase's that of its lowest cut; products are decimals of 38 digits. Phrases that only occur within a longer one go: then they do
    within one that is a word longer, since counts fall with length.

    docs has text and lang, whatever else. Null texts are empty, a null lang is und. Repeated rows count each; texts of any length are read in parts. An empty table gives no rows.
    """
    counts = cut(phrase_counts(docs, least), "phrases")
    words_of = counts.where("n = 0").select("lang", F.col("f").alias("words"))
    found = counts.where("n > 1").select("lang", "n", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    shorter = F.explode(F.array(F.slice("w", 1, F.col("n") - 1), F.slice("w", 2, F.col("n") - 1)))
    within = found.where("n > 2").select("lang", "a", shorter.alias("w")).groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    own = found.join(within, ["lang", "phrase"], "left").where(F.coalesce("longer", F.lit(0)) < F.col("a"))
    cuts = own.select("lang", "phrase", "a", "n", "w", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("rest"))
    part = lambda name, f: counts.where("n > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(words_of, "lang")
    scored = scored.withColumn("score", F.expr("(CAST(1000 AS DECIMAL(38, 0)) * a * words) div (CAST(l AS DECIMAL(38, 0)) * r)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "words")).alias("b")).select("lang", "phrase", "b.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.select("lang", rank.alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score").where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("bigint"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0),
totals AS (SELECT lang, count(*) AS words FROM starts GROUP BY lang),
grams AS (SELECT lang, list_slice(w, i, i + m - 1) AS p FROM starts, (SELECT unnest(range(1, 6)) AS m) s WHERE i + m - 1 <= len(w)),
counts AS (SELECT lang, p, len(p) AS m, count(*) AS f FROM grams GROUP BY lang, p HAVING count(*) >= 100),
within AS (
  SELECT lang, q, max(f) AS longer FROM (
    SELECT lang, f, list_slice(p, 1, m - 1) AS q FROM counts WHERE m > 2 UNION ALL SELECT lang, f, list_slice(p, 2, m) FROM counts WHERE m > 2) u GROUP BY lang, q),
own AS (SELECT c.* FROM counts c LEFT JOIN within x ON x.lang = c.lang AND x.q = c.p WHERE c.m > 1 AND coalesce(x.longer, 0) < c.f),
cuts AS (
  SELECT o.lang, array_to_string(o.p, ' ') AS phrase, o.f AS a, k, c.f AS l, d.f AS r, t.words,
    CAST((1000::HUGEINT * o.f * t.words) // (c.f::HUGEINT * d.f) AS BIGINT) AS score
  FROM own o, (SELECT unnest(range(1, 5)) AS k) s, counts c, counts d, totals t
  WHERE k < o.m AND c.lang = o.lang AND c.p = list_slice(o.p, 1, k) AND d.lang = o.lang AND d.p = list_slice(o.p, k + 1, o.m) AND t.lang = o.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, words AS n, score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
