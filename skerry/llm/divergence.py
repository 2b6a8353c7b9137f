"""Operator 13: how the words of each source diverge from those of the others and of its language, from stripes that tasks fold their documents into."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import cut, new_path, read_rows, released, small_batches, stored

#: Fixed by definition: what a term is made of, after A-Z are lower-cased. In UTF-8 all bytes of other characters are above 0x7F.
TERM = re.compile(rb"[a-z\x80-\xff]+")
_OTHER = re.compile(rb"[^a-z\x80-\xff]")
#: A term's share is counted in so many parts.
SHARES = 1_000_000_000
#: Counts that a task's stripes hold, and bytes of text that they come from, before they are spilled; bytes of text whose terms are listed at once.
HELD_COUNTS, HELD_BYTES, LISTED_BYTES = 1_000_000, 128 << 20, 1 << 20
#: Cells of a matrix of terms and sources that a task works on.
CELLS = 1 << 20
STRIPES = "lang string, term string, df bigint, counts array<struct<source:string, n:bigint>>"


def _terms(text: bytes):
    """Lists of a text's terms in order; a long text gives several."""
    begin = 0
    while begin < len(text):
        m = _OTHER.search(text, begin + LISTED_BYTES) if len(text) - begin > LISTED_BYTES else None
        end = m.start() if m else len(text)
        yield TERM.findall(text, begin, end)
        begin = end


def _stripe_rows(lang: pa.Array, term: pa.Array, df: np.ndarray, row: np.ndarray, source: np.ndarray, names: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    """Stripes of rows (lang, term) with their df, from counts in order of row: n of the source that names[source] is."""
    counts = pa.StructArray.from_arrays([names.take(pa.array(source)), pa.array(n)], ["source", "n"])
    ends = np.searchsorted(row, np.arange(len(df) + 1))
    return pa.RecordBatch.from_arrays([lang, term, pa.array(df), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), counts)], ["lang", "term", "df", "counts"])


def _stripes(docs: DataFrame) -> DataFrame:
    """Stripes of (lang, term) as tasks spill them: documents that have the term, and its occurrences by source."""

    @released
    def fold(batches):
        stripes: dict[str, tuple] = {}  # by language: documents of each term, and by source its occurrences
        held = read = 0

        def spill():
            for lang, (df, counts) in stripes.items():
                if not df:
                    continue
                index = dict(zip(df, range(len(df))))
                row = np.concatenate([np.fromiter(map(index.__getitem__, c), np.int64, len(c)) for c in counts.values()])
                source = np.repeat(np.arange(len(counts)), [len(c) for c in counts.values()])
                n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in counts.values()])
                order = np.argsort(row, kind="stable")
                terms, ends = pa.array(list(df), pa.binary()).cast(pa.string()), np.fromiter(df.values(), np.int64, len(df))
                whole = _stripe_rows(pa.array([lang], pa.string()).take(pa.array(np.zeros(len(df), np.int64))), terms, ends, row[order], source[order], pa.array(list(counts), pa.string()), n[order])
                for i in range(0, len(df), 50_000):
                    yield whole.slice(i, 50_000)

        for batch in batches:
            for text, lang, source in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["lang"].to_pylist(), batch["source"].to_pylist()):
                if lang not in stripes:
                    stripes[lang] = Counter(), {}
                df, counts = stripes[lang]
                own = counts.setdefault(source, Counter())
                before, seen = len(own), set()
                for terms in _terms(text.lower()):  # of bytes: A-Z alone
                    own.update(terms)
                    seen.update(terms)
                df.update(seen)
                held += len(own) - before
                read += len(text)
                if held > HELD_COUNTS or read > HELD_BYTES:
                    yield from spill()
                    stripes, held, read = {}, 0, 0
        yield from spill()

    return docs.mapInArrow(fold, STRIPES)


def combined(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One stripe for each run of rows of one (lang, term)."""
    lang, term = batch["lang"], batch["term"]
    same = pc.and_(pc.equal(lang.slice(1), lang.slice(0, len(lang) - 1)), pc.equal(term.slice(1), term.slice(0, len(term) - 1))).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    group = np.cumsum(np.concatenate([[False], ~same]))
    pairs = batch["counts"].flatten()
    source = pairs.field("source").dictionary_encode()
    names = source.dictionary
    key = np.repeat(group, pc.list_value_length(batch["counts"]).to_numpy(zero_copy_only=False)) * len(names) + source.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    key, n = key[order], pairs.field("n").to_numpy(zero_copy_only=False)[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key = key[at]
    return _stripe_rows(lang.take(pa.array(first)), term.take(pa.array(first)), np.add.reduceat(batch["df"].to_numpy(), first), key // len(names), key % len(names), names, np.add.reduceat(n, at))


def _merged(stripes: DataFrame, least: int) -> DataFrame:
    """One stripe of each (lang, term) that `least` documents have. Equal keys lie together, so a task holds a batch at a time and the last key's stripe so far."""
    parts = int(stripes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @released
    def merge(batches):
        last = None
        kept = lambda x: x.filter(pc.greater_equal(x["df"], least))
        for batch in batches:
            if len(batch):
                batch = combined(pa.concat_batches([last, batch]) if last else batch)
                yield kept(batch.slice(0, len(batch) - 1))
                last = batch.slice(len(batch) - 1)
        if last:
            yield kept(last)

    return stripes.repartition(parts, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merge, STRIPES)


def shares(count: np.ndarray, all_of: np.ndarray | int) -> np.ndarray:
    """1 + floor(SHARES * (count + 1) / all_of), exactly: long division by thousands, for totals below 9e15."""
    rest, out = count.astype(np.int64) + 1, np.zeros(np.broadcast(count, all_of).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // all_of
        rest = rest % all_of
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q). Shares are at most 1 + SHARES, so that squares have under 63 bits; so have sums over all terms, whose shares sum to SHARES and their number."""
    return (p - q) * (p - q) // q


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """For each language and source its distance to every other source (part pair) and the terms that it has more of than its language (part term): lang, source, part, item, value, rank.

    Tasks fold whole documents into stripes, a term's documents and occurrences by source, spill them by size, and equal keys are merged; merged stripes give sums for pairs and terms' values.
    A key has one stripe a spill, so the commonest word is no hot key. Tasks keep the sums of pairs and send them once; the totals of groups, of which pairs has the square, are read from
    the shared folder.

    docs has text, lang and source, whatever else; nulls are ''. A group without terms has its pairs. Repeated rows are documents of their own. Texts of any length are listed in parts.
    An empty table gives no rows.
    """
    spark = small_batches(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(empty("text"), empty("lang"), empty("source"))
    merged = cut(_merged(_stripes(docs), least), "stripes")
    each = merged.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    terms = merged.groupBy("lang").agg(F.count("*").alias("v"))
    groups = docs.select("lang", "source").distinct().join(each, ["lang", "source"], "left").join(terms, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    path = new_path(spark, "groups")
    groups = stored(groups, path)

    @released
    def values(batches):
        known: dict[str, tuple] = {}
        by_lang: dict[str, list] = {}
        for g in read_rows(path, ["lang", "source", "n", "v"]).to_pylist():
            by_lang.setdefault(g["lang"], []).append((g["source"], g["n"], g["v"]))
        for lang, own in by_lang.items():
            own.sort()
            n = np.array([x[1] for x in own], np.int64)
            known[lang] = ({x[0]: i for i, x in enumerate(own)}, n + own[0][2], int(n.sum()) + own[0][2], np.zeros((len(own), len(own)), np.int64))

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "part", "item", "value"])

        for batch in batches:
            codes = batch["lang"].dictionary_encode()
            for k, lang in enumerate(codes.dictionary.to_pylist()):
                own = batch.take(pa.array(np.flatnonzero(codes.indices.to_numpy() == k)))
                index, totals, total, sums = known[lang]
                names, words, step = list(index), own["term"], max(1, CELLS // len(index))
                for at in range(0, len(own), step):
                    some = own["counts"].slice(at, step)
                    pairs = some.flatten()
                    term = np.repeat(np.arange(len(some)), pc.list_value_length(some).to_numpy(zero_copy_only=False))
                    source = pairs.field("source").dictionary_encode()
                    rank = np.array([index[x] for x in source.dictionary.to_pylist()], np.int64)[source.indices.to_numpy()]
                    count = np.zeros((len(index), len(some)), np.int64)
                    count[rank, term] = pairs.field("n").to_numpy()
                    p, q = shares(count, totals[:, None]), shares(count.sum(0), total)
                    for i in range(len(index)):
                        sums[i] += distance(p[i], p).sum(1)
                    si, ki = np.nonzero((count > 0) & (p > q))
                    if len(si):
                        value = distance(p[si, ki], q[ki])
                        # no more than the first `top` of a source can be among all tasks' first
                        order = np.lexsort((-value, si))
                        si, ki, value = si[order], ki[order], value[order]
                        keep = value >= _least_kept(si, value, top)
                        yield rows([(lang, names[s], "term", w, v) for s, w, v in zip(si[keep].tolist(), words.take(pa.array(at + ki[keep])).to_pylist(), value[keep].tolist())])
        found = [(lang, a, "pair", b, int(sums[i, j])) for lang, (index, _, _, sums) in known.items() for a, i in index.items() for b, j in index.items() if a != b and sums[i, j]]
        for i in range(0, len(found), 50_000):
            yield rows(found[i : i + 50_000])

    out = cut(merged.mapInArrow(values, "lang string, source string, part string, item string, value bigint"), "divergence")
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("bigint").alias("value"))
    pairs = pairs.unionByName(out.where("part = 'pair'")).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = out.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(best)


def _least_kept(group: np.ndarray, value: np.ndarray, top: int) -> np.ndarray:
    """For rows in order of group and falling value: the value of the group's row number `top`, or its last."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([first, [len(group)]]))
    return np.repeat(value[first + np.minimum(size, top) - 1], size)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
occ AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
counts AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM occ o JOIN kept k ON k.lang = o.lang AND k.term = o.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n, coalesce(max(v.v), 0)::HUGEINT AS v
  FROM groups g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source LEFT JOIN v ON v.lang = g.lang GROUP BY g.lang, g.source),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (n.n + n.v) AS p
  FROM n JOIN kept k ON k.lang = n.lang LEFT JOIN counts c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
whole AS (SELECT lang, sum(n) AS n, max(v) AS v FROM n GROUP BY lang),
q AS (SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.c)::HUGEINT + 1)) // (max(w.n) + max(w.v)) AS q FROM counts c JOIN whole w ON w.lang = c.lang GROUP BY c.lang, c.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(max(s.value), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY ALL),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) u)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
