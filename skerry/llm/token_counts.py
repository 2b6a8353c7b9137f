"""Operator 10: token counts of a document's sections from one encoding of the whole document."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import released, small_batches

RULES = ("first", "last", "most")
_ENCODINGS: dict[str, tuple] = {}


def encoding(path: str):
    """The byte-level encoding of a ranks file, and each id's number of bytes."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _ENCODINGS[path]


def char_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of every token; a token that has part of a character has it in its span."""
    end = np.cumsum(lengths)
    begin = end - lengths
    if text.isascii():
        return begin, end
    head = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)  # characters begun up to and with each byte
    return head[begin] - 1, head[end - 1]


def line_starts(text: str) -> np.ndarray:
    """Sections that tile a text: its lines, each with the line feed that ends it. An empty text has one empty section."""
    starts, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts)


def section_bounds(sections: list[dict | None] | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of given sections in ascending order, within the text and apart: those with a null bound are left out, and one that overlaps others keeps what comes after them."""
    starts, ends, last = [], [], 0
    for a, b in sorted((s["start"], s["end"]) for s in sections or [] if s and s["start"] is not None and s["end"] is not None):
        a = min(max(a, last), size)
        last = max(a, min(b, size))
        starts.append(a)
        ends.append(last)
    return np.array(starts, np.int64), np.array(ends, np.int64)


def allot(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section [starts, ends), in ascending order and apart; then of none. One pass over sorted bounds joins the intervals.

    A token that crosses a bound counts once: "first" gives it to the section of its first character, "last" to that of its last, "most" to the section with
    most of its characters, the earlier of equals. Characters outside all sections count as none's.
    """
    def at(x):
        i = np.searchsorted(starts, x, "right") - 1
        return np.where((i >= 0) & (x < ends[np.maximum(i, 0)]), i, len(starts))

    first, last = at(begin), at(end - 1)
    owner = last if rule == "last" else first
    if rule == "most":
        owner = first.copy()
        for t in np.flatnonzero((first != last) | (first == len(starts))):
            lo, hi = np.searchsorted(ends, begin[t], "right"), np.searchsorted(starts, end[t], "left")
            shares = [(min(end[t], ends[s]) - max(begin[t], starts[s]), -s) for s in range(lo, hi)]
            outside = end[t] - begin[t] - sum(n for n, _ in shares)
            best = max(shares, default=(0, 0))
            owner[t] = -best[1] if best[0] > 0 and best[0] >= outside else len(starts)
    return np.bincount(owner, minlength=len(starts) + 1)


def count_tokens(docs: DataFrame, rule: str = "first", sections_col: str | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, section_id, start, end, n_tokens, doc_tokens): tokens of every section of every document.

    A whole text is encoded once, so its sections' tokens add up to its own. Without sections_col the sections are the text's lines; with it they are its array
    of structs (start, end) in characters, by section_bounds, numbered in ascending order, and tokens that no section gets make a row with section_id -1. rule says who gets a
    token that crosses a bound: see allot. Null texts are empty; an empty text has a section without tokens. Null ids and repeated rows stay as they are. Other
    columns are ignored. path names a ranks file; None takes public_tokenizers' byte_bpe_50k.tiktoken.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    small_batches(docs.sparkSession)
    more = [F.col(sections_col).alias("sections")] if sections_col else []
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)

    @released
    def run(batches):
        coder, size = encoding(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                cols: list[list] = [[] for _ in range(6)]
                for k, (doc, text) in enumerate(zip(some["doc_id"].to_pylist(), some["text"].to_pylist())):
                    text = text or ""
                    lengths = size[coder.encode_ordinary(text)] if text else np.zeros(0, np.int64)
                    begin, end = char_spans(text, lengths)
                    if sections_col:
                        starts, ends = section_bounds(some["sections"][k].as_py(), len(text))
                    else:
                        starts = line_starts(text)
                        ends = np.append(starts[1:], len(text))
                    got = allot(begin, end, starts, ends, rule) if len(starts) else np.array([len(lengths)])
                    names = list(range(len(starts)))
                    if got[-1]:
                        names, starts, ends = [*names, -1], np.append(starts, 0), np.append(ends, len(text))
                    for col, x in zip(cols, ([doc] * len(names), names, starts.tolist(), ends.tolist(), got[: len(names)].tolist(), [len(lengths)] * len(names))):
                        col += x
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "section_id", "start", "end", "n_tokens", "doc_tokens"])

    return src.mapInArrow(run, "doc_id long, section_id long, start long, end long, n_tokens long, doc_tokens long").withColumnRenamed("doc_id", id_col)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
