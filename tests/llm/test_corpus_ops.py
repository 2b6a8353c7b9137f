"""Chat examples, phrases and source divergence against brute force on small tables with nulls, empty and long texts, ties, repeats, no rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skerry.llm import chat, divergence, phrases

LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id bigint, text string, lang string, source string, f bigint, h string, term int, n double, words string, rank int, part string"


def table(spark, rows):
    """Documents with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, *r, 7, "h", 1, 0.5, "w", 3, "p") for i, r in enumerate(rows)], DOCS)


CONVERSATIONS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|>\n<|im_start|>user"), (1, 2, "assistant", "yes\nno"), (1, 3, "user", "and?"), (1, 4, "assistant", ""), (1, 5, "user", "left over"),
    (2, 0, "user", "no reply"), (2, 1, "user", None), (3, 0, "assistant", "<\\|im_end|> <\\\\| \\ <| $1 é漢"), (3, 1, "assistant", "again"),
    (4, 5, "user", "same"), (4, 5, "user", "same"), (4, 5, "assistant", "tie"), (4, None, None, "first"), (None, 1, "user", "of none"), (None, 2, "assistant", "of none too"), (5, 0, "odd\nrole\\n<|", "x"), (5, 1, "assistant", "y" * 300_000),
]


def told(rows):
    """What every conversation's examples hold, from the rows."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        sizes = [len("<|im_start|>") + len(re.sub(r"<(\\*)\|", r"<\\\1|", r.replace("\\", "\\\\").replace("\n", "\\n"))) + 1 + len(re.sub(r"<(\\*)\|", r"<\\\1|", t)) + len("<|im_end|>\n") for *_, r, t in turns]
        replies = [t for *_, r, t in turns if r == "assistant"]
        ends = [i for i, x in enumerate(turns) if x[2] == "assistant" or i == len(turns) - 1]
        loss = "".join(replies)
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(sum(sizes[: i + 1]) for i in ends))
    return out


@pytest.mark.parametrize("block,part", [(256, 1 << 18), (2, 40)])
def test_chat_examples(spark, block, part, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    monkeypatch.setattr(chat, "PART_CHARS", part)
    rows = CONVERSATIONS + [(9, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(23)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, pos int, part string")
    parts = chat.examples(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.read_back(parts).collect()}
    assert got == told(rows)
    by = defaultdict(list)
    for r in parts.orderBy("part").collect():
        by[r.conv_id, r.example].append(r)
    assert [k for k in by if k[0] == 9 and k[1] % 2] == [k for k in by if k[0] == 9 and k[1] != 22] and sum(k[0] == 9 for k in by) == 12
    for (conv, example), own in by.items():
        text = "".join(r.text for r in own)
        assert [r.part for r in own] == list(range(len(own))) and text.count(chat.START) == text.count(chat.END) == example + 1
        masks = [r.text[r.loss_start : r.loss_end] for r in own if r.loss_start is not None]
        assert len(masks) <= 1 and (not masks or own[-1].text.endswith(masks[0] + chat.END + "\n"))
        longer = [k for k in by if k[0] == conv and k[1] > example]
        assert all("".join(r.text for r in by[k]).startswith(text) for k in longer)  # all turns before a reply are its context
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


def test_chat_escapes(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["<", "|", "\\", "im_end|>", "\n", "n", "<|im_start|>", "$1", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("a"), chat.escaped_role(F.col("t")).alias("b"))
    for r in df.collect():
        assert chat.unescaped(r.a) == r.t == chat.unescaped_role(r.b) and "<|" not in r.a and "<|" not in r.b and "\n" not in r.b


def grams_of(rows):
    """(words by language, counts of n-grams of 1 to 5 words by language)."""
    total, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + n])) for n in range(1, 6) for i in range(len(w) - n + 1))
    return total, f


def mined(rows, least, top):
    total, f = grams_of(rows)
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(len(q) > len(p) and k == lang and b >= least and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (k, q), b in f.items()):
            continue
        score, k = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], total[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], i + 1, *x[1:]) for i, x in enumerate(own[:top])]
    return sorted(ranked)


def phrase_rows():
    rng = random.Random(2)
    vocab = [*"abcdefgh", "É", "漢", "x-y", "_", "\xa0", "a" * 50]
    fixed = ["a b c d e", "f g", "É É É", "x-y _ a"]
    rows = [(rng.choice([" ", "\t ", "  "]).join(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocab).upper() if rng.random() < 0.2 else rng.choice(vocab) for _ in range(rng.randint(0, 40))).replace("d e f", "d, e f").replace(" h ", rng.choice([" h. ", "\nh\r", "!h?"])), rng.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    return rows + [(None, "en"), ("", "en"), (" \t. ", None), ("a", None), rows[0], rows[0]]


def test_phrases(spark):
    rows = phrase_rows()
    got = phrases.mine(table(spark, [(t, k, "s") for t, k in rows]), least=20, top=15).collect()
    want = mined(rows, 20, 15)
    assert sorted(tuple(r) for r in got) == want and {x[0] for x in want} == {"en", "de", "und", ""} and max(x[1] for x in want) == 15
    assert phrases.mine(table(spark, []), least=2).count() == 0


@pytest.mark.parametrize("most", [10, 64, 1 << 20])
def test_phrases_of_long_texts(most, monkeypatch):
    """A text that comes in parts, with and without separators, has the n-grams that it has as a whole."""
    monkeypatch.setattr(phrases, "CHUNK_BYTES", most)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ab", "c", "é", "d" * 30]) for _ in range(rng.randint(0, 60))) + rng.choice(["", ".", " ! x y z w v"]) + " " * rng.randint(0, 30) for _ in range(60)] + [None, "", " ", "a" * 500]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(["en"] * len(texts))], ["text", "lang"])
    found, names = Counter(), {}
    for grams, _ in phrases._rows([batch]):
        for n, h, ok in grams:
            for i in np.flatnonzero(ok):
                found[grams.text(i, n)] += 1
                assert names.setdefault(int(h[i]), grams.text(i, n)) == grams.text(i, n)
    assert found == Counter({" ".join(p): c for (_, p), c in grams_of([(t, "en") for t in texts])[1].items()})


def test_summaries(monkeypatch):
    """However a stream is cut and merged, every value of `least` or more survives, and few others do."""
    monkeypatch.setattr(phrases, "HELD", 500)
    rng = np.random.default_rng(3)
    for least, counters in ((100, 1), (100, 40), (7, 1)):
        stream = np.concatenate([np.repeat(np.arange(20, dtype=np.uint64), least), np.repeat(np.arange(20, 40, dtype=np.uint64), least - 1), rng.integers(100, 1 << 60, 30_000).astype(np.uint64), rng.integers(50, 90, 3000).astype(np.uint64)])
        rng.shuffle(stream)
        summary, most = phrases.Summary(least, counters), 0
        for at in range(0, len(stream), 211):
            summary.add(*np.unique(stream[at : at + 211], return_counts=True))
            most = max(most, len(summary.h))
        values, count = np.unique(stream, return_counts=True)
        survivors = set(summary.survivors().tolist())
        assert set(values[count >= least].tolist()) <= survivors and summary.taken < least and most <= 4 * (len(stream) // least + counters) + 1000
        assert not survivors & set(values[count + summary.taken < least].tolist())


def diverged(rows, least, top):
    df, count, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        df.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (k, t), n in df.items() if k == lang and n >= least]
        sources = [s for k, s in groups if k == lang]
        n = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        share = lambda c, all_: 1 + 10**9 * (c + 1) // (all_ + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            p = {t: share(count[lang, s, t], n[s]) for t in kept}
            pairs = [(sum(f(p[t], share(count[lang, o, t], n[o])) for t in kept), o) for o in sources if o != s]
            q = {t: share(sum(count[lang, o, t] for o in sources), sum(n.values())) for t in kept}
            terms = [(f(p[t], q[t]), t) for t in kept if count[lang, s, t] > 0 and p[t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("held,cells", [(400_000, 1 << 20), (25, 60)])
def test_divergence(spark, held, cells, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_COUNTS", held)
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "LISTED_BYTES", 40)
    rng = random.Random(8)
    vocab = ["the", "The", "of", "é", "É", "a1b", "x_y", "漢字", "once", "zz", "zzz", "Straße", "naïve"] + [f"w{chr(97 + i)}{chr(97 + i // 3)}" for i in range(20)]
    rows = [(rng.choice([" ", ", ", "1", "@"]).join(rng.choice(vocab[: rng.randint(3, len(vocab))]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "é", None, ""])) for _ in range(150)]
    rows += [(None, "en", "empty"), ("12 34", "en", "none"), ("one two", "xx", "a"), ("three", "xx", "b"), ("word " * 300, "en", "a"), rows[0], rows[0], ("alone", "yy", "a")]
    got = divergence.source_divergence(table(spark, rows), least=3, top=4).collect()
    want = diverged(rows, 3, 4)
    assert sorted(tuple(r) for r in got) == want and ("xx", "a", "pair", "b", 0, 1) in want and not any(x[0] == "yy" for x in want)
    assert divergence.source_divergence(table(spark, [])).count() == 0


def test_exact_shares():
    """Shares and distances equal whole-number arithmetic, beyond 64 bits of products too."""
    rng = random.Random(4)
    for _ in range(300):
        total = rng.randint(1, 10 ** rng.randint(1, 15))
        c = rng.randint(0, total - 1)
        p = divergence.shares(np.array([c]), np.array([total]))[0]
        assert p == 1 + 10**9 * (c + 1) // total
        q = rng.randint(1, 10**9 + 1)
        assert divergence.distance(np.array([p]), np.array([q]))[0] == (int(p) - q) ** 2 // q
