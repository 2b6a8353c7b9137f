"""Operator 7: personal data found from anchors and expanded by local parsers."""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import released, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
#: What the method adds to the base kinds, in the order in which spans are listed after them.
MORE_KINDS = ("card_part", "phone_part", "url", "account", "secret")
KINDS = BASE_KINDS + MORE_KINDS

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/@:<>\"']+(:[^\s/@<>\"']*)?@[^\s<>\"']+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}")
_NUMBER = re.compile(r"[A-Z0-9](?:[\x20./-]?[A-Z0-9]){4,29}")
_GAP = re.compile(r"[\"']?\s{0,3}(?:(?:no|nr|number|nummer|id|code)\b\.?\s{0,2})?[:=#]?\s{0,3}[\"']?", re.I)
_SECRET = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
#: Identifier cues and what follows them.
CUES = {"account": ("iban", "account", "konto", "compte", "cuenta", "ssn", "social security", "passport", "tax id", "routing"), "secret": ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "access_key", "bearer")}


def _automaton() -> ahocorasick.Automaton:
    """Anchors: at-signs, plus signs, digits, schemes and cues in three spellings."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", ("url", 3))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.title()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = re.sub(r"[\x20-]", "", text)
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def card_parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Card numbers made of whole groups within a run of digits that isn't one itself: from the left, the longest first."""
    groups, out, i = [(m.start() + start, m.end() + start) for m in re.finditer("[0-9]+", text[start:end])], [], 0
    while i < len(groups):
        for j in range(min(len(groups), i + 19), i, -1):
            digits = "".join(text[a:b] for a, b in groups[i:j])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((groups[i][0], groups[j - 1][1]))
                i = j - 1
                break
        i += 1
    return out


def phone_part(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The longest phone number of whole groups that begins a run of more digits than one has."""
    digits, best = 0, []
    for m in re.finditer("[0-9]+", text[start:end]):
        digits += m.end() - m.start()
        if digits > 15:
            break
        best = [(start, start + m.end())] if digits >= 9 else best
    return best


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed in KINDS and then by start.

    Every kind is found leftmost and without overlap within itself, each anchor at most once: an anchor inside what its kind has already read is passed over.
    """
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (anchor, length) in _ANCHORS.iter(text):
        at = last - length + 1
        if anchor == "digit":
            # an address's number or a card's digits start at the first of a run, or where the last one of its kind ended
            if at >= done["card"]:
                m = _CARD.match(text, at)
                if m:
                    done["card"] = m.end()
                    digits = re.sub(r"[\x20-]", "", m[0])
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
                    elif len(digits) > 13:
                        found["card_part"] += card_parts(text, *m.span())
            if at >= done["ip"]:
                m = _IP.match(text, at)
                if m:
                    done["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                        found["ip"].append(m.span())
                else:  # nor does any later digit of this run start one
                    end = at + 1
                    while end < len(text) and "0" <= text[end] <= "9":
                        end += 1
                    done["ip"] = end
        elif anchor == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at) if start < at else None
            if m:
                done["email"] = m.end()
                found["email"].append((start, m.end()))
        elif anchor == "+":
            m = _PHONE.match(text, at)
            if m:
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found["phone"].append(m.span())
                else:
                    found["phone_part"] += phone_part(text, *m.span())
        elif anchor == "url":
            # only addresses that name a user are personal
            start = at
            while start > done["url"] and at - start < 12 and (text[start - 1].isascii() and text[start - 1].isalpha()):
                start -= 1
            m = _USERINFO.match(text, at + 3) if start < at else None
            if m:
                done["url"] = m.end()
                found["url"].append((start, m.end()))
        elif at >= done[anchor] and not (at and text[at - 1].isalnum()):
            gap = _GAP.match(text, last + 1)
            if anchor == "secret":
                m = _SECRET.match(text, gap.end())
                if m and re.search(r"[0-9]", m[0]) and gap.end() > last + 1:
                    done["secret"] = m.end()
                    found["secret"].append(m.span())
            elif gap.end() > last + 1:
                m = _IBAN.match(text, gap.end())
                if not (m and iban_valid(m[0])):
                    m = _NUMBER.match(text, gap.end())
                    m = m if m and sum("0" <= c <= "9" for c in m[0]) >= 5 else None
                if m:
                    done["account"] = m.end()
                    found["account"].append(m.span())
    return [(k, a, b) for k in KINDS for a, b in sorted(found[k])]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span, overlapping ones together, replaced by the kind that starts it, as in <EMAIL>."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact_texts(docs: DataFrame) -> DataFrame:
    """docs with every span that find_spans finds in text replaced by its kind, and n_chars, where there is one, the new text's. Null texts stay null."""

    small_batches(docs.sparkSession)

    @released
    def run(batches):
        for batch in batches:
            texts = [t if not (s := find_spans(t)) else redact(t, s) for t in batch["text"].to_pylist()]
            cols = {n: batch[n] for n in batch.schema.names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(t) if t is not None else n for t, n in zip(texts, batch["n_chars"].to_pylist())], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, docs.schema)


def scan_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all kinds), n_spans (how many) for every row of docs.

    Whole texts are read, null as empty; a text without spans has the digest of the empty string and no spans. A null doc_id stays null and repeated rows give
    repeated rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    @released
    def run(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            all_spans = [find_spans(t) for t in texts]
            base = [[s for s in spans if s[0] in BASE_KINDS] for spans in all_spans]
            cols = [batch["doc_id"], *(pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in BASE_KINDS), pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string()), pa.array([listed(s) for s in all_spans], pa.string()), pa.array([len(s) for s in all_spans], pa.int64())]
            names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_spans"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
