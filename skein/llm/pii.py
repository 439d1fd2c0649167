"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in each text: at-signs, plus signs, digits, dots before digits,
URL schemes, cues of identifiers and prefixes of known credentials. At each anchor a small deterministic
parser expands to both sides and validates: e-mail around an at-sign, phone after a plus, ip around a
dot, card from a digit, URL from a scheme, account or secret after a cue. A parser never looks at what
its kind has already read, so the time is linear in the text, however long a run of digits or of
local-part characters is. Spans are in code points, the end exclusive; within a kind they don't overlap,
and the leftmost wins.

The kinds of the contract (email, ip, card, phone) equal leftmost non-overlapping matches of their
patterns, less those that fail validation. The method adds: url; secret (a value after `token =`,
`password:`, `apiKey=`, `Bearer` and the like, keys of public services by their prefixes, and heads of
private keys); and account (digits after `account`, `acct`, `iban`). Cues are found in any case. Added
spans that a base span covers are kept as well.

Defined results: null and empty texts have no spans; repeated rows repeat; a null id is kept as it is.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_arrow, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "secret", "account")
Span = tuple[str, int, int]

#: Cues in lower case, by the parser that they call.
CUES = {
    "secret": ("token", "password", "passwd", "secret", "api_key", "apikey", "api-key", "access_key", "accesskey", "private_key"),
    "account": ("account", "acct", "iban", "konto", "cuenta", "compte"),
    "url": ("http://", "https://", "ftp://"),
}
#: How credentials of public formats begin, in lower case, and what they look like as a whole.
CREDENTIALS = {
    "akia": r"AKIA[0-9A-Z]{16}",
    "asia": r"ASIA[0-9A-Z]{16}",
    "ghp_": r"ghp_[A-Za-z0-9]{36,}",
    "gho_": r"gho_[A-Za-z0-9]{36,}",
    "xoxb-": r"xoxb-[A-Za-z0-9-]{10,}",
    "xoxp-": r"xoxp-[A-Za-z0-9-]{10,}",
    "sk_live_": r"sk_live_[A-Za-z0-9]{16,}",
    "eyj": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
    "bearer ": r"[Bb]earer +([A-Za-z0-9._~+/=-]{16,})",
    "-----begin ": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
PARTS = re.compile(r"\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
URL = re.compile(r"[^\s<>\"'`]+")
VALUE = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_+/.=-]{8,})")
NUMBER = re.compile(r"(?:[ \t]*(?:no|nr|number|#))?[.:# \t=]*([A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}|[0-9][0-9 -]{4,32}[0-9])")
WHOLE = {k: re.compile(v) for k, v in CREDENTIALS.items()}
DIGITS = re.compile(r"[^0-9]+")


def _automaton() -> ahocorasick.Automaton:
    words = {"@": "email", "+": "phone"} | {c: "card" for c in DIGIT} | {f".{c}": "ip" for c in DIGIT}
    words |= {c: kind for kind, cues in CUES.items() for c in cues} | dict.fromkeys(CREDENTIALS, "credential")
    a = ahocorasick.Automaton()
    for word, kind in words.items():
        a.add_word(word, ("secret" if kind == "credential" else kind, kind, word, len(word) - 1))
    a.make_automaton()
    return a


ANCHORS = _automaton()


def lowered(text: str) -> str:
    """The text in lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    """Around the at-sign at `at`; nothing before `free` may be used."""
    start = at
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    if start == at or not (m := DOMAIN.match(text, at + 1)):
        return None
    return start, m.end()


def _ip(text: str, dot: int, free: int) -> tuple[int, int, bool] | None:
    """Around the dot at `dot`: the four runs of digits, and if none is above 255."""
    start = dot
    while start > free and text[start - 1] in DIGIT:
        start -= 1
    if start == dot or not (m := PARTS.match(text, dot)):
        return None
    parts = [p.lstrip("0") for p in (text[start:dot], *m.groups())]
    return start, m.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _phone(text: str, at: int) -> tuple[int, int, bool] | None:
    """From the plus at `at`: the match, and if it has 8 to 15 digits."""
    if not (m := PHONE.match(text, at)):
        return None
    return at, m.end(), 8 <= len(DIGITS.sub("", m.group())) <= 15


def _card(text: str, at: int) -> tuple[int, int, bool]:
    """From the digit at `at`: all digits that follow, at most one blank or hyphen apart, and if they are a card's."""
    if not (m := CARD.match(text, at)):
        return at, at + 1, False
    long_enough = 16 <= m.end() - at <= 2 * 19 - 1
    return at, m.end(), long_enough and 16 <= len(d := DIGITS.sub("", m.group())) <= 19 and luhn(d)


def _url(text: str, at: int, end: int) -> tuple[int, int] | None:
    m = URL.match(text, end)
    stop = end + len(m.group().rstrip(".,;:!?)]}")) if m else end
    return (at, stop) if stop > end else None


def spans(text: str) -> list[Span]:
    """All spans, by kind as listed in KINDS, then by start."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    # per kind, up to where the text is spent
    free = dict.fromkeys(KINDS, 0)
    for last, (kind, anchor, word, back) in ANCHORS.iter(lowered(text)):
        at = last - back
        if at < free[kind]:
            continue
        end, found, valid = last + 1, None, True
        if kind == "email":
            if found := _email(text, at, free[kind]):
                free[kind] = found[1]
        elif kind in ("ip", "phone", "card"):
            if read := _ip(text, at, free[kind]) if kind == "ip" else _phone(text, at) if kind == "phone" else _card(text, at):
                *found, valid = read
                free[kind] = found[1]
        elif kind == "url":
            found = _url(text, at, end)
        elif m := WHOLE[word].match(text, at) if anchor == "credential" else (VALUE if kind == "secret" else NUMBER).match(text, end):
            found = m.span(m.lastindex or 0)
        if found:
            free[kind] = max(free[kind], found[1])
            if valid:
                out[kind].append((kind, *found))
    return [s for k in KINDS for s in out[k]]


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, array<struct<kind, start, end>>, for each document."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t or "")] for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(kind))], names=["doc_id", "spans"])

    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(texts, run, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def redact(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, then longest."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each document, and n_found: all spans but URLs."""
    found = find(docs, id_col, text_col)
    write = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    personal = F.size(F.filter("spans", lambda s: s["kind"] != "url")).cast("long").alias("n_found")
    return found.select("doc_id", *counts, F.sha2(write(base), 256).alias("base_sha256"), write(F.col("spans")).alias("spans"), personal)
