"""Substring deduplication by content-defined chunking.

A text is read as its words, one blank apart. A gear hash rolls over its bytes; a chunk ends after a word
whose hash is the highest among those of the RADIUS words on either side. Ends so depend on the last REACH
bytes and on a few words around, and fall into place again soon after an insertion; a text of one
repeated word is cut alike everywhere. Chunks with the same 128-bit digest are copies; n_chunks and
n_copied count them.

Copied chunks say where passages may be: in runs of them, with the words around that can belong to the
same stretch. There, and only there, passages are found exactly, up to 128-bit hashes: a word is in a repeated passage if a gram
of WORDS words around it occurs elsewhere, wherever chunks end. Every repeated gram holds a whole chunk
unless hardly any word in it is an end: 50 words make seven chunks on average, and a test finds one in
each of 3,000 random grams. The first gram, by (doc_id, text, position), stays; later ones are removed, so
that of a stretch that repeats with a period below its length one period stays.

Copies of a whole text, word for word, are passages as a whole; only the first is looked into for more.
Digests and grams are counted with map-side combining, and no pairs of occurrences are made. Words are
what white space separates, so scripts without blanks have few.

Defined results: null and empty texts have no chunks and no spans; rows that repeat id and text are one
document and give a row each, alike; rows that share an id but not a text are documents of their own;
those with a null id come last; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import NO_ID, cut, keyed, map_arrow, small_batches

#: The least length of a repeated passage, in words.
WORDS = 50
REACH, RADIUS = 16, 3
#: Bytes that are hashed at once, unless one text has more.
BLOCK = 1_000_000
#: Random weights of bytes; 255, which no UTF-8 text has, separates texts and weighs nothing.
GEAR = np.append(np.random.default_rng(2024).integers(0, 2**32, 255, dtype=np.uint32), np.uint32(0))
GAP = b"\xff" * REACH
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
BLANKS = " \t\n\x0b\x0c\r"
WHITE = np.isin(np.arange(256), list(BLANKS.encode()))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of GEAR[byte k back] << k over REACH bytes, by doubling."""
    h = GEAR[data]
    step = 1
    while step < REACH:
        h[step:] += h[:-step].copy() << np.uint32(step)
        step *= 2
    return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of some texts: `text` (the number of each word's text), `first` and `count` (of each
    text's words), and hashes of all stretches of them."""

    def __init__(self, texts: list[bytes]):
        parts = [t.split() for t in texts]  # of bytes: at ASCII white space alone
        self.texts, flat = texts, list(chain.from_iterable(parts))
        self.count = np.fromiter(map(len, parts), np.int64, len(parts))
        self.first = np.cumsum(self.count) - self.count
        self.text = np.repeat(np.arange(len(parts)), self.count)
        n = len(flat)
        self.width = np.fromiter(map(len, flat), np.int64, n)
        self.ends = np.cumsum(self.width + 1)  # in bytes, as if there were but one text
        symbols = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, n)
        self.sums, self.back = [], []
        for base in BASES:
            up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (base, pow(base, -1, 2**64)))
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(_mixed(symbols + np.uint64(base)) * up[:-1])]))
            self.back.append(down)
        joined = [b" ".join(p) for p in parts]
        self.data = np.frombuffer(GAP.join(joined), np.uint8)
        self.base = np.cumsum([0, *(len(j) + REACH for j in joined[:-1])])

    def stretch(self, k: int, at: np.ndarray, length) -> np.ndarray:
        """Half k of the hash of `length` words from `at` on."""
        return _mixed((self.sums[k][at + length] - self.sums[k][at]) * self.back[k][at] + np.asarray(length, np.uint64)).view(np.int64)

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of each chunk, in order."""
        n = len(self.text)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = np.append(0, self.ends)[self.first[self.text]]
        h = gear_hashes(self.data)[self.base[self.text] + self.ends - before - 2]
        last = np.ones(n, bool)
        for d in range(1, RADIUS + 1):
            same = self.text[d:] == self.text[:-d]
            last[:-d] &= ~same | (h[:-d] >= h[d:])
            last[d:] &= ~same | (h[d:] >= h[:-d])
        last |= np.append(self.text[1:] != self.text[:-1], True)
        stop = np.flatnonzero(last) + 1
        start = np.append(0, stop[:-1])
        return start, stop - start

    def places(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word of text t, in code points of the text as it is."""
        data = np.frombuffer(self.texts[t] + b" ", np.uint8)
        point = np.cumsum((data & 0xC0) != 0x80) - 1
        white = WHITE[data]
        edge = np.flatnonzero(np.diff(white, prepend=True))
        return point[edge[::2]], point[edge[1::2]]


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, Words]]:
    """(number of the first text, Words) for texts in turn."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= BLOCK):
            n += len(texts[j])
            j += 1
        yield i, Words(texts[i:j])
        i = j


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """key, h (the row's, as common.keyed has them) and chunks(at, words, high, low) of each row; of texts with
    WORDS words or more also their digest (t_high, t_low), and lo and hi, where their words begin and end."""
    one = pa.struct([("at", pa.int32()), ("words", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sizes, columns, whole = [], [], []
        texts = b.column("text").to_pylist()
        for _, x in _blocks([t.encode() for t in texts]):
            start, n = x.chunks()
            text = x.text[start]
            sizes.append(np.bincount(text, minlength=len(x.texts)))
            whole.append((x.stretch(0, x.first, x.count), x.stretch(1, x.first, x.count), x.count < words))
            columns.append(((start - x.first[text]).astype(np.int32), n.astype(np.int32), x.stretch(0, start, n), x.stretch(1, start, n)))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32())
        rows = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], fields=list(one))
        high, low, few = (np.concatenate(c) for c in zip(*whole, strict=True))
        lo, hi = [len(t) - len(t.lstrip(BLANKS)) for t in texts], [len(t.rstrip(BLANKS)) for t in texts]
        digest = [pa.array(c, pa.int64(), mask=few) for c in (high, low)]
        names = ["key", "h", "t_high", "t_low", "lo", "hi", "chunks"]
        return pa.RecordBatch.from_arrays([b.column("key"), b.column("h"), *digest, pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.ListArray.from_arrays(offsets, rows)], names=names)

    small_batches(docs.sparkSession)
    schema = "key long, h long, t_high long, t_low long, lo long, hi long, chunks array<struct<at: int, words: int, high: long, low: long>>"
    return map_arrow(keyed(docs, id_col, text_col), run, schema)


def _regions(x: Words, t: int, copied: np.ndarray, start: np.ndarray, count: np.ndarray, words: int) -> np.ndarray:
    """Of text t, where grams begin that may be repeated; start, count: its chunks; copied: where copied ones begin.

    A repeated stretch reaches past its copied chunks by at most the chunks that it cuts, and there by
    the words that may decide about ends: RADIUS on the right, and on the left those and REACH bytes.
    """
    first, last = x.first[t], x.first[t] + x.count[t]
    is_copy = np.isin(start - first, copied)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_copy, [False]])))
    opens = np.zeros(x.count[t] + 1, np.int64)
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        lo = max(start[max(a - 1, 0)] - RADIUS, first)
        lo = max(int(np.searchsorted(x.ends, x.ends[lo] - x.width[lo] - REACH - 1)), first)
        b = min(b, len(start) - 1)
        hi = min(start[b] + count[b] + RADIUS, last)
        if hi - lo >= words:
            opens[lo - first] += 1
            opens[hi - first] -= 1
    full = np.cumsum(np.append(0, np.cumsum(opens[:-1]) > 0))
    return np.flatnonzero(full[words:] - full[:-words] == words) + first if len(full) > words else np.zeros(0, np.int64)


GRAMS = "g_high long, g_low long, ord long, start int, stop int, again boolean"


def grams(docs: DataFrame, words: int) -> DataFrame:
    """GRAMS of docs(ord, text, copied): the grams that may be repeated, with their spans; again: the text had it before."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, copied, parts = b.column("ord").to_numpy(zero_copy_only=False), b.column("copied").to_pylist(), []
        for i, x in _blocks([t.encode() for t in b.column("text").to_pylist()]):
            start, n = x.chunks()
            text = x.text[start]
            for t in range(len(x.texts)):
                mine = slice(*np.searchsorted(text, [t, t + 1]))
                at = _regions(x, t, np.array(copied[i + t]), start[mine], n[mine], words)
                if not len(at):
                    continue
                begin, end = x.places(t)
                high, low = x.stretch(0, at, words), x.stretch(1, at, words)
                again = np.ones(len(at), bool)
                again[np.unique(np.stack([high, low]), axis=1, return_index=True)[1]] = False
                local = at - x.first[t]
                parts.append((high, low, np.full(len(at), ids[i + t]), begin[local].astype(np.int32), end[local + words - 1].astype(np.int32), again))
        if not parts:
            parts = [tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int32, np.int32, bool))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["g_high", "g_low", "ord", "start", "stop", "again"])

    return map_arrow(docs, run, GRAMS)


SPANS = "ord long, shared_spans string, shared_chars long, removed_spans string, removed_chars long"


def _merged(start: np.ndarray, stop: np.ndarray) -> tuple[str, int]:
    """Spans in order, those that touch or overlap made one, as text; and their length."""
    if not len(start):
        return "", 0
    stop = np.maximum.accumulate(stop)
    opens = np.flatnonzero(np.append(True, start[1:] > stop[:-1]))
    a, b = start[opens], stop[np.append(opens[1:], len(stop)) - 1]
    return ",".join(f"{x}:{y}" for x, y in zip(a.tolist(), b.tolist(), strict=True)), int((b - a).sum())


def _spans(found: DataFrame) -> DataFrame:
    """SPANS of found(ord, start, stop, shared, later), one text after the other."""
    names = ["ord", "start", "stop", "shared", "later"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in names]
            edges = np.append(np.flatnonzero(np.diff(columns[0])) + 1, b.num_rows)
            at = 0
            for edge in edges.tolist():
                part = [c[at:edge] for c in columns]
                if held and len(part[0]) and held[0][0][0] != part[0][0]:
                    yield [np.concatenate(c) for c in zip(*held, strict=True)]
                    held = []
                if len(part[0]):
                    held.append(part)
                at = edge
        if held:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for ids, start, stop, shared, later in texts(batches):
            shared, later = shared.astype(bool), later.astype(bool)
            rows.append((int(ids[0]), *_merged(start[shared], stop[shared]), *_merged(start[later], stop[later])))
            if len(rows) == 256:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SPANS.split(", ")])

    return found.select(names).repartition("ord").sortWithinPartitions("ord", "start").mapInArrow(run, SPANS)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, n_chunks, n_copied (chunks that occur elsewhere too),
    shared_spans, shared_chars (passages that other documents have too), removed_spans, removed_chars
    (all but the first occurrence, anywhere). Spans are start:stop in code points, comma-joined; words is
    the least length of a passage."""
    every = cut(chunks(docs, id_col, text_col, words), "chunks")
    texts = keyed(docs, id_col, text_col)
    once = every
    if not every.groupBy("key", "h").count().filter("count > 1").isEmpty():  # rows that repeat are read once
        once = every.dropDuplicates(["key", "h"])
        texts = texts.groupBy("key", "h").agg(F.first("text").alias("text"))

    # copies of a whole text have all of its passages: only the first is looked into
    classes = every.filter("t_high is not null").groupBy("t_high", "t_low").agg(F.min(F.struct("key", "h")).alias("first"), F.min(F.xxhash64("key", "h")).alias("a"), F.max(F.xxhash64("key", "h")).alias("b"))
    classes = cut(classes.filter("a <> b").select("t_high", "t_low", "first"), "classes")
    copy = (F.col("key") != F.col("first.key")) | (F.col("h") != F.col("first.h"))
    in_class = cut(every.select("key", "h", "t_high", "t_low").join(classes, ["t_high", "t_low"]).select("key", "h", copy.alias("copy")).distinct(), "copies")
    once = once.join(in_class.filter("copy").select("key", "h"), ["key", "h"], "left_anti")

    each = once.select("key", "h", F.explode("chunks").alias("c")).select("key", "h", "c.*")
    place = each.select("high", "low", F.xxhash64("key", "h", "at").alias("place"))
    # written, so that the join's sides have exchanges of their own, and Spark can split a passage that many share
    seen = cut(place.groupBy("high", "low").agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a <> b").select("high", "low"), "seen")
    copied = each.join(seen, ["high", "low"], "left_semi").groupBy("key", "h").agg(F.collect_list("at").alias("copied"))
    # numbered in the order that says which occurrence is the first
    wanted = cut(cut(copied, "copied").orderBy("key", "h").withColumn("ord", F.monotonically_increasing_id()), "wanted")
    found = cut(grams(texts.join(wanted, ["key", "h"]).select("ord", "text", "copied"), words), "grams")
    twice = cut(found.groupBy("g_high", "g_low").agg(F.min("ord").alias("one"), F.max("ord").alias("last")).filter("one <> last").select("g_high", "g_low", "one"), "twice")
    shared = found.join(twice, ["g_high", "g_low"]).select("ord", "start", "stop", F.lit(True).alias("shared"), (F.col("again") | (F.col("ord") != F.col("one"))).alias("later"))
    alone = found.filter("again").select("ord", "start", "stop", F.lit(False).alias("shared"), F.lit(True).alias("later"))
    spans = wanted.select("key", "h", "ord", F.size("copied").cast("long").alias("n_copied")).join(_spans(shared.unionByName(alone)), "ord", "left")

    out = every.select("key", "h", "lo", "hi", F.size("chunks").cast("long").alias("n_chunks")).join(spans, ["key", "h"], "left").join(in_class, ["key", "h"], "left")
    whole, length = F.concat_ws(":", "lo", "hi"), F.col("hi") - F.col("lo")
    figures = {
        "n_copied": F.when(F.col("copy").isNotNull(), F.col("n_chunks")).otherwise(F.coalesce("n_copied", F.lit(0))),
        "shared_spans": F.when(F.col("copy").isNotNull(), whole).otherwise(F.coalesce("shared_spans", F.lit(""))),
        "shared_chars": F.when(F.col("copy").isNotNull(), length).otherwise(F.coalesce("shared_chars", F.lit(0))),
        "removed_spans": F.when(F.col("copy"), whole).otherwise(F.coalesce("removed_spans", F.lit(""))),
        "removed_chars": F.when(F.col("copy"), length).otherwise(F.coalesce("removed_chars", F.lit(0))),
    }
    return out.select(F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "n_chunks", *(c.alias(k) for k, c in figures.items()))


def without(text: str, spans: str) -> str:
    """A text less the spans that repeated_passages() names."""
    at, out = 0, []
    for start, stop in (map(int, s.split(":")) for s in spans.split(",") if s):
        out.append(text[at:start])
        at = stop
    return "".join([*out, text[at:]])
