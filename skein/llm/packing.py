"""Packing documents into sequences: shortest-pack-first over the histogram of piece lengths.

Documents are tokenised, closed with an end id and cut into pieces of at most `capacity` ids. Only
the histogram of lengths (at most `capacity` counts) goes to the driver, where lengths are placed
longest first, each into the open pattern with the most room left (the shortest pack), splitting a
pattern where fewer pieces than its count remain. A pattern is a list of lengths with a count. Each
slot of a pattern takes a run of ranks of its length, so a piece finds its sequence from (length,
rank) alone. Ranks are dealt out in salted buckets: a length that a third of all pieces have is
numbered by as many tasks as there are buckets, and bucket offsets come from the counts.

Defined results: null and empty texts are one piece with the end id alone; an empty table gives an
empty table; repeated rows are packed once each; a null id is kept as it is.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut, map_arrow, plain, small_batches

CAPACITY = 2048
END_ID = 1
#: Words whose ids a worker remembers; beyond it, it starts afresh.
MEMO_WORDS = 1_200_000
#: The full stop and the comma.
STOPS = frozenset(b".,")


#: Words of the lower letters a-z, ß-ö and ø-ÿ, in UTF-8: each is its own normal form.
LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Byte-level vocabularies write the bytes that don't print as the characters from U+0100 on, in order.
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


def word_tokenizer(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to ids (little-endian unsigned 32-bit), for word_bpe_49k.json.

    It gives a text the ids of its words one after the other: white space is dropped and parts pieces,
    letters are lowered. So each distinct word is encoded once by the library and remembered. Lower
    Latin letters alone need neither normalising nor parting, so such a word goes straight to the
    library's model, its bytes in the file's byte alphabet. Other words are sent in joined texts,
    parted by a bar; the id of a bar that stands alone comes of nothing but a bar, so it shows where
    words end. Words with a bar, which special tokens also have, go alone.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    (bar,) = tok.encode("|", add_special_tokens=False).ids
    memo: dict[bytes, bytes] = {}
    model = tok.model
    pack_ids = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    stop = {c: pack_ids(tok.encode(chr(c), add_special_tokens=False).ids) for c in STOPS}

    def learn(words: set[bytes]) -> None:
        todo = set()
        for w in words:
            # a stop after a letter or digit is a piece of its own
            if w[-1] in STOPS and w[-2:-1].isalnum():
                if w[:-1] not in memo:
                    todo.add(w[:-1])
            else:
                todo.add(w)
        joined, alone = [], []
        for w in todo:
            if w.isalpha():
                memo[w] = pack_ids([t.id for t in model.tokenize(w.decode())])
            elif LATIN.fullmatch(w):
                memo[w] = pack_ids([t.id for t in model.tokenize(w.decode("latin-1").translate(BYTE_LETTERS))])
            else:
                (alone if b"|" in w else joined).append(w)
        for i in range(0, len(joined), 512):
            part = joined[i : i + 512]
            ids = np.array(tok.encode_batch_fast([b" | ".join([*part, b""]).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends, raw, at = np.flatnonzero(ids == bar) * 4, ids.tobytes(), 0
            assert len(ends) == len(part)
            for w, end in zip(part, ends.tolist(), strict=True):
                memo[w] = raw[at:end]
                at = end + 4
        for w in alone:
            memo[w] = pack_ids(tok.encode(w.decode(), add_special_tokens=False).ids)
        for w in words - todo:
            memo[w] = memo[w[:-1]] + stop[w[-1]]

    def encode(texts: list[str]) -> list[bytes]:
        if len(memo) > MEMO_WORDS:
            memo.clear()
        split = [t.encode().split() if "|>" in t else t.encode().lower().split() for t in texts]
        if fresh := set().union(*split).difference(memo):
            learn(fresh)
        return [b"".join([memo[w] for w in ws]) for ws in split]

    return encode


_encoders: dict[str, Callable] = {}


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, little-endian unsigned 32-bit)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = word_tokenizer(tokenizer)
        rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else []))}
        texts, names = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
        for doc, raw in zip(names, _encoders[tokenizer](texts), strict=True):
            raw += end_id.to_bytes(4, "little")
            for at in range(0, len(raw), 4 * capacity):
                part = raw[at : at + 4 * capacity]
                for k, v in (("doc_id", doc), ("start", at // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part)), ("doc_tokens", len(raw) // 4)):
                    rows[k].append(v)
                if keep_ids:
                    rows["ids"].append(part)
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()})

    small_batches(docs.sparkSession)
    return map_arrow(plain(docs, id_col, text_col), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns as (count, lengths in order of placing); each length occurs as often as it should."""
    open_: dict[int, list[tuple[int, list[int]]]] = {}  # by room left
    rooms: list[int] = []  # the same rooms, as a heap of the most room
    done: list[tuple[int, list[int]]] = []

    def put(room: int, count: int, lengths: list[int]) -> None:
        if room == 0:
            done.append((count, lengths))
            return
        if room not in open_:
            heapq.heappush(rooms, -room)
            open_[room] = []
        open_[room].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = -rooms[0] if rooms else 0
            if room < length:
                put(capacity - length, left, [length])
                break
            count, lengths = open_[room].pop()
            if not open_[room]:
                del open_[room]
                heapq.heappop(rooms)
            take = min(count, left)
            if take < count:
                put(room, count - take, lengths)
            put(room - length, take, [*lengths, length])
            left -= take
    return done + [x for room in sorted(open_) for x in open_[room]]


def _slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Runs of ranks: for each (length, first rank), the first sequence and the offset in it."""
    rows, used, sequence = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + count
            offset += n
        sequence += count
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T, strict=True))


#: The rank takes the low bits of a key whose high bits are the length.
RANK_BITS = 48


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Rows of pieces() with sequence_id and offset."""
    spark = docs.sparkSession
    cuts = cut(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids), "pieces")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cuts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = cut(salted.groupBy("length", "bucket").count(), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `capacity` rows
    slots = _slots(shortest_pack_first(histogram, capacity))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")
    ranked = salted.withColumn("n", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")))
    # there are as many counts as buckets for each length, so they grow with the cluster: merged, not broadcast
    ranked = ranked.join(counts.select("length", "bucket", before.alias("before")).hint("merge"), ["length", "bucket"])
    ranked = ranked.select(*cuts.columns, (F.col("n") - 1 + F.col("before")).alias("rank"))
    key = (slots["length"] << RANK_BITS) + slots["rank"]

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
        at = np.searchsorted(key, (length << RANK_BITS) + rank, "right") - 1
        t = pa.Table.from_batches([b]).drop_columns(["rank"])
        t = t.append_column("sequence_id", pa.array(slots["sequence"][at] + rank - slots["rank"][at])).append_column("offset", pa.array(slots["offset"][at]))
        return t.combine_chunks().to_batches()[0]

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cuts.schema.fields)
    return map_arrow(ranked, place, f"{fields}, sequence_id long, offset long")
