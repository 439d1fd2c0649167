"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.llm import chat, chunk_dedup, exact_dedup, minhash, mixing, packing, pii, quality, toxicity, warc
from skein.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, names string, kept string, score double, bands string, copy int, id long, component string, pos int, __source string"
LONG = " ".join(f"word{i}" for i in range(60_000))


def rows():
    base = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, LONG, "en", None), (5, "one two three four five six seven", "fr", "b"), (5, "one two three four five six seven", "fr", "b"), (5, "another text with the same id", "fr", "b"), (6, "one  two three\tfour five six seven", None, "b"), (None, "no id at all here", "en", "a")]
    return [(i, t, lang, s, 7, 1, "x", "y", 0.5, "z", 3, 9, "c", 4, "s") for i, t, lang, s in base]


OPERATORS = {
    "chunk": chunk_dedup.repeated_passages,
    "mix": lambda d: mixing.mix(d).drop("weight"),
    "near": lambda d: minhash.near_duplicates(d, percent=85, width=3),
    "quality": quality.judged,
    "exact": exact_dedup.exact_groups,
    "pii": pii.summary,
    "pack": lambda d: packing.pack(d, tokenizer_file()),
    "toxic": lambda d: toxicity.score_documents(d, d.select("doc_id", F.lit(0).alias("toxic"))),
}
FILTERS = {
    "near": minhash.drop_near_duplicates,
    "exact": exact_dedup.drop_copies,
    "mix": mixing.sample,
    "toxic": lambda d: toxicity.drop_toxic(d, d.select("doc_id", F.lit(0).alias("toxic"))),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    out = OPERATORS[name](spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and "doc_id" in out.columns


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(spark, docs, name):
    out = FILTERS[name](docs)
    assert out.columns == docs.columns and 1 <= out.count() <= docs.count()
    assert FILTERS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact(docs):
    out = sorted((tuple(r)[:4] for r in exact_dedup.exact_groups(docs).collect()), key=str)
    one = [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 1, True)]
    assert out == one + [(5, 5, 1, True), (5, 5, 3, False), (5, 5, 3, True), (6, 5, 3, False), (None, None, 1, True)]
    assert sorted((str(r.doc_id) for r in exact_dedup.drop_copies(docs).collect())) == ["1", "3", "4", "5", "5", "None"]


def test_exact_rows_that_repeat(spark):
    """Of rows that repeat id and text one stays, always the same; null ids go behind others."""
    rows = [(1, "a  b", 3), (1, "a b", 2), (1, "a b", 9), (2, "a b", 1), (None, "a b", 0), (None, "c", 5), (None, "c ", 4), (None, "c", 6)]
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id long, text string, n long")
        out = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_groups(d).collect())
        one = ("1", "1", 5)
        assert out == [(*one, False), (*one, False), (*one, True), ("2", "1", 5, False), ("None", "1", 5, False), ("None", "None", 1, True), ("None", "None", 2, False), ("None", "None", 2, True)]
        assert sorted((r.n for r in exact_dedup.drop_copies(d).collect())) == [3, 4, 5]


def test_exact_is_free_of_collisions(spark, docs):
    short = docs.withColumn("text", F.substring("text", 1, 60))
    weak = exact_dedup.exact_groups(short, block_bytes=16, code_bits=2)
    assert sorted(map(str, weak.collect())) == sorted(map(str, exact_dedup.exact_groups(short).collect()))
    alike = [(i, "ab" * (i % 7) + "cd" * (i % 3) + "ab" * (i % 5)) for i in range(100)]  # of few blocks, in many orders
    groups = {}
    for i, t in alike:
        groups.setdefault(t, []).append(i)
    out = exact_dedup.exact_groups(spark.createDataFrame(alike, "doc_id long, text string"), block_bytes=4, code_bits=1).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out} == {(i, g[0], len(g)) for g in groups.values() for i in g}


def test_near(docs):
    out = sorted((tuple(r) for r in minhash.near_duplicates(docs, percent=85, width=3).collect()), key=str)
    assert out == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 59_998, 4, True), (5, 4, 5, True), (5, 5, 5, True), (6, 5, 5, False), (None, 3, None, True)]


def test_near_with_shared_ids(spark):
    x, y, z = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "a b c d e f g h i j k l m n o")
    rows = [(3, x), (5, x), (5, y), (7, y), (9, z), (9, z), (None, z), (None, y.upper()), (None, "alone but for its own copy here"), (None, "Alone but for its own copy here")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(d, percent=85, width=3).collect()}
    assert out == {(3, 5): (3, True), (5, 5): (3, False), (5, 4): (3, False), (7, 4): (3, False), (9, 13): (9, True), (None, 13): (9, False), (None, 4): (3, False), (None, 5): (None, True)}
    kept = sorted(((r.doc_id, r.text) for r in minhash.drop_near_duplicates(d).collect()), key=str)
    assert [(i, t.lower()) for i, t in kept] == sorted([(3, x), (5, y), (9, z), (None, "alone but for its own copy here")], key=str)
    again = minhash.drop_near_duplicates(spark.createDataFrame(kept, "doc_id long, text string"))
    assert sorted((tuple(r) for r in again.collect()), key=str) == kept


def test_quality(docs):
    out = {(r.doc_id, r.n_words): r for r in quality.judged(docs).collect()}
    assert len(out) == 7 + 1 and not out[(1, 0)].kept and out[(1, 0)].base_failed and out[(4, 60_000)].kept
    assert out[(None, 5)].base_failed


def test_pii(docs):
    out = pii.summary(docs).collect()
    assert len(out) == 9 and all(r.spans == "" and r.n_email == 0 for r in out)


def test_packing(docs):
    out = packing.pack(docs, tokenizer_file()).toPandas()
    assert out.groupby("doc_id", dropna=False).size()[1.0] == 1 and out.length.max() <= 2048
    total = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length.agg(["sum", "count"])
    assert total["sum"].max() <= 2048 and len(out[out.doc_id == 2]) == 1


def test_packing_keeps_ids(docs):
    import zlib

    out = packing.pack(docs, tokenizer_file(), keep_ids=True).toPandas()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in out.itertuples())


def test_chunks(docs):
    out = chunk_dedup.repeated_passages(docs).collect()
    assert sorted(map(str, (r.doc_id for r in out))) == ["1", "2", "3", "4", "5", "5", "5", "6", "None"]
    assert all(r.shared_spans == "" == r.removed_spans and (r.n_chunks > 0) == (r.doc_id not in (1, 2, 3)) for r in out)


def test_mixing_without_tokens(spark):
    d = spark.createDataFrame([(1, None, "a", "b"), (2, "", "a", "b")], "doc_id long, text string, lang string, source string")
    assert [r.kept for r in mixing.mix(d).collect()] == [True, True]


def test_toxicity_without_both_labels(docs):
    assert {r.score for r in toxicity.score_documents(docs, docs.select("doc_id", F.lit(1).alias("toxic"))).collect()} == {0.0}


def test_chat(spark):
    c = spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", ""), (None, 0, "user", "x"), (2, None, "assistant", "y"), (3, 0, "assistant", "z"), (3, 0, "assistant", "z")], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.digests(chat.format_log(chat.event_log(c))).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {None: 1, 1: 2, 2: 1, 3: 2} and out[3].loss_chars == 2
    assert chat.digests(chat.format_log(chat.event_log(c.limit(0)))).count() == 0


def test_chat_events(spark):
    log = [(1, 0, 0, 0, "start", "assistant", None), (1, 0, 0, 1, None, None, "x"), (1, 0, 0, 2, "delta", None, "ab"), (1, 0, 0, 3, "shout", "user", "y"), (1, 0, 0, 4, "delta", None, None), (1, 0, 0, 5, "delta", None, "c"),
           (1, 1, 0, 0, None, None, None), (2, 0, 0, 2, "delta", None, "new"), (2, 0, 0, 1, "regenerate", None, None), (2, 0, 0, 0, "delta", None, "old")]
    df = spark.createDataFrame(log, chat.LOG).withColumn("rendered", F.lit(1)).withColumn("loss_start", F.lit("z"))
    out = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.messages(df).collect())
    assert out == [(1, 0, "assistant", "abc"), (1, 1, "", ""), (2, 0, "", "new")]
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.format_log(df)).collect()} == {1: (2, 3), 2: (1, 0)}


def test_chat_with_long_texts_and_other_columns(spark):
    said = "ab<|\\ü\n😀" * 60_000
    c = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", said, 7, "c") for k in range(4)], "conv_id long, turn long, role string, text string, copy int, event string")
    r = chat.digests(chat.format_log(chat.event_log(c))).first()
    import hashlib

    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (4, 2 * len(said), hashlib.sha256((said * 2).encode()).hexdigest())


def test_warc(spark):
    schema = "record_id long, url string, ts long, type string, etag string, last_modified string, headers map<string,string>, payload string"
    full = lambda i, t, tag, body, url="http://a.com/x": (i, url, t, "response", tag, None, {"etag": tag or "-", "content-type": "t"}, body)
    again = lambda i, t, tag, url="https://www.a.com/x/?utm_source=q#f": (i, url, t, "revisit", tag, None, {"date": "now", "content-type": "no"}, None)
    r = [full(1, 10, "A", "one"), full(2, 90_000, "B", "two"), again(3, 20, "A"), again(4, 95_000, "B"), again(5, 95_001, "A"), again(6, 5, "A"), again(7, 95_002, None), full(8, 10, "C", "three", None), again(9, 11, "C", None), again(10, 90_000, "B"), (11, "http://a.com/x", 200_000, "revisit", "B", None, None, None)]
    out = {x.record_id: x for x in warc.resolve(spark.createDataFrame(r, schema)).collect()}
    assert [(out[i].status, out[i].source_id, out[i].payload) for i in range(1, 12)] == [
        ("full", 1, "one"), ("full", 2, "two"), ("resolved", 1, "one"), ("resolved", 2, "two"), ("mismatch", None, None), ("orphan", None, None), ("unchecked", 2, "two"), ("full", 8, "three"), ("resolved", 8, "three"), ("resolved", 2, "two"), ("resolved", 2, "two"),
    ]
    assert out[3].headers == {"etag": "A", "content-type": "t", "date": "now"} and out[11].headers == {"etag": "B", "content-type": "t"}
    assert warc.resolve(spark.createDataFrame([], schema)).count() == 0


WARC = "record_id long, url string, ts long, type string, etag string, last_modified string, headers map<string,string>, payload string, canonical string, h long, slice int, seen string"


def by_hand(records):
    """(record_id, status, source payload) for each record: the latest earlier response, found by looking at all."""
    order = lambda r: (-(1 << 62) if r[2] is None else r[2], r[0])
    out = []
    for r in records:
        if r[3] == "response":
            out.append((r[0], "full", r[7]))
            continue
        earlier = [f for f in records if f[3] == "response" and f[1] == r[1] and order(f) < order(r)]
        if not earlier:
            out.append((r[0], "orphan", None))
            continue
        f = max(earlier, key=order)
        agrees = r[4] == f[4] if r[4] and f[4] else r[5] == f[5] if r[5] and f[5] else None
        out.append((r[0], {None: "unchecked", True: "resolved", False: "mismatch"}[agrees], f[7] if agrees is not False else None))
    return sorted(out, key=str)


def test_warc_in_a_hot_url(spark):
    """One URL has most captures, many without a time or at the same; long payloads, clashing columns, repeated rows."""
    import random

    rng, rows = random.Random(3), []
    for i in range(400):
        url, kind = rng.choice(["a.com/x"] * 5 + ["b.com", None]), rng.choice(["response", "revisit", "revisit"])
        tag, date = rng.choice(["A", "B", None]), rng.choice(["d", "e", None])
        rows.append((i, url, rng.choice([None, 5, rng.randint(0, 30)]), kind, tag, date, None if i % 7 == 0 else {"etag": str(tag), "x": str(i)}, f"p{i}" * (100_000 if i == 17 else 1) if kind == "response" else None, "c", 1, 2, "s"))
    rows += [rows[k] for k in (2, 3, 4, 5)]
    for parts in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            out = warc.resolve(spark.createDataFrame(rows, WARC)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(((r.record_id, r.status, r.payload) for r in out), key=str) == by_hand(rows)


def test_warc_with_ids_that_repeat(spark):
    revisit = lambda tag: (2, "a.com", 9, "revisit", tag, None, {"date": tag}, None, "c", 1, 2, "s")
    full = lambda body, ts: (1, "a.com", ts, "response", "A", None, {"b": body}, body, "c", 1, 2, "s")
    rows = [full("one", 1), full("two", 2), full("two", 2), revisit("A"), revisit("B"), revisit("A")]
    out = warc.resolve(spark.createDataFrame(rows, WARC)).collect()
    assert sorted((r.status, str(r.payload)) for r in out) == [("full", "one"), ("full", "two"), ("full", "two"), ("mismatch", "None"), ("resolved", "two"), ("resolved", "two")]
    assert all(r.headers["b"] == r.payload for r in out if r.status == "resolved")
