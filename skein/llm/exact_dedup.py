"""Exact deduplication by deterministic block naming, with DataFrame operations only.

A normalised text is cut into blocks of a fixed number of bytes. All distinct blocks are sorted and
named by integers in that order; then all distinct pairs of adjacent names are sorted and named, and so
on until a text has a single name. Two texts have the same (number of blocks, name) exactly if they are
equal.

Blocks are sorted by (64-bit code, content). Contents are gathered by (code, content) with map-side
combining, so that a block which a third of the corpus shares moves once for each map task. The content
of a block is only looked at again where its code has several contents: these are ranked among
themselves, and rows find their rank by content. All other rows find the name of a block by its code
alone, which is then the same thing, so texts move once. Pairs of names are sorted as they are. Names
follow from a sorted set alone, so that tasks that run again after the loss of an executor give the same,
and the names of texts are written at each level.

Defined results: null and missing text equal the empty text; a text of white space alone equals " ";
rows with a null id come after all others, and keep_id is null where a group has no other; rows that
repeat id and text all count in group_size, and one of them is kept; rows that share an id but not a text
are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import NO_ID, cut, keep_keyed, normalised, row_key

BLOCK_BYTES = 2048


def _code(content: Column, bits: int) -> Column:
    code = F.xxhash64(content)
    return code if bits >= 64 else F.pmod(code, F.lit(1 << bits))


def _blocks(text: Column, block_bytes: int) -> Column:
    raw = F.encode(text, "UTF-8")
    last = F.floor(F.greatest(F.octet_length(text) - 1, F.lit(0)) / F.lit(block_bytes)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))


def _normal(text_col: str) -> Column:
    return normalised(F.coalesce(F.col(text_col), F.lit("")))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """distinct rows, sorted by order and numbered. Read once, by the job that writes the texts' names."""
    return distinct.orderBy(*order).withColumn("name", F.monotonically_increasing_id())


def _gathered(placed: DataFrame) -> DataFrame:
    """key, sha, names from placed(key, sha, pos, name)."""
    packed = placed.groupBy("key", "sha").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("all"))
    return cut(packed.select("key", "sha", F.transform("all", lambda x: x["name"]).alias("names")), "texts")


def _block_names(text: DataFrame, coded: DataFrame, block_bytes: int, code_bits: int) -> DataFrame:
    """key, sha, names of the blocks of coded(key, sha, codes), the distinct rows of text(key, sha, text)."""
    blocks = text.select("key", "sha", F.posexplode(_blocks(F.col("text"), block_bytes)).alias("pos", "content")).withColumn("c", _code(F.col("content"), code_bits))
    contents = blocks.select("c", "content").distinct()
    codes = cut(contents.groupBy("c").agg(F.count("*").cast("int").alias("n")), "codes")
    placed = coded.select("key", "sha", F.posexplode("codes").alias("pos", "c"))
    shared = codes.filter("n > 1").select("c")
    if shared.isEmpty():
        placed = placed.withColumn("k", F.lit(0))
    else:
        rank = F.row_number().over(Window.partitionBy("c").orderBy("content")) - 1
        ranked = cut(contents.join(shared, "c", "left_semi").select("c", "content", rank.alias("k")), "ranks")
        found = blocks.join(ranked, ["c", "content"]).select("key", "sha", "pos", "k").distinct()
        placed = placed.join(found, ["key", "sha", "pos"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    names = _named(codes.select("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")), "c", "k")
    return _gathered(placed.join(names, ["c", "k"]).select("key", "sha", "pos", "name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, code_bits: int = 64) -> DataFrame:
    """One row for each (id, text): key (the id, NO_ID for null), sha (of the text), n_rows, n_blocks, name.

    code_bits below 64 makes codes collide on purpose, for tests; the result is the same partition.
    """
    text = docs.select(row_key(id_col).alias("key"), _normal(text_col).alias("text")).select("key", _sha(F.col("text")).alias("sha"), "text")
    codes = F.transform(_blocks(F.col("text"), block_bytes), lambda b: _code(b, code_bits))
    # codes follow from (key, sha), so those of any row of a repeated one will do
    coded = cut(text.select("key", "sha", codes.alias("codes")).groupBy("key", "sha").agg(F.count("*").alias("n_rows"), F.first("codes").alias("codes")), "coded")
    names = _block_names(text, coded, block_bytes, code_bits)
    widest = coded.agg(F.max(F.size("codes"))).first()[0] or 1
    done = names.filter(F.size("names") == 1)
    while widest > 1:
        widest = (widest + 1) // 2
        # a text leaves as soon as it has one name, so each level is at most half of the one below
        half = F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int"))
        pairs = F.transform(half, lambda i: F.struct(F.get("names", i * 2).alias("l"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("r")))
        parts = names.filter(F.size("names") > 1).select("key", "sha", F.posexplode(pairs).alias("pos", "pair")).select("key", "sha", "pos", "pair.l", "pair.r")
        above = _named(parts.select("l", "r").distinct(), "l", "r")
        names = _gathered(parts.join(above, ["l", "r"]).select("key", "sha", "pos", "name"))
        done = done.unionByName(names.filter(F.size("names") == 1))
    one = done.select("key", "sha", F.get("names", F.lit(0)).alias("name"))
    return coded.select("key", "sha", "n_rows", F.size("codes").alias("n_blocks")).join(one, ["key", "sha"])


def _groups(named: DataFrame) -> DataFrame:
    """n_blocks, name, first(key, n_rows), group_size, sha for each group of equal texts."""
    return named.groupBy("n_blocks", "name").agg(F.min(F.struct("key", "n_rows")).alias("first"), F.sum("n_rows").alias("group_size"), F.first("sha").alias("sha"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, code_bits: int = 64) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    named = cut(identities(docs, id_col, text_col, block_bytes, code_bits), "identities")
    # written first, so that the join reads both sides by exchanges of its own and Spark can split a large group
    groups = cut(_groups(named).select("n_blocks", "name", F.col("first.key").alias("keep"), "group_size"), "groups")
    out = named.join(groups, ["n_blocks", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    kept = (F.col("key") == F.col("keep")) & (F.col("copy") == 1)
    return out.select(real("key").alias("doc_id"), real("keep").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose normalised text a row of a smaller id has; columns as they are."""
    kept = _groups(identities(docs, id_col, text_col)).select("first.key", F.col("sha").alias("h"), "first.n_rows")
    return keep_keyed(docs, kept, id_col, _sha(_normal(text_col)))
