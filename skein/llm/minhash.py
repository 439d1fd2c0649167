"""Near-duplicate detection with b-bit MinHash.

Sets of word shingles that are equal fall into one class, which from there on stands for all its
documents. Each class has the minima of 500 hash functions: bands of them (50 of 10 rows at
similarity 0.85, 62 of 8 at 0.8) name the buckets in which candidates meet, and the low 2 bits of
each minimum, packed into 16 integers, estimate the similarity of a candidate pair by bit counts,
corrected for the quarter of unequal minima whose low bits agree by chance. What the estimate can't rule out is confirmed on the full sets.

At similarity 0.85 a pair misses all 50 bands with a probability of 2e-5 (0.9: 4e-10), and lies below
the cut of the estimate (five standard deviations) with one of 3e-7. Rows are many, since texts that
share no more than a common passage must not meet: at similarity 0.5 one pair in twenty does.

No bucket is expanded into all of its pairs. First each member is held against the smallest id of
its bucket, which costs one pair a member and unites groups of copies. Then only buckets that still
hold several components are looked at again, and there only pairs across components, where one side
is not of the component that most members have. These are compared in blocks, by estimate and then by
their full sets, where the rows are, which makes rows of links alone; blocks hold a bounded number of
members and of shingles on average. Comparing remains quadratic in those members of a bucket that are
near its component without a link; blocks spread it over tasks.

Defined results: null and empty texts, and texts of white space, have an empty set (n_shingles 0), are
linked with nothing and kept; rows that repeat id and text give one row; rows that share an id but not
a text give a row each and link whatever either links, so all of them have one component. Rows with a
null id take part: component_id is the smallest id there is, null where there is none, and then one
row is kept, by its digest. Ids lie below 2**62. The filter holds every (id, text) for a document of its own, so that a
text that occurs nowhere else stays, and keeps one row of each group, also of rows that repeat.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import NO_ID, cut, keep_keyed, keyed, map_arrow, row_hash, small_batches

HASHES, LOW_BITS = 500, 2
#: The most that a pair at the similarity sought may miss all bands.
MISS = 3e-5
#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 80
SHINGLE = 5


def layout(percent: int = PERCENT) -> tuple[int, int]:
    """Bands and rows: as many rows as MISS allows, since these keep unlike texts apart."""
    miss = lambda rows: (1 - (percent / 100) ** rows) ** (HASHES // rows)
    rows = max(r for r in range(1, 21) if r == 1 or miss(r) <= MISS)
    return HASHES // rows, rows


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


MULTIPLY, ADD, PLACE = _constants(HASHES, 11), _constants(HASHES, 12), _constants(64, 13)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the word shingles of a whole text."""
    words = text.encode().lower().split()  # on bytes: A-Z alone, and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < width:
        return _mixed((h * PLACE[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - width + 1
    s = np.zeros(n, np.uint64)
    for k in range(width):
        s += h[k : k + n] * PLACE[k]
    return np.unique(_mixed(s))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima for each (non-empty) set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint64)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(flat * MULTIPLY[k] + ADD[k], starts)
    return out


def _band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cells = low[:, : bands * rows].reshape(len(low), bands, rows)
    return _mixed((cells * PLACE[:rows]).sum(axis=2, dtype=np.uint64)).view(np.int64)


PER_LONG = 64 // LOW_BITS
LONGS = -(-HASHES // PER_LONG)


def _packed(low: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(low), LONGS * PER_LONG), np.uint64)
    bits[:, :HASHES] = (low ^ (low >> np.uint64(32))) & np.uint64(2**LOW_BITS - 1)
    shifts = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(LOW_BITS)
    return np.bitwise_or.reduce(bits.reshape(len(low), LONGS, PER_LONG) << shifts, axis=2).view(np.int64)


def unequal_limit(percent: int = PERCENT, sigmas: float = 5) -> int:
    """The most minima whose low bits may differ in a pair at the similarity sought."""
    p = (1 - percent / 100) * (1 - 0.5**LOW_BITS)
    return int(np.ceil(HASHES * p + sigmas * np.sqrt(HASHES * p * (1 - p))))


def unequal(a: Column, b: Column) -> Column:
    """How many minima differ in their low bits: native bit counts over packed signatures."""
    total = F.lit(0)
    for i in range(LONGS):
        x = a[i].bitwiseXOR(b[i])
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def estimate(a: Column, b: Column) -> Column:
    """Similarity estimated from signatures, corrected for chance agreement of low bits."""
    return _corrected(unequal(a, b))


def _corrected(differing):
    chance = 0.5**LOW_BITS
    return ((1 - differing / float(HASHES)) - chance) / (1 - chance)


def least_estimate(percent: int = PERCENT) -> float:
    """Pairs estimated below it are ruled out."""
    return _corrected(unequal_limit(percent) + 0.5)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """key, h (the row's, as common.keyed has them), n_shingles, digest of the set (null if empty), bands, sig."""
    bands_rows = layout(percent)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
        full = [i for i, s in enumerate(sets) if len(s)]
        digest: list = [None] * len(sets)
        bands, sig = list(digest), list(digest)
        if full:
            low = minima([sets[i] for i in full])
            for i, x, y in zip(full, _band_keys(low, *bands_rows), _packed(low), strict=True):
                digest[i], bands[i], sig[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), x, y
        return pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("h"), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64()))],
            names=["key", "h", "n_shingles", "digest", "bands", "sig"],
        )

    small_batches(docs.sparkSession)
    return map_arrow(keyed(docs, id_col, text_col), run, "key long, h long, n_shingles long, digest binary, bands array<long>, sig array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """id, items (the shingle set) of texts(id, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width).view(np.int64) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "items"])

    return map_arrow(texts, run, "id long, items array<long>")


def _similar(left: Column, right: Column, percent: int) -> Column:
    """The full sets are similar enough; the sizes alone rule most others out."""
    a, b = F.size(left).cast("long"), F.size(right).cast("long")
    both = F.size(F.array_intersect(left, right)).cast("long")
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (100 * both >= percent * (a + b - both))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those similar enough by their full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("right"))
    met = cut(pairs, "pairs").join(right, "b").join(left, "a")
    return cut(met.filter(_similar(F.col("left"), F.col("right"), percent)).select("a", "b"), "links")


#: Classes without any id are numbered from here on by their digests; ids lie below.
NAMELESS = 1 << 62
#: Leftover members are compared in blocks of about so many members or shingles at most on either side.
BLOCK, BLOCK_ITEMS = 200, 1_000_000


def _across(rest: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links between components of a bucket, of which one is not the one that most members have.

    Both sides are dealt into blocks, so that a bucket of any size is compared by many tasks, each
    with a block of either. A pair that meets in several bands is confirmed in the first.
    """

    def compare(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(ours) and len(theirs):
            sig, bands = (np.stack(theirs[k].to_numpy()) for k in ("sig", "bands"))
            sig = sig.view(np.uint64)
            ids, component, most = (theirs[k].to_numpy() for k in ("id", "component", "most"))
            sets = theirs["items"].to_numpy()
            for r in ours.itertuples(index=False):
                x = sig ^ r.sig.view(np.uint64)
                apart = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
                at = np.flatnonzero((apart <= limit) & (component != r.component) & ((component == most) | (ids > r.id)))
                at = at[(bands[at] == r.bands).argmax(axis=1) == r.band] if len(at) else at
                for i in at.tolist():
                    a, b = len(r.items), len(sets[i])
                    if 100 * min(a, b) >= percent * max(a, b):
                        both = len(np.intersect1d(r.items, sets[i], assume_unique=True))
                        if 100 * both >= percent * (a + b - both):
                            out.append((r.id, ids[i]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    keys = ["band", "bucket", "i", "j"]
    ours = rest.filter("component <> most").withColumn("i", block("fewer")).withColumn("j", each("blocks"))
    theirs = rest.withColumn("j", block("blocks")).withColumn("i", each("fewer"))
    columns = [*keys, "id", "component", "most", "bands", "sig", "items"]
    # toDF gives the second side columns of its own: cogroup takes those of a common origin for one
    pairs = ours.select(columns).groupBy(keys).cogroup(theirs.select(columns).toDF(*columns).groupBy(keys)).applyInPandas(compare, "a long, b long")
    return cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for each id in links(a, b).

    Labels spread along links and are then followed to the label of the label, so that distances
    halve in each round. Only counts of changes reach the driver.
    """
    arcs = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "arcs")
    labels = cut(arcs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = arcs.join(labels, arcs.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels.id == near.a).select("id", F.least("component", "near").alias("to"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("beyond"))
        fresh = cut(spread.join(jump, "to").select("id", F.least("to", "beyond").alias("component"), "old"), "labels")
        if fresh.filter("component <> old").isEmpty():
            return fresh.select("id", "component")
        labels = fresh.select("id", "component")


#: Members of one bucket are dealt over so many tasks where they meet what is known of the bucket.
SALTS = 8


def _told(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """members(id, band, bucket, ...) with the columns of buckets(band, bucket, ...), of which each task that
    has members of a bucket gets a copy, so that a large bucket isn't one task's."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    copies = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["band", "bucket", "salt"]).drop("salt")


def _united(signed: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, width: int, same: bool) -> DataFrame:
    """digest, id, component (the smallest id) for each class of equal sets in signed, the written
    signatures of docs. same: rows that share an id are linked, so the smallest id in a class can stand
    for it; else classes are numbered."""
    full = signed.filter("n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min(F.struct("key", "h")).alias("row"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nameless = F.pmod(F.xxhash64("digest"), F.lit(NAMELESS - 1)) + F.lit(NAMELESS)
    id_ = F.when(F.col("row.key") == NO_ID, nameless).otherwise(F.col("row.key")) if same else F.monotonically_increasing_id()
    stands = cut(classes.withColumn("id", id_), "stands")  # a written table, so numbers stay as they are
    members = stands.select("id", "n", F.posexplode("bands").alias("band", "bucket"))
    buckets = members.groupBy("band", "bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    met = cut(_told(members, buckets), "buckets")
    star = met.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    sig = stands.select("id", "sig")
    near = star.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").filter(estimate(F.col("sig_a"), F.col("sig_b")) >= least_estimate(percent))
    # texts move once, one of each class; at scale the classes are too many to send to every task, so none relies on that
    some = stands.join(met.select("id").distinct(), "id", "left_semi").select("id", "row.key", "row.h").hint("merge")
    texts = keyed(docs, id_col, text_col).join(some, ["key", "h"]).groupBy("key", "h").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    sets = cut(_sets(texts.select("id", "text"), width), "sets")
    links = _confirmed(near.select("a", "b").distinct(), sets, percent)
    if same:
        ids = full.filter(F.col("key") != NO_ID).groupBy("key").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least <> most").select("key")
        found = full.join(ids, "key", "left_semi").select("key", "digest").distinct().join(stands.select("digest", "id"), "digest").select("key", F.col("id").alias("b"))
        links = cut(links.union(found.join(found.groupBy("key").agg(F.min("b").alias("a")), "key").filter("a <> b").select("a", "b")), "links")
    united = components(links)

    # pairs that were not held against each other, in buckets that still hold several components
    placed = met.filter("size > 2").join(united, "id", "left").select("band", "bucket", "pivot", "id", "n", F.coalesce("component", "id").alias("component"))
    sizes = placed.filter("id <> pivot").groupBy("band", "bucket", "component").agg(F.count("*").alias("count"), F.sum("n").alias("items"))
    mixed = sizes.groupBy("band", "bucket").agg(F.max(F.struct("count", "component", "items")).alias("most"), F.sum("count").alias("size"), F.sum("items").alias("items"), F.count("*").alias("several")).filter("several > 1")
    dealt = lambda rows, items: F.greatest(F.ceil(rows / BLOCK), F.ceil(items / BLOCK_ITEMS))
    mixed = mixed.select("band", "bucket", F.col("most.component").alias("most"), dealt(F.col("size") - F.col("most.count"), F.col("items") - F.col("most.items")).alias("fewer"), dealt(F.col("size"), F.col("items")).alias("blocks"))
    rest = _told(placed.filter("id <> pivot"), mixed).join(stands.select("id", "bands", "sig"), "id").join(sets, "id").drop("pivot", "n")
    more = _across(cut(rest, "rest"), unequal_limit(percent), percent)
    if not more.isEmpty():
        united = components(links.union(more))
    return stands.select("id", "digest").join(united, "id", "left").select("digest", "id", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    signed = cut(signatures(docs, id_col, text_col, percent, width), "signatures")
    united = cut(_united(signed, docs, id_col, text_col, percent, width, True), "classes")
    rows = signed.select("key", "n_shingles", "digest").distinct().join(united, "digest", "left")
    nameless, component = F.col("key") == NO_ID, F.coalesce("component", "key")
    kept = F.when(nameless, F.col("component").isNull() | ((component >= NAMELESS) & (F.col("id") == component))).otherwise(F.col("key") == component)
    return rows.select(F.when(~nameless, F.col("key")).alias("doc_id"), "n_shingles", F.when(component < NAMELESS, component).alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near duplicates; columns as they are."""
    signed = cut(signatures(docs, id_col, text_col), "signatures")
    united = _united(signed, docs, id_col, text_col, PERCENT, SHINGLE, False)
    rows = signed.groupBy("key", "h", "digest").agg(F.count("*").alias("n_rows")).join(united.drop("id"), "digest", "left")
    firsts = rows.filter("component is not null").groupBy("component").agg(F.min(F.struct("key", "h", "n_rows")).alias("first")).select("first.*")
    kept = firsts.union(rows.filter("component is null").select("key", "h", F.lit(1).cast("long")))
    return keep_keyed(docs, kept, id_col, row_hash(F.col(text_col)))
