"""Quality rules with adaptive thresholds, with DataFrame operations only.

Base figures are counted for each text. Four ratios of them, in integer per mille, are summarised for each
language and source by a mergeable quantile sketch: a histogram whose buckets are exact below 128 and
1/128 of their value wide above. Sketches add up, so each is built once, where rows are, and those of a
language and of all rows are sums of them; unlike sampling sketches they give the same quantiles however
tasks run. They see only rows that pass the base rules, so that junk can't move the fences.

A group's fence for a ratio is its HIGH percentile and SPREAD times the distance from there to its
median (for lengths of words, also downwards from the LOW percentile). Fences of small groups are
uncertain: each is averaged with the one above it (source, language, all), which weighs as much as
PRIOR rows. No ratio has a fixed cutoff. A document is held against its group's fence by counts: it may
exceed what the fence expects in a text of its size by three standard deviations of a count that comes in
lumps of UNIT, and by three lumps, so that short texts are not judged by one line or sign.

Defined results: null and empty texts have zero figures and fail the base rules (fewer than ten
words); null languages and sources are groups of their own, one with the empty name; repeated rows are
judged alike; a null id is kept as it is; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import SPACE, cut

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LOW, HIGH, SPREAD, PRIOR = 10, 90, 2, 200
#: Buckets have so many leading bits of their values.
BITS = 7
#: The most groups whose fences are sent to every task (about 100 bytes each).
MAX_SENT = 50_000
#: For each ratio: what is counted, in what, and the lump in which it comes.
RATIOS = {"word_length": ("word_chars", "n_words", 2), "symbols": ("n_symbols", "word_chars", 1), "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 2 * WINDOW)}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words: of `windows`, the hashes of all windows in order, how many words stand in
    windows that occur twice or more. Each step is a column, so that none is computed for each element;
    texts without such windows skip them all."""
    unlike = F.size(F.array_distinct("windows")) == F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(~unlike, placed))
    at = lambda i: F.get("placed", i)["h"]
    twice = F.filter("placed", lambda x, i: (x["h"] == at(i - 1)) | (x["h"] == at(i + 1)))
    rows = rows.withColumn("places", F.array_sort(F.transform(twice, lambda x: x["i"])))
    # a window covers its words up to the next window's first
    cover = F.transform("places", lambda p, j: F.coalesce(F.least(F.lit(WINDOW), F.get("places", j + 1) - p), F.lit(WINDOW)))
    return rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, n_lines and the base figures of each text."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words = F.filter(F.split("t", SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, WHITE, "") != "")
    parts = text.select(
        "doc_id",
        *keep,
        F.length(F.translate("t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("words"),
    )
    starts = F.sequence(F.lit(0), F.size("words") - WINDOW)
    windows = F.when(F.size("words") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW)))))
    counted = parts.select(
        "doc_id",
        *keep,
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(windows, F.array().cast("array<bigint>")).alias("windows"),
    )
    return _with_repeats(counted).select("doc_id", *keep, "n_lines", *BASE)


def bucket(x: Column) -> Column:
    """The smallest value of the sketch's bucket that holds x (0 or more)."""
    shift = F.greatest(F.length(F.bin(x)) - BITS - 1, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ratio, value, n: the sketch of each ratio of rows(keys, figures) in each group."""
    ratio = lambda c, s: F.floor(1000 * F.col(c) / F.greatest(F.col(s), F.lit(1))).cast("long")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("ratio"), bucket(ratio(c, s)).alias("value")) for k, (c, s, _) in RATIOS.items())))
    return rows.select(*keys, each.alias("x")).select(*keys, "x.*").groupBy(*keys, "ratio", "value").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of wider groups, as sums."""
    return sketch.groupBy(*keys, "ratio", "value").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ratio, rows, low, high: the fences that each sketch gives by itself."""
    group = Window.partitionBy(*keys, "ratio")
    placed = sketch.withColumn("upto", F.sum("n").over(group.orderBy("value"))).withColumn("all", F.sum("n").over(group))
    least = lambda percent: F.min(F.when(F.col("upto") >= F.floor((percent * F.col("all") + 99) / 100), F.col("value")))
    found = placed.groupBy(*keys, "ratio").agg(F.max("all").alias("rows"), least(LOW).alias("a"), least(50).alias("m"), least(HIGH).alias("b"))
    high, low = F.col("b") + SPREAD * (F.col("b") - F.col("m")), F.greatest(F.col("a") - SPREAD * (F.col("m") - F.col("a")), F.lit(0))
    return found.select(*keys, "ratio", "rows", low.alias("low"), high.alias("high"))


def _shrunk(own: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """own's fences, each averaged with the one above it (joined on keys) that weighs PRIOR rows."""
    above = above.select(*keys, "ratio", F.col("low").alias("low_above"), F.col("high").alias("high_above"))
    mean = lambda c: F.floor((F.col("rows") * F.col(c) + PRIOR * F.col(f"{c}_above")) / (F.col("rows") + PRIOR)).cast("long").alias(c)
    return own.join(above, [*keys, "ratio"]).select(*(c for c in own.columns if c not in ("low", "high")), mean("low"), mean("high"))


def group_fences(rows: DataFrame) -> DataFrame:
    """lang, source and `k_low`, `k_high` of each ratio k for the groups of rows(lang, source, figures)."""
    keys = ["lang", "source"]
    by_source = cut(sketches(rows, keys), "sketches")
    by_lang = cut(merged(by_source, ["lang"]), "sketches")
    overall = fences(merged(by_lang, []), [])
    ours = _shrunk(fences(by_source, keys), _shrunk(fences(by_lang, ["lang"]), overall, []), ["lang"])
    pick = lambda k, c: F.max(F.when(F.col("ratio") == k, F.col(c))).alias(f"{k}_{c}")
    return ours.groupBy(*keys).agg(*(pick(k, c) for k in RATIOS for c in ("low", "high")))


def beyond(k: str) -> Column:
    """Is a row's count outside what its group's fences allow in a text of its size?"""
    count, size, unit = RATIOS[k]
    scaled = lambda fence: F.col(f"{k}_{fence}") * F.col(size)
    over = lambda diff, fence: (diff > 0) & (diff.cast("double") * diff.cast("double") > (9000 * unit * scaled(fence)).cast("double"))
    out = over(1000 * F.col(count) - scaled("high") - 3000 * unit, "high")
    return out | over(scaled("low") - 1000 * F.col(count) - 3000 * unit, "low") if k == "word_length" else out


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each document: doc_id, the base figures, base_failed, kept, and the ratios that reject it."""
    named = docs.select(id_col, text_col, F.col(lang_col).alias("__lang"), F.col(source_col).alias("__source"))
    rows = figures(named, id_col, text_col, ("__lang", "__source"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.select("doc_id", F.coalesce("__lang", F.lit("")).alias("lang"), F.coalesce("__source", F.lit("")).alias("source"), "n_lines", *BASE, failed.alias("base_failed"))
    rows = cut(rows, "figures")  # few bytes a row, and read twice
    groups = cut(group_fences(rows.filter(~F.col("base_failed"))), "fences")
    # few groups go to every task, so a large one costs no shuffle; many are merged
    groups = F.broadcast(groups) if groups.count() <= MAX_SENT else groups.hint("merge")
    met = rows.join(groups, ["lang", "source"], "left")
    rejects = F.filter(F.array(*(F.when(beyond(k), F.lit(k)) for k in RATIOS)), lambda x: x.isNotNull())
    return met.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.size(rejects) == 0)).alias("kept"), rejects.alias("rejected_by"))
