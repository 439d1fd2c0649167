"""Mixing sources to target weights by iterative proportional fitting (raking).

Tokens (words) are summed for each cell of (source, language, topic). Raking finds a weight for each cell, the
product of a factor for its source, its language and its topic, such that expected tokens meet the
target of every margin, where no weight may exceed 1: a document can't be drawn more than once. The
weight is the probability with which each document of the cell is kept; a hash of the id, uniform in
[0, 1), decides, so that the sample is the same however tasks run.

Targets are shares of each margin: given, or tempered from the corpus (share ** TEMPER, normalised),
which lifts small categories. The sample aims at BUDGET of all tokens; what a category can't give
even in full is left to the others in proportion.

Only the cells reach the driver, whose number is checked: sources x languages x topics, not rows.
Defined results: null sources, languages and topics are categories of their own; null and empty texts have
0 tokens and are kept with the weight of their cell; repeated rows share one decision; a null id is
hashed as it is; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut, whole_rows

TEMPER = 0.7
BUDGET = 0.6
MARGINS = ("source", "lang", "topic")
#: The most cells that the driver will rake; beyond, the margins are not categories.
MAX_CELLS = 500_000
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic(text: Column) -> Column:
    """Where no column names a topic, one by form: table, code, contact, note or prose."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains(" | "), "table")
        .when(t.contains(" = ") | t.contains("{"), "code")
        .when(t.contains("@") | t.contains("+1 ("), "contact")
        .when(F.length(t) < 600, "note")
        .otherwise("prose")
    )


def margins(text: Column, source: Column, lang: Column, given: Column | None = None) -> dict[str, Column]:
    of = topic(text) if given is None else F.coalesce(given.cast("string"), F.lit(""))
    return {"source": F.coalesce(source, F.lit("")), "lang": F.coalesce(lang, F.lit("")), "topic": of, "n_tokens": tokens(text)}


def tempered(mass: np.ndarray, temper: float = TEMPER) -> np.ndarray:
    share = (mass / max(mass.sum(), 1)) ** temper
    return share / max(share.sum(), 1e-300)


def rake(mass: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Weights in [0, 1] for cells of given mass; codes[k] gives each cell's category in margin k,
    targets[k] the mass wanted of each category."""
    free = np.full(len(mass), min(1.0, targets[0].sum() / max(mass.sum(), 1e-300)))
    for _ in range(rounds):
        moved = 0.0
        for code, target in zip(codes, targets, strict=True):
            for _ in range(20):  # what is at the limit can't grow, so the rest grows for it
                w = np.minimum(free, 1.0)
                full = free >= 1.0
                now = np.bincount(code, mass * w, len(target))
                fixed = np.bincount(code, mass * full, len(target))
                loose = now - fixed
                up = target > now
                factor = np.where(up, (target - fixed) / np.maximum(loose, 1e-300), target / np.maximum(now, 1e-300))
                factor = np.where(up & (loose <= 0), 1.0, np.clip(factor, 1e-6, 1e6))[code]
                factor = np.where(full & up[code], 1.0, factor)
                free = np.minimum(free, 1.0) * factor
                moved = max(moved, float(np.abs(np.minimum(free, 1) - w).max(initial=0)))
                if np.allclose(np.bincount(code, mass * np.minimum(free, 1), len(target)), np.minimum(target, np.bincount(code, mass, len(target))), rtol=1e-10):
                    break
        if moved < tolerance:
            break
    return np.minimum(free, 1.0)


def weights(rows: DataFrame, temper: float = TEMPER, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """source, lang, topic, weight for each cell of rows(source, lang, topic, n_tokens)."""
    spark = rows.sparkSession
    keys = list(MARGINS)
    found = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("n")).orderBy(*keys).limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells: the margins are not categories")
    mass = np.array([r.n for r in found], float)
    codes, wanted = [], []
    for k, margin in enumerate(MARGINS):
        names, code = np.unique([r[k] for r in found], return_inverse=True) if found else (np.array([]), np.array([], int))
        have = np.bincount(code, mass, len(names))
        share = np.array([(targets or {})[margin].get(str(x), 0.0) for x in names]) if targets and margin in targets else tempered(have, temper)
        codes.append(code)
        wanted.append(_feasible(share * budget * mass.sum(), have))
    w = rake(mass, codes, wanted) if len(mass) and mass.sum() else np.ones(len(mass))
    schema = ", ".join(f"{k} string" for k in keys) + ", weight double"
    return spark.createDataFrame([(*(r[k] for k in range(3)), float(x)) for r, x in zip(found, w, strict=True)], schema)


def _feasible(target: np.ndarray, have: np.ndarray) -> np.ndarray:
    """No target above what there is; the rest of it goes to the others in proportion."""
    target = target.copy()
    for _ in range(len(target)):
        over = target > have
        spare = (target - have)[over].sum()
        if spare <= 1e-9 or over.all():
            break
        target[over] = have[over]
        target[~over] *= 1 + spare / max(target[~over].sum(), 1e-300)
    return np.minimum(target, have)


def drawn(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1), from the id alone."""
    return F.pmod(F.xxhash64(doc_id.cast("long"), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _margins(text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> dict[str, Column]:
    return margins(F.col(text_col), F.col(source_col), F.col(lang_col), F.col(topic_col) if topic_col else None)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", temper: float = TEMPER, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None, topic_col: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, kept for each document. topic_col: the column that
    names topics, if there is one."""
    columns = _margins(text_col, source_col, lang_col, topic_col)
    # texts are read once; what is left of them is a few bytes a row
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), *(c.alias(k) for k, c in columns.items())), "margins")
    out = rows.join(F.broadcast(weights(rows, temper, budget, targets)), list(MARGINS))  # at most MAX_CELLS rows
    return out.select("doc_id", *MARGINS, "n_tokens", "weight", (drawn(F.col("doc_id")) < F.col("weight")).alias("kept"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", temper: float = TEMPER, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None, topic_col: str | None = None) -> DataFrame:
    """The sampled rows of docs, with docs' own columns."""
    rows = whole_rows(docs, doc_id=F.col(id_col).cast("long"), **_margins(text_col, source_col, lang_col, topic_col))
    out = rows.join(F.broadcast(weights(rows.drop("row"), temper, budget, targets)), list(MARGINS))
    return out.filter(drawn(F.col("doc_id")) < F.col("weight")).select("row.*")
