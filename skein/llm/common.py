"""What the corpus operators share: reading, scratch tables and batches for Python stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ship import ship
from skein.scratch import cut  # noqa: F401  the operators cut their lineage by it

#: Runs of these are the only white space that the corpus contracts know.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Make ready for a Python stage: send the package to the workers, and bound the rows that one
    Arrow batch holds, as texts may be long and workers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    ship(spark)


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), under our own names, so that no other column can clash; null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with one batch out for each batch in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def whole_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """Each row as one struct `row`, beside columns of our own: no name in docs can clash with these."""
    return docs.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in columns.items()))


#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1


def row_key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, h, text of each row: its id (NO_ID for null) and a hash of its text tell texts of one id apart."""
    return docs.select(row_key(id_col).alias("key"), row_hash(F.col(text_col)).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def keep_keyed(docs: DataFrame, kept: DataFrame, id_col: str, h: Column) -> DataFrame:
    """Rows of docs that kept(key, h, n_rows) names, one of those that repeat, with docs' own columns; h
    gives the hash of a row of docs.

    Of n_rows rows with one key and text the one whose columns come first as text stays; only where such
    rows exist are these gathered.
    """
    kept = cut(kept, "kept")
    rows = whole_rows(docs, key=row_key(id_col), h=h)
    out = rows.join(kept.filter("n_rows = 1").select("key", "h").hint("merge"), ["key", "h"], "left_semi").select("row.*")
    again = kept.filter("n_rows > 1").select("key", "h")
    if again.isEmpty():
        return out
    one = rows.join(again, ["key", "h"], "left_semi").groupBy("key", "h").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.unionByName(one.select("row.*"))


def normalised(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text, SPACE, " ")
