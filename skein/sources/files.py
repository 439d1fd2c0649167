"""Reading source trees: files as rows, with hashes, languages and ignore rules."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.paths import IGNORED_DIRS, MAX_FILE_BYTES, is_ignored, language, slashes


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """path, content, content_hash, language, size, modified_at of the source files under root.

    Size and path rules come first, so Spark's binary source never reads the content of other files.
    """
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", ""), f"^.*?{_quoted(base)}/", "")
    named = raw.filter(F.col("length") <= MAX_FILE_BYTES).withColumn("path", slashes(relative))
    known = named.filter(~is_ignored(F.col("path"), ignore) & (language(F.col("path")) != "unknown"))
    text = F.decode("content", "UTF-8")
    return known.select(
        "path", text.alias("content"), F.sha2("content", 256).alias("content_hash"), language(F.col("path"), text).alias("language"),
        F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"),
    )


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def tracked(spark: SparkSession, root: str) -> DataFrame:
    """(path) of tracked and of untracked files that are not ignored, as git lists them."""
    out = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True)
    return spark.createDataFrame([(p,) for p in out.stdout.decode().split("\0") if p], "path string")


def git_changes(spark: SparkSession, root: str) -> DataFrame:
    """(path, change) of the working tree: added, removed or modified."""
    out = subprocess.run(["git", "-C", root, "status", "--porcelain", "--untracked-files=all"], capture_output=True, check=True, text=True)
    lines = spark.createDataFrame([(x,) for x in out.stdout.splitlines()], "line string")
    mark = F.substring("line", 1, 2)
    change = F.when(mark == "??", "added").when(mark.contains("D"), "removed").when(mark.contains("A"), "added").otherwise("modified")
    return lines.select(F.regexp_replace(F.expr("substring(line, 4)"), "^.* -> ", "").alias("path"), change.alias("change"))


def within(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths, "path", "left_semi")


def nested_repositories(root: str, depth: int = 4, entries: int = 2000) -> list[str]:
    """Directories below root that are repositories of their own, looked for so deep and through so many entries."""
    found, seen, level = [], 0, [Path(root)]
    for _ in range(depth):
        following = []
        for folder in level:
            for child in sorted(p for p in folder.iterdir() if p.is_dir()):
                seen += 1
                if seen > entries:
                    return found
                if (child / ".git").exists():
                    found.append(str(child.relative_to(root)))
                elif child.name not in IGNORED_DIRS:
                    following.append(child)
        level = following
    return found
