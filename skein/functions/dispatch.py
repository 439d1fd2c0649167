"""Dynamic dispatch: places in a body where the callee is chosen at run time, by form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: (form, languages or none for all, pattern whose first group is the key, if any)
FORMS = (
    ("computed-member", (), r"\[\s*([A-Za-z_$][\w$.]*)\s*\]\s*\("),
    ("event-emit", (), r"\b(?:emit|dispatch|publish|trigger|fire)\(\s*['\"]([^'\"]+)['\"]"),
    ("event-listen", (), r"\b(?:on|once|addEventListener|subscribe)\(\s*['\"]([^'\"]+)['\"]"),
    ("reflection", ("java", "kotlin", "csharp", "go"), r"\b(?:getMethod|GetMethod|MethodByName|Class\.forName)\(\s*\"([^\"]+)\""),
    ("getattr", ("python",), r"\bgetattr\(\s*[\w.]+\s*,\s*['\"]?([\w.]+)"),
    ("send", ("ruby",), r"\.(?:public_)?send\(\s*:?([\w.]+)"),
    ("selector", ("swift", "objc"), r"(?:#selector\(|@selector\()([\w.:]+)"),
    ("call-user-func", ("php",), r"\bcall_user_func(?:_array)?\(\s*['\"]?([\w$:]+)"),
    ("container", (), r"\b(?:container|injector|ioc)\.(?:get|resolve|make)\(\s*['\"]?([\w.]+)"),
    ("handler-table", (), r"\b(?:handlers|callbacks|listeners|routes|commands)\s*\[\s*['\"]?([\w.]+)"),
)
MOST_CHARS, PER_BODY = 60_000, 3


def scan(bodies: DataFrame, per_body: int = PER_BODY) -> DataFrame:
    """bodies(id, language, body) to (id, form, key): at most per_body sites of a body, in the order of forms."""
    text = F.substring("body", 1, MOST_CHARS)
    sites = []
    for form, languages, pattern in FORMS:
        keys = F.regexp_extract_all(text, F.lit(pattern), 1)
        keys = F.when(F.col("language").isin(*languages), keys) if languages else keys
        sites.append(_tagged(keys, form))
    every = bodies.select("id", F.posexplode(F.flatten(F.array(*sites))).alias("place", "site"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("place"))
    return every.withColumn("_k", first).filter(F.col("_k") <= per_body).select("id", "site.form", "site.key")


def _tagged(keys, form: str):
    return F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.struct(F.lit(form).alias("form"), k.alias("key")))


def boundaries(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, form, key, target): sites with the callables whose name is the key."""
    callable_ = nodes.filter(F.col("kind").isin("function", "method")).select(F.col("id").alias("target"), F.col("name").alias("key"))
    return sites.join(callable_, "key").select("id", "form", "key", "target")
