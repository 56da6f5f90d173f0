"""JSON without a schema, held as variants: which keys there are, of what kind, and how often.

Logs may carry usage fields that no reader names yet. `key_counts` finds them all in one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind_of(value: Column) -> Column:
    """The kind of a variant: OBJECT, ARRAY, STRING, BIGINT and so on; VOID for JSON's null."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _children(path: Column, value: Column) -> Column:
    """Paths and values right below a variant; none below what is neither an object nor an array."""
    fields = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    named = F.transform(fields, lambda e: F.struct(F.concat(path, F.lit("."), e["key"]).alias("path"), e["value"].alias("value"), F.lit(True).alias("open")))
    listed = F.transform(
        F.try_variant_get(value, "$", "array<variant>"), lambda v: F.struct(F.concat(path, F.lit("[]")).alias("path"), v.alias("value"), F.lit(True).alias("open"))
    )
    kind = kind_of(value)
    return F.when(kind == "OBJECT", named).when(kind == "ARRAY", listed)


def paths(rows: DataFrame, json_col: str, depth: int = 5) -> DataFrame:
    """Each value of each document down to `depth`: the other columns, `path` (`$` is the document, `.name` a field, `[]` any item of an
    array), and the variant `value`. Text that is no JSON has the path null; null text gives nothing."""
    own = [F.col(f"`{c}`") for c in rows.columns if c != json_col]
    parsed = F.try_parse_json(F.col(f"`{json_col}`"))
    first = rows.where(F.col(f"`{json_col}`").isNotNull()).withColumn("_v", parsed)
    found = first.select(*own, F.struct(F.when(F.col("_v").isNotNull(), "$").alias("path"), F.col("_v").alias("value"), F.col("_v").isNotNull().alias("open")).alias("_at"))
    for _ in range(depth):
        closed = F.struct(F.col("_at.path").alias("path"), F.col("_at.value").alias("value"), F.lit(False).alias("open"))
        below = F.coalesce(F.when(F.col("_at.open"), _children(F.col("_at.path"), F.col("_at.value"))), F.array().cast(found.select(F.array("_at").alias("x")).schema["x"].dataType))
        found = found.select(*own, F.explode(F.concat(F.array(closed), below)).alias("_at"))
    return found.select(*own, F.col("_at.path").alias("path"), F.col("_at.value").alias("value"))


def key_counts(rows: DataFrame, json_col: str, by: list[str] | None = None, depth: int = 5) -> DataFrame:
    """How often each path has which kind: the columns of `by`, path, kind, n. Text that is no JSON counts under the path null."""
    keys = by or []
    found = paths(rows.select(*keys, json_col), json_col, depth)
    return found.groupBy(*keys, "path", F.when(F.col("path").isNotNull(), kind_of(F.col("value"))).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def unknown_keys(rows: DataFrame, json_col: str, known: list[str], by: list[str] | None = None, depth: int = 5) -> DataFrame:
    """The counts of the paths that are not in `known`; paths of objects that hold known ones are known too."""
    holding = {path.rsplit(".", i)[0] for path in known for i in range(path.count(".") + 1)} | {"$"}
    return key_counts(rows, json_col, by, depth).where(F.col("path").isNotNull() & ~F.col("path").isin(sorted(holding)))
