"""Mixing sources to target weights by systematic sampling.

Within a source every document expects the same number of copies, target / source size. Documents stand in a fixed
order; the running sum of expected copies plus one random offset a source is cut at the integers, and a document is
emitted once for each integer it crosses. The order goes by size first, so that large and small documents are drawn
in proportion and the words taken stay near the target.

The running sum is distributed: documents fall into strata (leading two digits of the size, then a hash slice of the
id), histograms of classes and of slices within a class give each stratum its first position, and only positions inside
one stratum are counted by a window. A source with a third of all rows is spread over its strata. The words of a text are
counted once, and once more where whole rows are carried along. Targets are found over the table of sources, by windows
that run in one task. Positions are 64-bit integers; a copy is `2**24` steps, and whole and part are multiplied apart, so
positions up to 2**38 within a source neither overflow nor give a document more than ceil(rate) <= 3 copies.

Defined results: a null text has size 0; null sources are one source, last in order; a source of size 0 takes
nothing; very long texts are counted whole; an empty table gives an empty result; repeated rows are drawn independently.
Rows of the same source, size and id stand in the order of a hash of the whole row where rows are carried along, so reruns
agree; without, they differ in nothing that is returned, and their copies are the same as a set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.llm.common import word_count, written

STEPS = 1 << 24


def hashed(value: Column, digits: int) -> Column:
    """The first hex digits of an MD5 as a number."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, digits), 16, 10).cast("long")


def row_hash(docs: DataFrame, row: str) -> Column:
    """Hash of a row of `docs` held in a struct column; maps and variants, which have none, count by their JSON."""

    def plain(kind: T.DataType) -> bool:
        if isinstance(kind, (T.MapType, T.VariantType)):
            return False
        inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
        return all(map(plain, inner))

    fields = [(F.col(row).getField(f.name), plain(f.dataType)) for f in docs.schema.fields]
    return F.xxhash64(*[c if hashable else F.to_json(F.struct(c.alias("c"))) for c, hashable in fields])


def source_targets(sizes: DataFrame, source_col: str = "source", weights: int = 3, at_most: int = 3) -> DataFrame:
    """One row a source: size, weight 1..weights by rank, target. `sizes`: source and size of each document.

    Targets share the sum of all sizes by weight, stop at `at_most` times the source's size, and what stands above is
    shared again by weight. The final level is found in one pass: sources reach their limit in the order of limit by
    weight. Setting the first i of them to their limits gives a level for the rest that rises as long as the next source is
    above its limit and falls afterwards, so the level looked for is the largest.
    """
    totals = sizes.groupBy(source_col).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    whole = Window.partitionBy()
    ranked = totals.withColumn(
        "weight", (F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1) % weights + 1
    ).withColumn("_limit", F.col("source_size") * at_most)
    order = Window.orderBy((F.col("_limit") / F.col("weight")).asc(), F.col(source_col).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = ranked.withColumns(
        {
            "_all": F.sum("source_size").over(whole),
            "_full": F.coalesce(F.sum("_limit").over(before), F.lit(0)),
            "_open": F.sum("weight").over(after),
        }
    ).withColumn("_level", (F.col("_all") - F.col("_full")).cast("double") / F.col("_open"))
    return levels.withColumn("_final", F.max("_level").over(whole)).select(
        source_col,
        "source_size",
        "source_docs",
        "weight",
        F.least(F.col("_limit").cast("double"), F.col("weight") * F.col("_final")).alias("target"),
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: int = 3,
    at_most: int = 3, seed: str = "mix-1", slices: int = 3, carry: bool = False,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken. `slices`: hex digits of hash slices a size class. With `carry` also the whole row, as struct `row`."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size"), *row)
    digits = F.length(F.col("size").cast("string"))
    stratum = digits * 100 + F.substring(F.col("size").cast("string"), 1, 2).cast("int")
    rows = rows.withColumns({"_class": stratum, "_slice": hashed(F.coalesce(F.col("_id").cast("string"), F.lit("")), slices)})
    rows = rows.withColumn("_has", F.col("_source").isNotNull()).withColumn("_source", F.coalesce("_source", F.lit("")))
    key = ["_has", "_source", "_class", "_slice"]
    if not carry:
        rows, _ = written(rows, "mix-sizes")
    strata = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("size"))
    if carry:
        strata, _ = written(strata, "mix-strata")
    before = lambda by, *keys: F.coalesce(
        F.sum("_n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    classes = strata.groupBy("_has", "_source", "_class").agg(F.sum("_n").alias("_n"))
    classes = classes.select("_has", "_source", "_class", before("_class", "_has", "_source").alias("_lower"))
    offset = hashed(F.concat(F.lit(f"{seed}:"), "_source", F.col("_has").cast("string")), 6)
    targets = source_targets(
        strata.withColumn("_key", F.when(F.col("_has"), F.col("_source"))).select("_key", "size"), "_key", weights, at_most
    ).select(F.col("_key").isNotNull().alias("_has"), F.coalesce("_key", F.lit("")).alias("_source"), "source_size", "target")
    placed = (
        strata.select(*key, before("_slice", "_has", "_source", "_class").alias("_earlier"))
        .join(classes, ["_has", "_source", "_class"])
        .withColumn("_first", F.col("_lower") + F.col("_earlier"))
        .drop("_lower", "_earlier")
        .join(targets, ["_has", "_source"])
        .withColumns(
            {
                "_offset": offset,
                "_rate": F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0)) * STEPS), F.lit(0)).cast("long"),
            }
        )
    )
    low = (1 << 24) - 1
    # k * rate, with k's upper and lower half multiplied apart: (k >> 24) * rate is whole copies already
    whole = lambda k: F.shiftright(k, 24) * F.col("_rate") + F.shiftright(k.bitwiseAND(low) * F.col("_rate") + F.col("_offset"), 24)
    order = ["size", "_id", *([row_hash(docs, "row")] if carry else [])]
    return (
        rows.withColumn("_in", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
        .join(placed, key)
        .withColumn("_rank", F.col("_in") + F.col("_first"))
        .withColumn("copies", (whole(F.col("_rank")) - whole(F.col("_rank") - 1)).cast("long"))
        .select(
            F.col("_id").alias(id_col),
            F.when(F.col("_has"), F.col("_source")).alias(source_col),
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
            *(["row"] if carry else []),
        )
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a document's row once for each of its copies, numbered in `copy`, with its size and its source's size
    and target. Columns of the documents that have one of these four names give way."""
    added = ("size", "source_size", "target", "copy")
    drawn = mix(docs, carry=True, **options).where("copies > 0")
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in added]
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return drawn.select(*own, *added[:3], each)
