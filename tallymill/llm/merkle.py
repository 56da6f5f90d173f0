"""Merkle manifest of a data set: a root over all rows, and for each row a proof that it is in there.

A row's leaf is the SHA-256 of its fields. Within each source the leaves ascend by id; while there are several nodes, every
16 consecutive ones become the hash of their digests. The sources' own roots are joined to the manifest's root in the same way.

Leaves are numbered within their source without bringing a source to one task (`common.ranked`) and cut into aligned blocks of
4,096, three levels of the tree. A first pass reduces blocks to their roots, which are the nodes of the next tier, until
each source has one. Proofs go the other way by fractal traversal: a block keeps on each level the run of nodes that
holds the present leaf (the existing subtree) and grows the following run (the desired subtree) by one leaf a step, so it emits
the path of one leaf after the other and holds two runs of 16 digests a level and no more. The block then appends what its own
root's path is, which came from the tier above by a join of one row a block.

Defined results: null fields count as `-` and differ from empty ones; a null source is a source, first in order; null ids
stand first in their source; rows of one id stand by their leaf, and equal rows may change places; an empty table has no root
and gives an empty result; texts are hashed whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallymill.llm.common import ranked, written

WIDTH = 16
LEVELS = 3
BLOCK = WIDTH**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
KEY = ["_has", "_source"]

PATH = "array<struct<at: int, siblings: string>>"
NODES = "_has boolean, _source string, _pos long, _of long, _digest string"


def leaf(fields: Sequence[Column]) -> Column:
    """Hash of a row: each field as byte count, colon and value, `-` where it is null."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def joined(children: Sequence[str]) -> str:
    """Digest of a node over its children's digests, all as hex text."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Subtree:
    """A run of up to 16 nodes of one level, grown leaf by leaf; open runs of the levels below are all it holds besides."""

    def __init__(self, level: int):
        self.level, self.open = level, [[] for _ in range(level + 1)]

    def feed(self, leaf: str) -> None:
        for level, run in enumerate(self.open):
            run.append(leaf)
            if level == self.level or len(run) < WIDTH:
                return
            leaf, self.open[level] = joined(run), []

    def closed(self) -> list[str]:
        """The run, after unfinished nodes at the end of all leaves have been closed."""
        for level in range(self.level):
            if run := self.open[level]:
                self.open[level] = []
                self.open[level + 1].append(joined(run))
        return self.open[self.level]


def levels_of(count: int) -> int:
    """Levels of a block's own tree in a tier of `count` nodes: all three where there are other blocks."""
    level = 0
    while level < LEVELS and WIDTH**level < count:
        level += 1
    return level


def block_root(leaves: Sequence[str], levels: int) -> str:
    top = Subtree(levels)
    for x in leaves:
        top.feed(x)
    return top.closed()[0]


def paths(leaves: Sequence[str], levels: int) -> Iterator[list[tuple[int, list[str]]]]:
    """For each leaf of a block, from the lowest level up: its node's place in the run of siblings, and that run."""
    existing, desired = [], [Subtree(level) for level in range(levels)]
    for level in range(levels):
        first = Subtree(level)
        for x in leaves[: WIDTH ** (level + 1)]:
            first.feed(x)
        existing.append(first.closed())
    for i in range(len(leaves)):
        yield [(i // WIDTH**level % WIDTH, existing[level]) for level in range(levels)]
        for level in range(levels):
            ahead = WIDTH ** (level + 1)
            if i + ahead < len(leaves):
                desired[level].feed(leaves[i + ahead])
            if (i + 1) % ahead == 0 and i + 1 < len(leaves):
                existing[level], desired[level] = desired[level].closed(), Subtree(level)


def folded(digest: str, path: Sequence[tuple[int, str]]) -> str:
    """The root that a digest and its siblings lead to; a level is the digest's place and the others' digests in a row."""
    for at, siblings in path:
        digest = joined((siblings[: 64 * at], digest, siblings[64 * at :]))
    return digest


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("_block", F.floor(F.col("_pos") / BLOCK).cast("long"))


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.combine_chunks().sort_by("_pos")


def _reduce(rows: pa.Table) -> pa.Table:
    rows = _in_order(rows)
    first, count = rows.slice(0, 1), rows["_of"][0].as_py()
    return pa.table(
        {
            "_has": first["_has"],
            "_source": first["_source"],
            "_pos": first["_block"],
            "_of": pa.array([-(-count // BLOCK)], pa.int64()),
            "_digest": pa.array([block_root(rows["_digest"].to_pylist(), levels_of(count))]),
        }
    )


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """The given nodes, their blocks' roots, those blocks' roots and so on, until each key has one node; all but the first are written."""
    found = [nodes]
    while (nodes.agg(F.max("_of")).first()[0] or 1) > 1:
        nodes, _ = written(_blocks(nodes).groupBy(*KEY, "_block").applyInArrow(_reduce, NODES), "merkle-tier")
        found.append(nodes)
    return found


def _paths_above(rows: pa.Table, above: pa.Table) -> pa.Table:
    """Nodes of a block with their whole path: their own within the block, then that of the block's root."""
    rows = _in_order(rows)
    upper, count = above["_path"][0].as_py(), rows["_of"][0].as_py()
    own = [
        [{"at": at, "siblings": "".join(run[:at] + run[at + 1 :])} for at, run in path] + upper
        for path in paths(rows["_digest"].to_pylist(), levels_of(count))
    ]
    kind = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.string())]))
    return rows.select([*KEY, "_pos"]).append_column("_path", pa.array(own, kind))


def _upper(found: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the nodes of the first of these tiers; `top` has the paths of the last one's, one a key."""
    for nodes in reversed(found[:-1]):
        sides = _blocks(nodes).groupBy(*KEY, "_block").cogroup(top.withColumnRenamed("_pos", "_block").groupBy(*KEY, "_block"))
        top, _ = written(sides.applyInArrow(_paths_above, f"_has boolean, _source string, _pos long, _path {PATH}"), "merkle-paths")
    return top


def _prover(schema: pa.Schema):
    def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
        """A block's rows with their proofs, the root that each claimed digest leads to, and whether it is the manifest's."""
        rows = _in_order(rows)
        upper = [(x["at"], x["siblings"]) for x in above["_path"][0].as_py()]
        tail, subroot, root = "".join(s for _, s in upper), above["_subroot"][0].as_py(), above["_root"][0].as_py()
        digests, claimed = rows["_digest"].to_pylist(), rows["_claimed"].to_pylist()
        proofs, roots = [], []
        for claim, path in zip(claimed, paths(digests, levels_of(rows["_of"][0].as_py())), strict=True):
            own = [(at, "".join(run[:at] + run[at + 1 :])) for at, run in path]
            proofs.append(hashlib.sha256(("".join(s for _, s in own) + tail).encode()).hexdigest())
            roots.append(folded(claim, own + upper))
        same = lambda x: pa.array([x] * len(digests), pa.string())
        made = [rows["_id"], rows["_digest"], same(subroot), same(root), pa.array(proofs), pa.array(roots), pa.array([r == root for r in roots])]
        return pa.table(made, schema=schema)

    return prove


def manifest(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: Sequence[str] = FIELDS, claimed: Sequence[Column] | None = None
) -> DataFrame:
    """One row per input row: id, leaf, subroot (of its source), root, proof_sha256 (over all siblings, level by level up to the
    root), folded_root and verified. `claimed`: the fields as someone else has them, in the order of `fields`; their leaf is folded
    with the siblings of the stored row and verified against the root. Without it, the stored fields are verified.
    """
    own = [F.col(f"`{c}`") for c in fields]
    rows = docs.select(
        F.col(source_col).isNotNull().alias("_has"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
        F.col(id_col).alias("_id"),
        leaf(own).alias("_digest"),
        (leaf(own) if claimed is None else leaf(claimed)).alias("_claimed"),
    )
    leaves, _ = written(rows, "merkle-leaves")
    leaves, _ = written(ranked(leaves, KEY, [F.col("_id"), F.col("_digest")]), "merkle-order")
    found = tiers(leaves.select(*KEY, "_pos", "_of", "_digest"))
    subroots = found[-1].select(*KEY, F.col("_digest").alias("_subroot"))
    # the sources are the leaves of one more tree
    listed = found[-1].select(F.col("_has").alias("_first"), F.col("_source").alias("_name"), "_digest").withColumns({"_has": F.lit(True), "_source": F.lit("")})
    listed, _ = written(ranked(listed, KEY, [F.col("_first"), F.col("_name")]), "merkle-sources")
    over = tiers(listed.select(*KEY, "_pos", "_of", "_digest"))
    no_path = F.array().cast(PATH).alias("_path")
    of_source = _upper(over, over[-1].select(*KEY, "_pos", no_path)).join(listed.select("_pos", "_first", "_name"), "_pos")
    tops = of_source.select(F.col("_first").alias("_has"), F.col("_name").alias("_source"), F.lit(0).cast("long").alias("_pos"), "_path")
    of_block = _upper(found[1:], tops) if len(found) > 1 else tops
    root = over[-1].select(F.col("_digest").alias("_root"))
    named = of_block.join(subroots, KEY).withColumn("_root", root.scalar()).withColumnRenamed("_pos", "_block")
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")],
            T.StructField("verified", T.BooleanType()),
        ]
    )
    sides = _blocks(leaves).groupBy(*KEY, "_block").cogroup(named.groupBy(*KEY, "_block"))
    return sides.applyInArrow(_prover(to_arrow_schema(schema)), schema)
