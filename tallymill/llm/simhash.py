"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits form 32 segments of two bits. The vector of the segments' bit counts is an embedding in which
the Manhattan distance never exceeds the Hamming distance of the fingerprints, so fingerprints within `distance` bits are
within `distance` in it. The vector is kept in 64 bits with each count in unary (0, 1, 2 as 00, 01, 11), so a Manhattan
distance is the bit count of an exclusive or.

Grid range-join: the segments are dealt into `groups` groups. Two vectors within Manhattan distance `distance` agree
exactly in at least `groups - distance` groups, so each fingerprint is filed under its cell in every projection onto that
many groups, and only fingerprints that share a cell are compared: first their Manhattan distance as the lower bound,
then the exact Hamming distance. No link is lost, whatever the data. More groups make smaller cells and more filings; how
many is chosen by the number of distinct fingerprints (`groups_for`), so comparisons grow little faster than the input.

Only distinct fingerprints take part, so a group of copies is one row. A cell with more than `block` fingerprints is cut
into blocks that meet pairwise in tasks of their own. A cell yields the edges of a spanning forest, not its pairs.
Fingerprints of very many documents, and nodes of very many links, are joined by broadcast (`with_groups`), and their rows dealt by
place, so rows without an id, or with one repeated id, come to many tasks.

Defined results: null and blank texts have fingerprint zero and are linked like any other; texts below four words have
one shingle, the whole sequence; very long texts are taken whole, in chunks; repeated rows share a fingerprint; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import with_groups, written
from tallymill.llm.graph import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
CHUNK = 1 << 16
_M = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit SimHash of a text in UTF-8."""
    words = (text or b"").lower().split()  # both act on ASCII alone in bytes
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - SHINGLE + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        spans = zip(starts[at:to].tolist(), ends[at + SHINGLE - 1 : to + SHINGLE - 1].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans], np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["_id", "_fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns _id and _fp (the fingerprint's bits as a signed long), one row per document."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"_id {kind}, _fp long")


def embedding(x: np.ndarray) -> np.ndarray:
    """Per-segment bit counts in unary."""
    return (((x & (x >> _ONE)) & _M) << _ONE) | ((x | (x >> _ONE)) & _M)


def _embedding_column(fp: str) -> Column:
    m = int(_M)
    return F.expr(f"shiftleft({fp} & shiftrightunsigned({fp}, 1) & {m}L, 1) | (({fp} | shiftrightunsigned({fp}, 1)) & {m}L)")


def projections(groups: int, distance: int) -> list[int]:
    """The masks (signed) of the projections onto `groups - distance` of the groups."""
    edges = [round(i * 32 / groups) for i in range(groups + 1)]
    masks = [sum(3 << (2 * s) for s in range(edges[g], edges[g + 1])) for g in range(groups)]
    found = [sum(masks[g] for g in chosen) for chosen in combinations(range(groups), groups - distance)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def groups_for(fingerprints: int, distance: int = DISTANCE, filing: float = 50) -> int:
    """The number of groups with the least work: filings, each as dear as `filing` comparisons, and comparisons within cells.

    Two random fingerprints agree in the bit count of a segment with probability 3/8.
    """

    def work(groups: int) -> float:
        return comb(groups, distance) * (filing + fingerprints * (3 / 8) ** (32 * (groups - distance) / groups))

    return min(range(distance + 2, 17), key=work)


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after tying each i to j: the smallest index reached."""
    while i.size:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        np.minimum.at(label, before[i], least)
        np.minimum.at(label, before[j], least)
        label = label[label]
        if (label == before).all():
            break
        differ = label[i] != label[j]
        i, j = i[differ], j[differ]
    return label


def link_cells(cell: np.ndarray, fp: np.ndarray, distance: int, most_pairs: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links inside cells. `cell`: ascending cell numbers; `fp`: uint64."""
    n = len(fp)
    label, u = np.arange(n), embedding(fp)
    last = np.searchsorted(cell, cell, side="right")
    active, d, held, size = np.arange(n), 1, [], 0
    while True:
        active = active[active + d < last[active]]
        if not active.size:
            break
        near = active[np.bitwise_count(u[active] ^ u[active + d]) <= distance]
        near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= distance]
        if near.size:
            held.append((near, near + d))
            size += near.size
        if size >= most_pairs:
            label = _forest(label, *(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [(np.arange(n), label.copy())], 0
        d += 1
    if held:
        label = _forest(label, *(np.concatenate(x) for x in zip(*held, strict=True)))
    tied = np.flatnonzero(label != np.arange(n))
    return fp[tied], fp[label[tied]]


def _linker(distance: int, rows: int = 1 << 18):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cell = np.zeros(len(fp), np.int64)
            cell[change] = 1
            a, b = link_cells(np.cumsum(cell), fp, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1))
            size += batch.num_rows
            if size < rows:
                continue
            table = np.concatenate(held)
            whole = np.flatnonzero((table[1:, :3] != table[:-1, :3]).any(axis=1))
            cut = int(whole[-1]) + 1 if whole.size else 0  # the last cell may go on
            if cut:
                yield linked(table[:cut, :3], np.ascontiguousarray(table[:cut, 3]).view(np.uint64))
            held, size = [table[cut:]], len(table) - cut
        if size:
            table = np.concatenate(held)
            yield linked(table[:, :3], np.ascontiguousarray(table[:, 3]).view(np.uint64))

    return run


def links(fps: DataFrame, distance: int = DISTANCE, groups: int | None = None, block: int = 20_000) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `_fp` just as all links within `distance` bits do. `groups`: chosen by their number where none is given."""
    groups = groups or groups_for(fps.count(), distance)
    masks = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(m).cast("long").alias("m")) for t, m in enumerate(projections(groups, distance))])
    filed = (
        fps.select("_fp", _embedding_column("_fp").alias("_u"), F.explode(masks).alias("_p"))
        .select("_fp", F.col("_p.t").alias("t"), F.col("_u").bitwiseAND(F.col("_p.m")).alias("c"))
    )
    crowded = filed.groupBy("t", "c").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    blocks = F.ceil(F.col("_n") / block)
    own = F.pmod(F.xxhash64("_fp"), blocks)
    meetings = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.least(k, own) * 1_000_000 + F.greatest(k, own))
    dealt = filed.join(crowded, ["t", "c"], "left").withColumn(
        "s", F.explode(F.when(F.col("_n").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(meetings))
    )
    return (
        dealt.select("t", "c", "s", "_fp").repartition("t", "c", "s").sortWithinPartitions("t", "c", "s", "_fp").mapInArrow(_linker(distance), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, groups: int | None = None, block: int = 20_000
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id reachable, its own included)."""
    marked, _ = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct, _ = written(marked.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n")), "distinct-fingerprints")
    labels = components(links(distinct.select("_fp"), distance, groups, block))
    labelled, _ = written(distinct.join(labels.withColumnRenamed("node", "_fp"), "_fp", "left"), "labelled-fingerprints")  # read several times
    linked = labelled.where("label is not null")
    # a component of a third of all fingerprints is combined by partial aggregation, and its least id comes back as any group's value
    least = linked.groupBy("label").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_nodes"))
    placed = with_groups(linked, least, ["label"], "_nodes", F.col("_fp"), linked.count(), own={"component_id": F.min("_least")}).select("_fp", "_n", F.col("_group.component_id").alias("component_id"))
    shared = placed.unionByName(labelled.where("label is null and _n > 1").select("_fp", "_n", F.col("_least").alias("component_id")))
    shared, _ = written(shared, "shared-fingerprints")
    return with_groups(marked, shared, ["_fp"], "_n", F.monotonically_increasing_id()).select(
        F.col("_id").alias(id_col),
        F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        F.coalesce("_group.component_id", "_id").alias("component_id"),
    )
