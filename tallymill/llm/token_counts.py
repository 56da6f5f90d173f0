"""Token counts by separator scan over flat token files.

A flat token file holds the ids of many documents, each ended by one end-of-document id, with no index. Files are cut
into blocks wherever the byte count falls; a task maps a block, finds the separators in it with one vectorised comparison,
and reports their places. A prefix scan over the blocks of a file carries two numbers across boundaries: the documents
ended so far and the place of the last separator. It runs over these two numbers of each block alone, within runs of blocks
and then over the runs of a file, so even a file of millions of blocks brings no task more than a few thousand rows; the
places are joined to its result afterwards. A document's length is the distance between its separator and the one
before, whichever block that was in.

`write_flat` makes such files from documents: it needs a shared folder mounted on every machine, and a tokenizer file of
byte-pair ranks that Spark hands to the executors. A repeated task attempt writes files of its own; those that no
manifest row names are never read.

Defined results: null and empty texts have 0 tokens; very long texts are encoded and counted whole; repeated rows are counted each; tokens after the last separator
count as one more document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import mounted, publish, scratch, written

#: How byte-level BPE of this family cuts text before merging; a fixed value of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END = 50256
FILE_TOKENS = 16_000_000


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _writer(folder: str, vocabulary: str, end: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(SparkFiles.get(vocabulary)).encode_ordinary
        held: list[np.ndarray] = []
        ids: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{folder}/{uuid.uuid4().hex}.tokens"
            tokens = np.concatenate(held)
            publish(name, tokens.tobytes())
            n = len(held)
            docs = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array(np.arange(n)), pa.array(np.full(n, len(tokens))), docs], ["file", "ordinal", "tokens", "_id"]
            )

        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                held.append(np.append(np.array(encode(text.as_py() or ""), kind), np.array([end], kind)))
                ids.append(batch.column(0).slice(k, 1))
                size += len(held[-1])
                if size >= FILE_TOKENS:
                    yield flush()
                    held, ids, size = [], [], 0
        if held:
            yield flush()

    return run


def write_flat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END, kind: str = "<u2") -> DataFrame:
    """Writes the token files; returns their manifest: file, ordinal of the document in it, tokens of the file, id."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    folder = mounted(scratch(spark, "flat-tokens"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"file string, ordinal long, tokens long, _id {rows.schema['_id'].dataType.simpleString()}"
    manifest, _ = written(rows.mapInArrow(_writer(folder, os.path.basename(vocabulary), end, kind), schema), "flat-manifest")
    return manifest.withColumnRenamed("_id", id_col)


def _scanner(end: int, kind: str, block: int):
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for name, k, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = min(block, size - k * block)
                tokens = np.fromfile(name, kind, n, offset=k * block * width)
                at = np.flatnonzero(tokens == end) + k * block
                if k * block + n == size and tokens[-1] != end:
                    at = np.append(at, size)  # the file's last document has no separator
                places.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int64()))], ["file", "block", "places"])

    return run


RUN = 4096


def scan(files: DataFrame, end: int = END, kind: str = "<u2", block: int = 1 << 20, run: int = RUN) -> DataFrame:
    """For files (file, tokens): one row per document: file, ordinal, n_tokens. `block`: tokens a block; `run`: blocks a run."""
    blocks = files.where("tokens > 0").select(
        "file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block).cast("long"))).alias("block"), "tokens"
    )
    found = blocks.repartition("file", "block").mapInArrow(_scanner(end, kind, block), "file string, block long, places array<long>")
    found, _ = written(found.where(F.size("places") > 0), "flat-places")
    each = found.select("file", F.floor(F.col("block") / run).alias("_run"), "block", F.size("places").alias("_n"), F.array_max("places").alias("_end"))

    def carried(rows: DataFrame, keys: list[str], order: str, ended: str, last: str) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({ended: F.coalesce(F.sum("_n").over(before), F.lit(0)), last: F.max("_end").over(before)}).drop("_n", "_end")

    runs = carried(each.groupBy("file", "_run").agg(F.sum("_n").alias("_n"), F.max("_end").alias("_end")), ["file"], "_run", "_ended_run", "_last_run")
    inside = carried(each, ["file", "_run"], "block", "_ended", "_last")
    ahead = inside.join(runs, ["file", "_run"]).select(
        "file", "block", (F.col("_ended") + F.col("_ended_run")).alias("_ended"), F.coalesce("_last", "_last_run", F.lit(-1)).alias("_last")
    )
    earlier = F.concat(F.array("_last"), F.col("places"))
    lengths = F.zip_with("places", F.slice(earlier, F.lit(1), F.size("places")), lambda p, q: p - q - 1)
    return found.join(ahead, ["file", "block"]).select("file", "_ended", F.posexplode(lengths).alias("_k", "n_tokens")).select(
        "file", (F.col("_ended") + F.col("_k")).cast("long").alias("ordinal"), "n_tokens"
    )


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END, block: int = 1 << 20) -> DataFrame:
    """One row per document: id, n_tokens."""
    manifest = write_flat(docs, id_col, text_col, vocabulary, end)
    counts = scan(manifest.select("file", "tokens").distinct(), end, block=block)
    # the names repeat and compress well, so the files say little about the size in memory: never broadcast
    return manifest.select("file", "ordinal", id_col).hint("merge").join(counts, ["file", "ordinal"]).select(id_col, "n_tokens")
