"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and the first three to eight letters of longer words, hashed into `2**bits` buckets. A linear model
adds one weight a term; the factorization machine adds a product of factors for each pair, so that two terms can weigh
more, or less, together than apart. Training rows are a bounded sample of the labelled ones (`most_rows`, drawn by a hash
of the id; whole texts). Which buckets the machine (Spark's FMClassifier) learns from is decided twice:

* buckets whose document counts in the two classes differ, either way, by more than chance over so many buckets would give
  (likelihood ratio above 2 ln(buckets) + 2);
* after a first fit, what is left unexplained (label less probability) is added up over the rows that hold a bucket, and over
  the rows that hold two whole words. Buckets and pairs whose sum is further from 0 than chance over so many would give
  join, and the machine is fitted again. So a word that says nothing by itself counts where it makes a difference to
  another, be it that both together are toxic or that one takes the sting out of the other.

No pair is left out for being rare. What a pair leaves over is at most what either of its words leaves over on one side (the
toxic rows' part or the clean rows'), so a word both of whose sides are too small for the limit belongs to no pair that
reaches it; the pairs of all other words are added up, whatever their number. Scoring reads whole texts; a term counts once a
text, so long texts are not diluted.

Defined results: null and empty texts get the score of a text without any screened term; rows with a null label teach
nothing, of repeated labels of an id the largest counts; without both classes or any screened term every text gets the
share of toxic rows (0 without rows); repeated rows get equal scores; ties between buckets go to the smaller number; very
long texts are read whole, a batch of texts at a time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import remove, written
from tallymill.llm.language_id import words_of

STEMS = (3, 4, 5, 6, 7, 8)


def terms(word: str, bits: int) -> list[int]:
    """The buckets of a word: its own, and those of its first letters."""
    found = [f"w {word}", *(f"{k} {word[:k]}" for k in STEMS if len(word) > k)]
    return [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> (64 - bits) for x in found]


class Terms(dict):
    """Buckets of words, kept for words seen before; with `index`, only screened ones, by their number."""

    def __init__(self, bits: int, index: dict[int, int] | None = None, most: int = 300_000):
        super().__init__()
        self.bits, self.index, self.most = bits, index, most

    def __missing__(self, word: str):
        found = terms(word, self.bits)
        if self.index is not None:
            found = [self.index[x] for x in found if x in self.index]
        if len(self) >= self.most:
            self.clear()
        self[word] = out = tuple(found) or None
        return out

    def of(self, text: str | None) -> set[int]:
        found: set[int] = set()
        for x in map(self.__getitem__, set(words_of(text)) if text else ()):
            if x:
                found.update(x)
        return found

    def whole(self, text: str | None) -> set[int]:
        """The buckets of whole words alone; without `index` only."""
        return {x[0] for x in map(self.__getitem__, set(words_of(text)) if text else ()) if x}


@dataclass
class Machine:
    bits: int
    index: dict[int, int]
    intercept: float
    linear: np.ndarray
    factors: np.ndarray

    def probability(self, found: set[int]) -> float:
        at = np.fromiter(found, np.int64, len(found))
        v = self.factors[at]
        z = self.intercept + self.linear[at].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def of_buckets(self, found: set[int]) -> float:
        return self.probability({self.index[x] for x in found if x in self.index})


def _document_counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = Terms(bits), np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = cache.of(text)
                seen[1 if toxic else 0, np.fromiter(found, np.int64, len(found))] += 1
        at = np.flatnonzero(seen.any(axis=0))
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[1, part]), pa.array(seen[0, part])], ["bucket", "toxic", "clean"])

    return run


def screened(rows: DataFrame, bits: int) -> list[int]:
    """Buckets that tell the classes apart by themselves, either way, most telling first."""
    n = {bool(r[0]): r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return []
    counts = rows.mapInArrow(_document_counts(bits), "bucket long, toxic long, clean long").groupBy("bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    share = n[True] / (n[True] + n[False])
    both = F.col("toxic") + F.col("clean")
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (both * p))).otherwise(0.0)
    ratio = 2 * (part("toxic", share) + part("clean", 1 - share))
    counts, path = written(counts.select("bucket", ratio.alias("ratio")), "toxic-counts")  # `2**bits` rows at most
    least = 2 * np.log(max(1, counts.count())) + 2
    kept = counts.where(F.col("ratio") > least).orderBy(F.desc("ratio"), "bucket").collect()
    remove(rows.sparkSession, path)
    return [r["bucket"] for r in kept]


_LEFT = "bucket long, left double, spread double, n long, words long, toxic double, clean double"


def _left_over(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, size = Terms(machine.bits), 1 << machine.bits
        left, spread, n, words = np.zeros(size), np.zeros(size), np.zeros(size, np.int64), np.zeros(size, np.int64)
        sides = np.zeros((2, size))  # what toxic rows and clean rows that hold a whole word leave over
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, whole = cache.of(text), cache.whole(text)
                p = machine.of_buckets(found)
                at = np.fromiter(found, np.int64, len(found))
                left[at] += toxic - p
                spread[at] += p * (1 - p)
                n[at] += 1
                whole_at = np.fromiter(whole, np.int64, len(whole))
                words[whole_at] += 1
                sides[0 if toxic else 1, whole_at] += abs(toxic - p)
        at = np.flatnonzero(n)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(x[part]) for x in (left, spread, n, words, *sides))], ["bucket", "left", "spread", "n", "words", "toxic", "clean"])

    return run


def _holding(machine: Machine, words: list[int]):
    """Per row: which of the words it holds, as bits, what is left unexplained, and its spread."""
    place = {x: i for i, x in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Terms(machine.bits)
        for batch in batches:
            bits, left, spread = [], [], []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = np.zeros(len(words), np.uint8)
                row[[place[x] for x in cache.whole(text) if x in place]] = 1
                p = machine.of_buckets(cache.of(text))
                bits.append(np.packbits(row).tobytes())
                left.append(toxic - p)
                spread.append(p * (1 - p))
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), pa.array(left), pa.array(spread)], ["bits", "left", "spread"])

    return run


def _pairs(held, words: int, width: int, least: float):
    """Pairs of words of which the first is in a given run of `width`, with the square of what is left over its spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, left, spread = held.value
        for batch in batches:
            for begin in batch.column(0).to_pylist():
                own = slice(begin, min(words, begin + width))
                sums, spreads = (np.zeros((own.stop - own.start, words), np.float32) for _ in range(2))
                rows = max(16, (1 << 22) // words)
                for lo in range(0, len(bits), rows):
                    x = np.unpackbits(bits[lo : lo + rows], axis=1, count=words).astype(np.float32)
                    sums += (x[:, own] * left[lo : lo + rows, None]).T @ x
                    spreads += (x[:, own] * spread[lo : lo + rows, None]).T @ x
                told = sums**2 / (spreads + 1)
                told[np.arange(words)[None, :] <= np.arange(own.start, own.stop)[:, None]] = 0
                i, j = np.nonzero(told > least)
                yield pa.RecordBatch.from_arrays([pa.array(i + begin), pa.array(j), pa.array(told[i, j].astype(float))], ["i", "j", "told"])

    return run


def unexplained(rows: DataFrame, machine: Machine) -> list[int]:
    """Buckets that a fitted machine leaves something to, by themselves or in pairs, most telling first."""
    spark = rows.sparkSession
    sums = rows.mapInArrow(_left_over(machine), _LEFT).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("left", "spread", "n", "words", "toxic", "clean")])
    sums, path = written(sums, "toxic-left")  # `2**bits` rows at most
    told = (F.pow("left", F.lit(2)) / (F.col("spread") + 1)).alias("told")
    least = 2 * np.log(max(1, sums.count())) + 2
    alone = sums.where(~F.col("bucket").isin([*machine.index])).select("bucket", told).where(F.col("told") > least).orderBy(F.desc("told"), "bucket").collect()
    ranked = [r["bucket"] for r in alone]
    seen = sums.where("words > 0").count()
    floor = 2 * np.log(max(1, seen * (seen - 1) / 2)) + 2
    # a pair's sum squared is at most that of the larger side of either word, so below the limit no pair is missed
    able = F.greatest("toxic", "clean") > float(np.sqrt(floor))
    words = [r["bucket"] for r in sums.where(able & (told <= least)).select("bucket").orderBy("bucket").collect()]
    if len(words) > 1:
        table = rows.mapInArrow(_holding(machine, words), "bits binary, left double, spread double").toArrow()  # a bit a word and row of the sample
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        held = spark.sparkContext.broadcast((bits, *(table.column(c).to_numpy().astype(np.float32) for c in ("left", "spread"))))
        runs = spark.range(0, len(words), 128, 16)
        pairs = runs.mapInArrow(_pairs(held, len(words), 128, floor), "i long, j long, told double").orderBy(F.desc("told"), "i", "j").collect()
        held.destroy()
        ranked += [words[k] for r in pairs for k in (r["i"], r["j"])]
    remove(spark, path)
    return list(dict.fromkeys(ranked))


def _term_lists(bits: int, index: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Terms(bits, index)
        for batch in batches:
            lists = [[str(x) for x in sorted(cache.of(t))] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), pa.array(lists, pa.list_(pa.string()))], ["label", "terms"])

    return run


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 20,
    most_rows: int = 30_000, factors: int = 4, rounds: int = 120,
) -> Machine:
    """Learns from the documents that `labels` marks; both should hold training rows only."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("toxic"))
    rate = min(1.0, most_rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("toxic")), F.lit(1 << 24)) / float(1 << 24)
    chosen = known.where(draw < rate)  # about `most_rows` rows of an id and a label, so it may be broadcast
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).select(F.col("toxic").cast("int").alias("toxic"), "text")
    rows, path = written(rows, "toxic-sample")  # about `most_rows` rows
    index = {x: i for i, x in enumerate(screened(rows, bits))}
    n = {bool(r[0]): r[1] for r in rows.groupBy("toxic").count().collect()}
    share = n.get(True, 0) / max(1, sum(n.values()))
    machine = Machine(bits, {}, float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(0), np.zeros((0, factors)))
    if len(n) == 2:
        machine = _fit(rows, machine, index, factors, rounds)
        added = [x for x in unexplained(rows, machine) if x not in index]
        if added:
            machine = _fit(rows, machine, index | {x: len(index) + i for i, x in enumerate(added)}, factors, rounds)
    remove(rows.sparkSession, path)
    return machine


def _fit(rows: DataFrame, prior: Machine, index: dict[int, int], factors: int, rounds: int) -> Machine:
    """A machine over the buckets of `index`; `prior` where there are none."""
    if not index:
        return prior
    lists, path = written(rows.mapInArrow(_term_lists(prior.bits, index), "label double, terms array<string>"), "toxic-terms")
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(index))], "terms", "features")
    vectors.setBinary(True)
    learner = FMClassifier(
        factorSize=factors, maxIter=rounds, stepSize=0.1, solver="adamW", regParam=1e-4, miniBatchFraction=1.0, initStd=0.05, seed=11, tol=1e-5
    )
    fitted = learner.fit(vectors.transform(lists).select("label", "features").coalesce(8))
    remove(rows.sparkSession, path)
    return Machine(prior.bits, index, float(fitted.intercept), fitted.linear.toArray(), fitted.factors.toArray())


def _scorer(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine.value
        cache, none = Terms(m.bits, m.index), m.probability(set())
        for batch in batches:
            found = map(cache.of, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.probability(x) if x else none for x in found], pa.float64())], ["_id", "score"])

    return run


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(_scorer(shared), f"_id {kind}, score double")
    return found.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
