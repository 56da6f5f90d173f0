"""Language identification by interpolated Kneser-Ney character models.

One character model a language, over the letters of words with word start and end marked. Counts, continuation counts,
discounts and back-off weights are aggregated in Spark from a bounded sample of labelled documents (`most_docs` a
language, drawn by a hash of the id; whole texts). The models are stored side by side as sorted arrays of n-gram hashes,
with one column of probabilities a language; tasks look words up by binary search and remember words seen before.

A document gets the language of the lowest cross-entropy per symbol. A tenth of the sample is kept out of the counts and
calibrates two things, on the whole documents and on their beginnings of several lengths: the temperature that turns differences
of cross-entropy into the probability `score`, and how far above its language's median a document's cross-entropy may lie, by
language and length. That limit is a quantile of the held-out values: their 90 and 99 % quantiles carried on to a rate of
`REJECTED` by an exponential tail, and no less than the largest of them. A document above the limit of the chosen language is not
`accepted`, nor is one that is hardly more likely than letters drawn at random. A language or length with few held-out values takes
the limits of all languages together; where these are few too, nothing is rejected.

Defined results: null texts and texts without a letter get `und`, score 0 and are not accepted; ties go to the language
first by code point; rows with null language or text teach nothing; without any labelled row every document gets `und`;
very long texts are read whole, some words at a time; repeated rows get equal results; other columns are ignored.

The models are broadcast, as a table of n-grams by languages. Its size is bounded by the sample for few languages, but grows with
the square of their number, so it is checked: beyond `MOST_BYTES` training raises an error that says so.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import written

START, END = "\x02", "\x03"
LETTERS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
MOST_BYTES = 1 << 30
#: The rate of a language's own documents that is to be rejected, characters of the beginnings that are measured, classes of
#: length (by powers of four symbols), and held-out values that a class must have.
REJECTED, BEGINNINGS, CLASSES, FEWEST = 1e-6, (8, 32, 128, 512, 2048), 8, 20


@dataclass
class Level:
    """Sorted hashes of the k-grams; per language the discounted probability, and the back-off weight as a context."""

    keys: np.ndarray
    alpha: np.ndarray
    gamma: np.ndarray


@dataclass
class Models:
    langs: list[str]
    levels: list[Level]
    floor: np.ndarray
    temperature: float = 1.0
    #: Per language: median cross-entropy of its own documents, and how far above it is accepted, by class of length.
    centre: np.ndarray | None = None
    limits: np.ndarray | None = None
    #: The part of the held-out documents that their own limits reject.
    rejected: float = 0.0



def words_of(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return LETTERS.findall(text)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k codes that end at each position; the first k - 1 are meaningless."""
    h = np.zeros(len(codes), np.uint64)
    for back in range(k - 1, -1, -1):
        shifted = codes if back == 0 else np.concatenate((np.zeros(back, np.uint64), codes[:-back]))[: len(codes)]
        h = (h ^ shifted) * _MIX
        h ^= h >> np.uint64(29)
    return h


def score_words(words: list[str], models: Models) -> np.ndarray:
    """Per word: the sum of log probabilities under each language, then the number of symbols."""
    letters = [w if w.isalpha() else "".join(c for c in w if c.isalpha()) for w in words]
    codes = np.frombuffer("".join(f"{START}{w}{END}" for w in letters).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, letters), np.int64, len(letters)) + 2
    ends = np.cumsum(lengths)
    place = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)  # 0 at a word's start
    width = len(models.langs)
    p = np.tile(models.floor, (len(codes), 1))
    weight: np.ndarray | None = None  # back-off weight of the gram before each position
    for k, level in enumerate(models.levels, 1):
        h = gram_hashes(codes, k)
        at = np.searchsorted(level.keys, h)
        at[at == len(level.keys)] = 0
        known = (level.keys[at] == h) & (place >= k - 1)
        alpha = np.where(known[:, None], level.alpha[at], 0)
        gamma = np.where(known[:, None], level.gamma[at], 1)
        usable = place >= max(1, k - 1)
        backoff = p if weight is None else p * np.concatenate((np.ones((1, width)), weight[:-1]))
        p = np.where(usable[:, None], alpha + backoff, p)
        weight = gamma
    logs = np.log(p)
    logs[place == 0] = 0
    out = np.zeros((len(words), width + 1))
    out[:, :width] = np.add.reduceat(logs, ends - lengths, axis=0)
    out[:, width] = lengths - 1
    out[lengths == 2] = 0  # no letter
    return out


class WordScores(dict):
    """Rows of word scores, kept for words seen before; emptied at `most` words."""

    def __init__(self, models: Models, most: int = 200_000):
        super().__init__()
        self.models, self.most, self.fresh = models, most, []
        self.rows = np.zeros((0, len(models.langs) + 1))
        self.used = 0

    def __missing__(self, word: str) -> int:
        self[word] = at = self.used + len(self.fresh)
        self.fresh.append(word)
        return at

    def totals(self, texts: list[str | None] | pa.Array) -> np.ndarray:
        """Per text: the sums of its words' rows. Only one text and its words are held at a time beside what is given."""
        out = np.zeros((len(texts), len(self.models.langs) + 1))
        for i, text in enumerate(texts):
            text = text.as_py() if isinstance(text, pa.Scalar) else text  # noqa: PLW2901
            words = words_of(text) if text else []
            for start in range(0, len(words), 1 << 17):
                part = words[start : start + (1 << 17)]
                ids = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
                if self.fresh:
                    self._learn()
                out[i] += self.rows[ids].sum(axis=0)
                if len(self) > self.most:
                    self.clear()
                    self.used = 0
        return out

    def _learn(self) -> None:
        need = self.used + len(self.fresh)
        if need > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros((max(need - len(self.rows), len(self.rows) + 1024), self.rows.shape[1]))))
        for start in range(0, len(self.fresh), 4096):
            part = self.fresh[start : start + 4096]
            self.rows[self.used + start : self.used + start + len(part)] = score_words(part, self.models)
        self.used = need
        self.fresh = []


def entropies(texts: list[str | None] | pa.Array, scores: WordScores) -> tuple[np.ndarray, np.ndarray]:
    """Per text: cross-entropy a symbol under each language, and the number of symbols."""
    totals = scores.totals(texts)
    n = totals[:, -1]
    return -totals[:, :-1] / np.maximum(n, 1)[:, None], n


def decide(xent: np.ndarray, n: np.ndarray, models: Models) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen language, probability, and whether the cross-entropy is within that language's range."""
    best = xent.argmin(axis=1)
    least = xent[np.arange(len(xent)), best]
    odds = np.exp(-np.minimum((xent - least[:, None]) * n[:, None] * models.temperature, 700))
    at = np.clip((np.log2(np.maximum(n, 1)) - 1) / 2, 0, CLASSES - 1)  # between the middles of two classes
    lower, part = at.astype(int), at - at.astype(int)
    above = np.minimum(lower + 1, CLASSES - 1)
    wide = np.where(part > 0, models.limits[best, lower] * (1 - part) + models.limits[best, above] * part, models.limits[best, lower])
    room = np.log(len(models.levels[0].keys) + 1) - models.centre[best]  # up to letters drawn at random
    known = np.isfinite(models.centre[best])
    with np.errstate(invalid="ignore"):
        fits = least <= models.centre[best] + np.minimum(wide, 0.9 * room)
    return best, np.where(n > 0, 1 / odds.sum(axis=1), 0), (n > 0) & (fits | ~known)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in words_of(text):
                held[lang, w] = held.get((lang, w), 0) + 1
        pairs = [(lang, c, n) for (lang, w), n in held.items() if (c := w if w.isalpha() else "".join(filter(str.isalpha, w)))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in pairs], pa.string()), pa.array([x[1] for x in pairs], pa.string()), pa.array([x[2] for x in pairs], pa.int64())],
            ["lang", "word", "n"],
        )


def model_tables(words: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Interpolated Kneser-Ney tables from word counts (lang, word, n): (lang, k, gram, alpha) and (lang, k, gram, gamma)."""
    marked = words.select("lang", "n", F.concat(F.lit(START), "word", F.lit(END)).alias("w"))
    ends = F.explode(F.sequence(F.lit(2), F.length("w"))).alias("e")
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(order), "e"))).alias("k")
    raw = (
        marked.select("lang", "n", "w", ends)
        .select("lang", "n", "w", "e", sizes)
        .select("lang", "k", F.expr("substring(w, e - k + 1, k)").alias("gram"), "n")
        .groupBy("lang", "k", "gram")
        .agg(F.sum("n").alias("c"))
    )
    follows = raw.where("k > 1").groupBy("lang", (F.col("k") - 1).alias("k"), F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    whole = (F.col("k") == order) | F.startswith("gram", F.lit(START))
    counts, _ = written(raw.where(whole).unionByName(follows.where(~whole)), "lang-grams")  # bounded by the sample, read five times
    ones = F.sum((F.col("c") == 1).cast("long"))
    twos = F.sum((F.col("c") == 2).cast("long"))
    discount = counts.groupBy("lang", "k").agg(F.coalesce((ones + 0.5) / (ones + 2 * twos + 1), F.lit(0.5)).alias("d"))
    context = F.expr("substring(gram, 1, k - 1)").alias("ctx")
    sums = counts.groupBy("lang", "k", context).agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("types")).join(discount, ["lang", "k"])
    alpha = counts.select("lang", "k", "gram", "c", context).join(sums, ["lang", "k", "ctx"]).select("lang", "k", "gram", ((F.col("c") - F.col("d")) / F.col("s")).alias("v"))
    gamma = sums.select("lang", (F.col("k") - 1).alias("k"), F.col("ctx").alias("gram"), (F.col("d") * F.col("types") / F.col("s")).alias("v"))
    return alpha, gamma


def _hash_strings(grams: list[str], k: int) -> np.ndarray:
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return gram_hashes(codes, k)[k - 1 :: k] if k else np.zeros(len(grams), np.uint64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, k, kind, v, grams = batch.columns
        sizes, h = k.to_numpy(), np.zeros(batch.num_rows, np.uint64)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            h[at] = _hash_strings(grams.take(pa.array(at)).to_pylist(), size)
        yield pa.RecordBatch.from_arrays([lang, k, kind, v, pa.array(h.view(np.int64))], ["lang", "k", "kind", "v", "hash"])


def sampled(labelled: DataFrame, lang_col: str, id_col: str, most_docs: int) -> DataFrame:
    """About `most_docs` documents a language, by a hash of the id."""
    rates = {r[0]: min(1.0, most_docs / r[1]) for r in labelled.groupBy(lang_col).count().collect()}
    if not rates:
        return labelled
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 24)) / float(1 << 24)
    rate = F.create_map(*[x for lang, r in rates.items() for x in (F.lit(lang), F.lit(r))])[F.col(lang_col)]
    return labelled.where(draw < rate)


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 5, most_docs: int = 4000
) -> Models:
    """Models from labelled rows; learns only from the text and the label."""
    rows = sampled(labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()), lang_col, id_col, most_docs)
    aside = F.pmod(F.xxhash64(F.col(id_col), F.lit("aside")), F.lit(10)) == 0
    named = lambda df: df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    words = named(rows.where(~aside)).mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words, _ = written(words, "lang-words")
    alpha, gamma = model_tables(words, order)
    rows_of, _ = written(alpha.withColumn("kind", F.lit(0)).unionByName(gamma.withColumn("kind", F.lit(1))), "lang-tables")
    size = rows_of.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("lang").alias("langs"), F.coalesce(F.sum(F.octet_length("gram") + 40), F.lit(0)).alias("bytes")).first()
    if (need := max(8 * size["rows"] * size["langs"], size["bytes"])) > MOST_BYTES:
        raise ValueError(f"models of {size['langs']} languages may take {need >> 20} MB, more than {MOST_BYTES >> 20}: lower most_docs or order")
    # bounded by the sample, and checked; its order does not matter. Tasks hash the n-grams, so the driver holds numbers alone
    table = rows_of.select("lang", "k", "kind", "v", "gram").mapInArrow(_hashed, "lang string, k int, kind int, v double, hash long").toArrow()
    coded = table.column("lang").dictionary_encode().combine_chunks()
    coded = coded if isinstance(coded, pa.DictionaryArray) else pa.array([], pa.string()).dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    lang = np.array([langs.index(x) for x in names], np.int32)[coded.indices.to_numpy()] if names else np.zeros(0, np.int32)
    k, kind, v, hashes = (table.column(c).to_numpy() for c in ("k", "kind", "v", "hash"))
    del table, coded
    levels = []
    for size in range(1, order + 1):
        at = np.flatnonzero(k == size)
        keys, row = np.unique(hashes[at].view(np.uint64), return_inverse=True)
        a, g = np.zeros((len(keys), len(langs)), np.float32), np.ones((len(keys), len(langs)), np.float32)
        own = kind[at] == 0
        a[row[own], lang[at][own]] = v[at][own]
        g[row[~own], lang[at][~own]] = v[at][~own]
        levels.append(Level(keys, a, g))
    # the unigram level backs off to a uniform distribution over all symbols seen and one for the rest
    floor = np.ones(len(langs))
    base = (k == 0) & (kind == 1)
    floor[lang[base]] = v[base]
    floor /= int((levels[0].alpha > 0).any(axis=1).sum()) + 1
    models = Models(langs, levels, floor)
    return calibrated(models, named(rows.where(aside))) if langs else models


def _measure(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(models.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for size in (None, *BEGINNINGS):
                at = [i for i, t in enumerate(texts) if size is None or len(t) > size]
                xent, n = entropies([texts[i][:size] for i in at], scores)
                whole = pa.array([size is None] * len(at), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(list(xent), pa.list_(pa.float64())), pa.array(n), whole], ["lang", "xent", "n", "whole"])

    return run


def tail_limit(values: np.ndarray) -> float:
    """The value that a share of `REJECTED` lies above: an exponential tail through two quantiles, and no less than the largest value."""
    q90, q99 = np.quantile(values, (0.9, 0.99))
    return float(max(values.max(), q99 + (q99 - q90) / np.log(10) * np.log(0.01 / REJECTED)))


def length_class(n: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(n, 1)) // 2, 0, CLASSES - 1).astype(int)


def limits_by_length(excess: np.ndarray, n: np.ndarray, otherwise: np.ndarray | None) -> np.ndarray:
    """Limits by class of length, never wider for longer texts; `otherwise`, or that of the next class that has one, where values are few."""
    of, found = length_class(n), np.full(CLASSES, np.nan)
    for c in range(CLASSES):
        if (of == c).sum() >= FEWEST:
            found[c] = tail_limit(excess[of == c])
        elif otherwise is not None:
            found[c] = otherwise[c]
    known = np.flatnonzero(np.isfinite(found))
    if not len(known):
        return np.full(CLASSES, np.inf)
    nearest = known[np.abs(known[None, :] - np.arange(CLASSES)[:, None]).argmin(axis=1)]
    return np.maximum.accumulate(found[nearest][::-1])[::-1]


def calibrated(models: Models, aside: DataFrame) -> Models:
    """Temperature, and each language's limits of cross-entropy, from labelled documents that were not counted."""
    shared = aside.sparkSession.sparkContext.broadcast(models)
    # a tenth of the sample: six rows of a few numbers a document
    seen = aside.mapInArrow(_measure(shared), "lang string, xent array<double>, n double, whole boolean").where("n > 0").toArrow()
    shared.destroy()
    width = len(models.langs)
    xent = np.concatenate([np.zeros(0), *(part.flatten().to_numpy() for part in seen.column("xent").chunks)]).reshape(-1, width)
    n, whole = seen.column("n").to_numpy(), np.array(seen.column("whole").to_pylist(), bool)
    own = np.array([models.langs.index(x) if x in models.langs else -1 for x in seen.column("lang").to_pylist()], int)
    xent, n, whole, own = xent[own >= 0], n[own >= 0], whole[own >= 0], own[own >= 0]
    models.centre, models.limits = np.full(width, np.nan), np.full((width, CLASSES), np.inf)
    if not len(own):
        return models
    gap = (xent - xent.min(axis=1, keepdims=True)) * n[:, None]
    losses = []
    for t in (grid := np.geomspace(0.01, 30, 61)):
        odds = np.exp(-np.minimum(gap * t, 700))
        share = (odds / odds.sum(axis=1, keepdims=True))[np.arange(len(own)), own]
        losses.append(-np.log(np.maximum(share, 1e-12)).mean())
    losses = np.array(losses)
    models.temperature = float(grid[np.flatnonzero(losses <= losses.min() * 1.001 + 1e-6)[0]])
    mine = xent[np.arange(len(own)), own]
    for i in range(width):
        if (at := (own == i) & whole).any():
            models.centre[i] = np.median(mine[at])
    known = np.isfinite(models.centre[own])
    excess = mine[known] - models.centre[own[known]]
    pooled = limits_by_length(excess, n[known], None)
    for i in range(width):
        at = own[known] == i
        models.limits[i] = limits_by_length(excess[at], n[known][at], pooled)
    decided = decide(xent[whole], n[whole], models)
    models.rejected = float((~decided[2]).mean()) if whole.any() else 0.0
    return models


def _identifier(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = models.value
        names = np.array([*own.langs, "und"], object)
        scores = WordScores(own) if own.langs else None
        for batch in batches:
            size = batch.num_rows
            if scores is None:
                lang, score, ok, least = np.full(size, "und", object), np.zeros(size), np.zeros(size, bool), np.zeros(size)
            else:
                xent, n = entropies(batch.column(1), scores)
                best, score, ok = decide(xent, n, own)
                lang, least = names[np.where(n > 0, best, len(own.langs))], xent.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(ok), pa.array(least)], ["_id", "lang_pred", "score", "accepted", "cross_entropy"]
            )

    return run


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, accepted, cross_entropy. Reads the whole text and nothing else."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(_identifier(shared), f"_id {kind}, lang_pred string, score double, accepted boolean, cross_entropy double")
    return found.withColumnRenamed("_id", id_col)


def _accepting(models, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = models.value
        scores = WordScores(own) if own.langs else None
        for batch in batches:
            if scores is None:
                yield batch.slice(0, 0)
                continue
            xent, n = entropies(batch.column(text_at), scores)
            yield batch.filter(pa.array(decide(xent, n, own)[2]))

    return run


def keep_accepted(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows whose language is accepted, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return docs.mapInArrow(_accepting(shared, docs.columns.index(text_col)), docs.schema)
