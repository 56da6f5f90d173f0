"""Language-model scoring: an interpolated modified Kneser-Ney bigram model over all training texts.

Tasks count bigrams of hashed words over blocks of text and deal them out by the leading bits of both hashes, so that one
task adds up all counts of a bigram and files it at once. Rows travel packed, many to a message. Two tables come of it: per
word its count, its number of different predecessors and how many bigrams it begins of each count; per bigram its count.
Both are written to the shared folder as arrays sorted by hash, cut into shards by the leading bits of the hash; of bigrams
seen once, the hashes alone. Scoring tasks map these files into memory, `MAPS` of them at most at a time, so they hold only
the pages they touch, whatever the model's size; this needs a shared folder that is mounted on every machine. Without
`singles`, bigrams seen once are counted in every statistic, but not stored: their mass goes to the back-off weight of
their first word, so probabilities add up to one either way.

    P(w | v) = [(v,w) is stored] (c(v,w) - D(c)) / c(v)  +  b(v) P(w)
    P(w)     = (k(w) - D'(k)) / K  +  b' / (types + 1),    k(w): different words before w, K: their sum

Defined results: null and blank texts are the end token alone; very long texts are counted and scored whole; repeated rows
are counted and scored like any other; an empty training set gives every token probability 1; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import mounted, publish, scratch

#: Neither is a word: words have no white space and are not empty.
FIRST, LAST = np.uint64(xxhash.xxh64_intdigest(b"\n")), np.uint64(xxhash.xxh64_intdigest(b""))
#: Tokens that are counted together before Spark adds up; bounds a task's memory.
BLOCK = 2_000_000
#: Shards are numbered by at most so many leading bits of a hash.
MOST_BITS = 20
#: Files that a task maps at once.
MAPS = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LEADING = np.uint64(((1 << MOST_BITS) - 1) << (64 - MOST_BITS))


class Hashes(dict):
    """Word hashes, kept for words seen before."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def tokens(text: bytes | None, hashes: Hashes) -> np.ndarray:
    """Hashes of the words of a text, and the end token."""
    words = (text or b"").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out[-1] = LAST
    return out


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash of a bigram; its leading bits are those of v ^ w, which bigrams are dealt out by."""
    h = (v ^ (v >> np.uint64(31))) * _MIX + w
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((v ^ w) & _LEADING) | ((h ^ (h >> np.uint64(32))) >> np.uint64(MOST_BITS))


def _before(t: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The token before each token; the start mark at a document's first."""
    v = np.concatenate(([FIRST], t[:-1]))
    v[np.cumsum(lengths)[:-1]] = FIRST
    return v


#: Columns of the two kinds of messages: bigrams, and what a task knows of a word: bigrams it begins of count 1, 2, and 3 or
#: more, bigrams it ends, how often it stands.
_BIGRAMS = (("v", "<u8"), ("w", "<u8"), ("n", "<u4"))
_WORDS = (("word", "<u8"), ("one", "<u8"), ("two", "<u8"), ("three", "<u8"), ("kinds", "<u8"), ("count", "<u8"))
_MESSAGE = "part int, n int, packed binary"


def _packed(part: np.ndarray, columns: list[np.ndarray], layout) -> pa.RecordBatch:
    """Rows in the order of their parts as one message a part."""
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(part))
    columns = [c.astype(kind, copy=False) for c, (_, kind) in zip(columns, layout, strict=True)]
    data = [pa.compress(b"".join(c[lo:hi].tobytes() for c in columns), "zstd", asbytes=True) for lo, hi in zip(cuts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array((ends - cuts).astype(np.int32)), pa.array(data, pa.binary())], ["part", "n", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch], layout) -> list[np.ndarray] | None:
    """The columns of all messages together; None without any."""
    held: list[list[np.ndarray]] = []
    width = sum(np.dtype(kind).itemsize for _, kind in layout)
    for batch in batches:
        for n, packed in zip(batch.column("n").to_pylist(), batch.column("packed"), strict=True):
            data, at = pa.decompress(packed.as_buffer(), n * width, "zstd"), 0
            row = []
            for _, kind in layout:
                row.append(np.frombuffer(data, kind, n, at))
                at += n * np.dtype(kind).itemsize
            held.append(row)
    return [np.concatenate(x) for x in zip(*held, strict=True)] if held else None


def _part(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def _count_block(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different bigrams of some texts and their counts."""
    w = np.concatenate(docs)
    v = _before(w, np.fromiter(map(len, docs), np.int64, len(docs)))
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    at = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
    return v[at], w[at], np.diff(np.append(at, len(w)))


def _counter(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt() -> pa.RecordBatch:
            v, w, n = _count_block(held)
            part = _part(v ^ w, bits)
            order = np.argsort(part, kind="stable")
            return _packed(part[order], [v[order], w[order], n[order]], _BIGRAMS)

        hashes, held, size = Hashes(), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(tokens(text.as_py(), hashes))
                size += len(held[-1])
                if size >= BLOCK:
                    yield dealt()
                    held, size = [], 0
        if held:
            yield dealt()

    return run


def bigram_counts(training: DataFrame, bits: int, text_col: str = "text") -> DataFrame:
    """Messages of bigrams and their counts in each block of texts, by the leading bits of both hashes."""
    return training.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(_counter(bits), _MESSAGE)


def _sums(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    keys, at = np.unique(key, return_inverse=True)
    return keys, [np.bincount(at, weights=x, minlength=len(keys)).astype(np.uint64) for x in values]


def _file_bigrams(folder: str, bits: int, singles: bool):
    """Adds up a part's bigrams and files them; gives what it knows of their words, and in part -1 the numbers of counts 1 to 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (columns := _unpacked(batches, _BIGRAMS)) is None:
            return
        v, w, n = columns
        key = pair_hash(v, w)
        order = np.argsort(key)
        key, v, w, n = key[order], v[order], w[order], n[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
        key, v, w, n = key[at], v[at], w[at], np.add.reduceat(n, at)
        part = int(_part(key[:1], bits)[0])
        for name, stored in (("bigrams", n >= 2), ("singles", (n == 1) & singles)):
            rows = np.zeros(int(stored.sum()), _KINDS[name])
            rows["key"] = key[stored]
            if name == "bigrams":
                rows["count"] = n[stored]
            if len(rows):
                publish(f"{folder}/{name}-{part}", _columns(rows))
        none = np.zeros(len(v))
        words, known = _sums(np.concatenate((v, w)), [np.concatenate(x) for x in ((n == 1, none), (n == 2, none), (n >= 3, none), (none, none + 1), (none, n))])
        yield _packed(_part(words, bits), [words, *known], _WORDS)
        sizes = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
        yield _packed(np.full(1, -1), [np.zeros(1), *(sizes[k : k + 1] for k in range(4)), np.zeros(1)], _WORDS)

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    if n[0] == 0 or n[1] == 0:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    third = 3 - 4 * y * n[3] / n[2] if n[2] else 1.5
    return np.clip([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], third], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


@dataclass
class Model:
    """Where the arrays are, and the numbers that all tasks need."""

    folder: str
    bits: int
    n: float
    types: float
    kinds: float
    first: float
    bigram_discount: np.ndarray
    word_discount: np.ndarray
    rest: float
    singles: bool
    maps: dict = field(default_factory=dict, repr=False)

    def taken(self) -> np.ndarray:
        """What a bigram of count 0, 1, 2, and 3 or more leaves to the back-off: all of it where it is not stored."""
        d = self.bigram_discount
        return d if self.singles else np.array([0, 1, d[2], d[3]])

    def shard(self, name: str, k: int) -> dict[str, np.ndarray]:
        """Read-only maps of the columns of a shard; no rows if nothing was filed there. The map used longest ago gives way."""
        if (held := self.maps.pop((name, k), None)) is None:
            path, kind = f"{self.folder}/{name}-{k}", _KINDS[name]
            n = os.path.getsize(path) // kind.itemsize if os.path.exists(path) else 0
            whole = np.memmap(path, np.uint8, "r") if n else np.zeros(0, np.uint8)
            held, at = {}, 0
            for column in kind.names:
                width = kind[column].itemsize * n
                held[column] = whole[at : at + width].view(kind[column])
                at += width
            if len(self.maps) >= MAPS:
                self.maps.pop(next(iter(self.maps)))
        self.maps[name, k] = held
        return held

    def look_up(self, name: str, keys: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
        """Values for ascending distinct keys, 1 for a column that is not stored; 0 where a key is absent."""
        found = [np.zeros(len(keys)) for _ in columns]
        marks = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], marks[1:] != marks[:-1]))) if len(keys) else np.zeros(0, np.int64)
        for lo, hi in zip(starts, np.append(starts[1:], len(keys)), strict=True):
            table = self.shard(name, int(marks[lo]))
            if not len(table["key"]):
                continue
            at = np.searchsorted(table["key"], keys[lo:hi])
            at[at == len(table["key"])] = 0
            same = table["key"][at] == keys[lo:hi]
            for out, c in zip(found, columns, strict=True):
                out[lo:hi] = np.where(same, table[c][at] if c in table else 1, 0)
        return found


_KINDS = {
    "words": np.dtype([("key", "<u8"), ("count", "<u8"), ("kinds", "<u8"), ("one", "<u4"), ("two", "<u4"), ("three", "<u4")]),
    "bigrams": np.dtype([("key", "<u8"), ("count", "<f4")]),
    "singles": np.dtype([("key", "<u8")]),
}
_FIELDS = ("n1", "n2", "n3", "n4", "n3p", "types", "n", "kinds", "b1", "b2", "b3", "b4")


def _file_words(folder: str, bits: int):
    """Adds up a part's words and files them; gives numbers for the discounts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = dict.fromkeys(_FIELDS, 0.0)
        parts: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for k in set(batch.column("part").to_pylist()):
                parts.setdefault(k, []).append(batch.filter(pa.array([x == k for x in batch.column("part").to_pylist()])))
        for part, own in parts.items():
            key, *values = _unpacked(iter(own), _WORDS)
            if part < 0:
                for name, x in zip(("b1", "b2", "b3", "b4"), values, strict=False):
                    found[name] += float(x.sum())
                continue
            key, (one, two, three, kinds, count) = _sums(key, values)
            rows = np.zeros(len(key), _KINDS["words"])
            for name, x in (("key", key), ("count", count), ("kinds", kinds), ("one", one), ("two", two), ("three", three)):
                rows[name] = x
            publish(f"{folder}/words-{part}", _columns(rows))
            for k in (1, 2, 3, 4):
                found[f"n{k}"] += float((kinds == k).sum())
            for name, x in (("n3p", kinds >= 3), ("types", count > 0), ("n", count), ("kinds", kinds)):
                found[name] += float(x.sum())
        yield pa.RecordBatch.from_arrays([pa.array([found[c]]) for c in _FIELDS], list(_FIELDS))

    return run


def _columns(rows: np.ndarray) -> bytes:
    """A shard's file: each column in turn."""
    return b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names)


def train(training: DataFrame, text_col: str = "text", entries: int = 2_000_000, singles: bool = True) -> Model:
    """Counts all rows and files the model. `entries`: about how many tokens a writing task gets, which bounds its memory."""
    spark = training.sparkSession
    size = training.agg(F.count(F.lit(1)).alias("texts"), F.sum(F.octet_length(F.col(text_col).cast("binary"))).alias("bytes")).first()
    about = size["texts"] + (size["bytes"] or 0) / 6  # six bytes a word
    bits = min(MOST_BITS, max(2, int(np.ceil(np.log2(max(2.0, about / entries))))))
    folder = mounted(scratch(spark, "lm-model"))
    filed = bigram_counts(training, bits, text_col).repartitionById(1 << bits, "part").mapInArrow(_file_bigrams(folder, bits, singles), _MESSAGE)
    # the numbers of counts (part -1) go along with the first words
    words = filed.repartitionById(1 << bits, F.greatest("part", F.lit(0))).mapInArrow(_file_words(folder, bits), ", ".join(f"{c} double" for c in _FIELDS))
    s = words.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in _FIELDS]).first()
    d, e = (discounts(np.array([s[f"{c}{k}"] for k in (1, 2, 3, 4)])) for c in "bn")
    rest = e[1] * s["n1"] + e[2] * s["n2"] + e[3] * s["n3p"]
    return Model(folder, bits, s["n"], s["types"], s["kinds"], float(size["texts"]), d, e, rest, singles)


def score_texts(texts: list[np.ndarray], m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text (token hashes): tokens, known tokens, base score, score."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    w = np.concatenate(texts)
    v = _before(w, lengths)
    seen, at = np.unique(np.append(w, FIRST), return_inverse=True)
    count, kinds, *begun = m.look_up("words", seen, ("count", "kinds", "one", "two", "three"))
    backoff = sum(d * n for d, n in zip(m.taken()[1:], begun, strict=True))
    followed = np.where(seen == FIRST, m.first, count)  # a word is followed by something each time it occurs, the start mark in each text
    weight = np.where(followed > 0, backoff / np.maximum(followed, 1), 1.0)
    lower = (kinds - m.word_discount[np.minimum(kinds, 3).astype(int)] + m.rest / (m.types + 1)) / m.kinds if m.kinds else np.ones(len(seen))
    base = np.log10((count + 0.5) / (m.n + 0.5 * (m.types + 1)))
    second = at[:-1]
    first = np.concatenate(([at[-1]], second[:-1]))
    first[np.cumsum(lengths)[:-1]] = at[-1]
    pairs, of = np.unique(pair_hash(v, w), return_inverse=True)
    (c,) = m.look_up("bigrams", pairs, ("count",))
    c[c == 0] = m.look_up("singles", pairs[c == 0], ("present",))[0]
    c = c[of]
    p = np.maximum(c - m.bigram_discount[np.minimum(c, 3).astype(int)], 0) / np.maximum(followed[first], 1) + weight[first] * lower[second]
    starts = np.cumsum(lengths) - lengths
    add = lambda x: np.add.reduceat(x, starts)
    return lengths, add((count > 0)[second].astype(np.int64)), add(base[second]), add(np.log10(p))


def _scorer(model: Model, block: int = 500_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            ids, held, size, begun = batch.column(0), [], 0, 0
            for k, text in enumerate(batch.column(1)):
                held.append(tokens(text.as_py(), hashes))
                size += len(held[-1])
                if size >= block or k == batch.num_rows - 1:
                    columns = score_texts(held, model)
                    yield pa.RecordBatch.from_arrays([ids[begun : k + 1], *map(pa.array, columns)], ["_id", "n_tokens", "n_known", "base_score", "score"])
                    held, size, begun = [], 0, k + 1

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, base_score, score, perplexity."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(_scorer(model), f"_id {kind}, n_tokens long, n_known long, base_score double, score double")
    perplexity: Column = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return found.withColumn("perplexity", perplexity).withColumnRenamed("_id", id_col)
