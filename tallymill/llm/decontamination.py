"""Benchmark decontamination by latent semantic retrieval.

Items and passages are TF-IDF vectors over the words of the benchmark; document frequencies come from all documents. A
randomised SVD (random range finder, power steps, tasks holding blocks of rows and sending small products) gives each word a
place in a latent space. Its rows are passages: the benchmark's own, which weigh `EMPHASIS` times, and all of all documents, `PASSAGE`
words each, which weigh alike and together as much as `TOGETHER` at most. The documents' rows are not kept: the SVD needs the sums of
products of each two words' weights alone, which one reading adds up for every `ROOM` pairs of words. A space is fitted for `rank` items at
most, has `rank` dimensions at most, fewer than there are passages, and the fewest that keep the share `energy` of every item's square
norm, so copies of an item reach the cosine limit however many items there are; more items take more spaces.

Every document is cut into passages at each of a few lengths (powers of two), half overlapping, and every passage is compared
by cosine to all items of about that length: the cosine alone says which pairs are candidates. These are then checked word
by word: the longest common subsequence of the item and the passage with its surroundings, as a share of the item. A
pair counts as a leak when that share reaches `verbatim`, or reaches `paraphrase` while most of the item's answer words, its
rarest ones, are there too. Pairs that have too few words in common for either are not run through.

The benchmark is a query set: it is taken in blocks of about `block` items or `block_words` words, and `PER_PASS` blocks at once, which
bounds what is sent to the tasks. For each pass all documents are read once, and the numbers of their words written; frequencies, sums over
passages (a reading a block) and `leaks` go by these numbers, `drop_leaking` reads its rows again. Items of one to three words are compared to as short passages. Letters of scripts that set no spaces count as words of their own.

Defined results: null and blank texts and items match nothing; repeated rows give repeated pairs for documents and one for
items; texts that share an id, or have none, are items of their own; of passages that match an item equally well the
first is reported; very long texts are read whole, in pieces that overlap by more than the longest stretch; an empty table
on either side gives an empty result; other columns are ignored by `leaks` and carried along by `drop_leaking`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallymill.llm.common import remove, written

#: Thai, Lao, Burmese and Khmer letters, kana and Chinese characters each stand for a word.
ALONE = r"฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
WORDS = re.compile(r"\w+")
PARTS = re.compile(rf"[{ALONE}]|[^\W{ALONE}]+")
#: The bytes that no character of `ALONE` begins with.
NARROW = bytes(range(0xE0))
#: Lower-cases ASCII and turns what cannot be in a word to spaces; other bytes stay.
PLAIN = bytes(ord(chr(c).lower()) if c < 128 and (chr(c).isalnum() or c == 95) else c if c >= 128 else 32 for c in range(256))
#: Words looked at together.
PIECE = 1 << 15
#: Words of the passages that the spaces are fitted on besides the items, what these weigh together at most, and what an item weighs.
PASSAGE, TOGETHER, EMPHASIS = 32, 2000.0, 4.0
#: Pairs of words that one reading of the documents adds up, and those that are sent together.
ROOM, TILE = 1 << 24, 1 << 16
#: Blocks of items that one reading of the documents serves.
PER_PASS = 8


def words_of(text: bytes | None) -> list[str]:
    """The words of a text in UTF-8."""
    if not text:
        return []
    return (PARTS if text.translate(None, NARROW) else WORDS).findall(text.decode("utf-8", "replace").lower())


class Numbers:
    """Numbers the words of texts: -1 for a word outside the benchmark."""

    def __init__(self, vocab: dict[str, int]):
        self.vocab, self.plain = vocab, {w.encode(): i for w, i in vocab.items() if w.isascii()}

    def of(self, text: bytes | None) -> np.ndarray:
        if text and not text.isascii():
            words = words_of(text)
            return np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, len(words))
        tokens = text.translate(PLAIN).split() if text else ()
        return np.fromiter(map(self.plain.get, tokens, repeat(-1)), np.int32, len(tokens))


def lcs(masks: dict[int, int], m: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item of m words (positions of each word as bits) and some words."""
    full = (1 << m) - 1
    v = full
    for w in words:
        if u := v & masks.get(w, 0):
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def scale_of(n: int) -> int:
    """The passage length that an item of n words is compared at: the next power of two."""
    return 1 << max(0, n - 1).bit_length()


@dataclass
class Space:
    """Some items of a block: `local` numbers their words (the last two entries: none, and a word outside the benchmark), `terms` places these (the last row: any other), `placed` their items from `first` on."""

    first: int
    local: np.ndarray
    terms: np.ndarray
    placed: np.ndarray


@dataclass
class Index:
    """What tasks need of a block of items: by word, by item, by scale, and the spaces that the items are dealt into."""

    vocab: dict[str, int]
    #: By word its inverse document frequency, then 0 for none, and the mean for a word outside the benchmark.
    weigh: np.ndarray
    ids: list[int | None]
    texts: list[str]
    lengths: np.ndarray
    masks: list[dict[int, int]]
    #: By item its words, in order, how often it has them, and its answer words.
    bags: list[tuple[np.ndarray, np.ndarray]]
    answers: list[np.ndarray]
    spaces: list[Space]
    space_of: np.ndarray
    #: By passage length the items that are compared at it.
    scales: dict[int, np.ndarray]
    #: By number of a word in `numbered` documents its number here; -1, as for the last entry, is none.
    renumber: np.ndarray


def _numbering(vocab, id_type: pa.DataType):
    count = pa.struct([("term", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, df, n = Numbers(vocab.value), np.zeros(len(vocab.value) + 1, np.int64), 0

        def rows(ids, held, counts):
            return pa.RecordBatch.from_arrays([ids, pa.array(held, pa.binary()), counts], ["_id", "words", "df"])

        for batch in batches:
            held, size, start = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                words = numbers.of(text.as_py())
                df[np.unique(words)] += 1  # the last entry: words outside the benchmark
                held.append(words.tobytes())
                size += len(words)
                if size >= 32 * PIECE:
                    yield rows(batch.column(0).slice(start, len(held)), held, pa.nulls(len(held), pa.list_(count)))
                    held, size, start = [], 0, k + 1
            n += batch.num_rows
            yield rows(batch.column(0).slice(start, len(held)), held, pa.nulls(len(held), pa.list_(count)))
        at = np.flatnonzero(df[:-1])
        both = pa.StructArray.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n))], fields=list(count))
        yield rows(pa.nulls(1, id_type), [None], pa.ListArray.from_arrays(pa.array([0, len(both)], pa.int32()), both))

    return run


def numbered(rows: DataFrame, vocab: dict[str, int]) -> tuple[DataFrame, str]:
    """Rows (_id, text in UTF-8) with the numbers of their words instead (`words`, -1 for one outside the benchmark), written; and the path.
    Rows with `df` and without words hold a task's counts of documents by word."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab)
    kind = rows.schema["_id"].dataType
    run = _numbering(shared, to_arrow_type(kind))
    return written(rows.mapInArrow(run, f"_id {kind.simpleString()}, words binary, df array<struct<term: int, n: long>>"), "latent-words")


def document_frequencies(words: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Documents with each word, and all documents."""
    counts = words.where("df is not null").select(F.inline("df")).groupBy("term").agg(F.sum("n").alias("n"))
    rows = {r["term"]: r["n"] for r in counts.collect()}  # one a word of the benchmark block
    return np.array([rows.get(i, 0) for i in range(size)], float), rows.get(-1, 0)


def _product(width: int, right: np.ndarray):
    """Tasks of one step of the range finder: the sums over rows a of a' (a right), as one matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, right.shape[1]))
        for batch in batches:
            for terms, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t, w = np.array(terms), np.array(weights)
                total[t] += np.outer(w, w @ right[t])
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["m"])

    return run


def pairs_at(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (b, a), a <= b, that the codes b (b + 1) / 2 + a stand for."""
    b = ((np.sqrt(8.0 * codes + 1) - 1) / 2).astype(np.int64)
    b -= b * (b + 1) // 2 > codes  # the root may be rounded
    b += (b + 1) * (b + 2) // 2 <= codes
    return b, codes - b * (b + 1) // 2


def _pair_product(width: int, right: np.ndarray, first: int, scale: float):
    """Like `_product`, over rows that are known by `PairSums` alone; `first`: the space's first tile, `scale`: what a row's square weighs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, right.shape[1]))
        for batch in batches:
            for tile, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b, a = pairs_at((tile - first) * TILE + np.arange(TILE))
                lo, hi, most = int(b[0]), min(int(b[-1]) + 1, width), int(a.max()) + 1
                dense, inside = np.zeros((hi - lo, min(most, width)), np.float32), b < width
                dense[b[inside] - lo, a[inside]] = np.frombuffer(sums.as_py(), np.float32)[inside]
                total[lo:hi] += scale * (dense @ right[: dense.shape[1]])
                at = np.arange(lo, min(hi, dense.shape[1]))
                dense[at - lo, at] = 0  # a pair of a word with itself counts once, others from both sides
                total[: dense.shape[1]] += scale * (dense.T @ right[lo:hi])
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["m"])

    return run


def randomised_svd(
    rows: DataFrame, width: int, rank: int, extra: int = 16, powers: int = 3, seed: int = 5, pairs: tuple[DataFrame, int, float] | None = None
) -> np.ndarray:
    """Right singular vectors (width x rank) of the sparse matrix whose rows are (terms, weights), and those that `pairs` sums up: the tiles
    of a space, the first one's number and what a row's square weighs."""
    k = min(rank + extra, width)
    q = np.random.default_rng(seed).standard_normal((width, k))
    values = np.ones(k)
    for _ in range(powers + 1):  # each step multiplies by A'A, summed over tasks, and orthonormalises
        right = q.astype(np.float32)
        parts = rows.mapInArrow(_product(width, right), "m binary")
        if pairs:
            parts = parts.unionByName(pairs[0].mapInArrow(_pair_product(width, right, *pairs[1:]), "m binary"))
        total = np.zeros((width, k))
        for part in parts.toLocalIterator():
            total += np.frombuffer(part["m"], np.float32).reshape(width, k)
        u, values, v = np.linalg.svd(total, full_matrices=False)
        q = u
    return q[:, : min(rank, int((values > values[0] * 1e-9).sum()))] if len(values) and values[0] > 0 else np.zeros((width, 1))


def _words(value) -> np.ndarray:
    """The numbers that `numbered` wrote."""
    return np.frombuffer(value.as_buffer(), np.int32)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """All passages of all documents, some at a time, as rows of `PASSAGE` words; -1 for a word outside the benchmark and after a document's end."""
    held, size = [], 0
    for batch in batches:
        for value in batch.column(0):
            words = _words(value)
            for at in range(0, len(words), PIECE):  # a piece takes whole passages
                part = words[at : at + PIECE]
                held += [part, np.full(-len(part) % PASSAGE, -1, np.int32)]
                size += len(part)
                if size >= PIECE:
                    yield np.concatenate(held).reshape(-1, PASSAGE)
                    held, size = [], 0
    if held:
        yield np.concatenate(held).reshape(-1, PASSAGE)


class PairSums:
    """Adds up the products of each two words' weights over passages, for the pairs with codes from `lo` to `hi`. `plots`: by space the code of
    its first pair, the local number of each word (the last entry: none) and the weight of each local word."""

    def __init__(self, plots: list[tuple[int, np.ndarray, np.ndarray]], lo: int, hi: int):
        self.lo, self.hi, self.sums = lo, hi, np.zeros(hi - lo)
        self.plots = [p for p in plots if p[0] < hi and p[0] + len(p[2]) * (len(p[2]) + 1) // 2 > lo]

    def add(self, passages: np.ndarray) -> None:
        for start, local, weigh in self.plots:
            ids = local[passages]
            ids.sort(axis=1)
            change = np.ones(ids.shape, bool)
            change[:, 1:] = ids[:, 1:] != ids[:, :-1]
            at = np.flatnonzero(change)
            term, times = ids.ravel()[at].astype(np.int64), np.diff(at, append=ids.size)
            known = term < len(weigh)
            term, row, times = term[known], at[known] // PASSAGE, times[known]
            w = times * weigh[term]
            w /= np.sqrt(np.bincount(row, w**2, minlength=len(ids)))[row]
            codes = start - self.lo + term * (term + 1) // 2
            for apart in range(PASSAGE):  # a passage's words ascend, so the later one has the larger number
                first = np.flatnonzero(row[apart:] == row[: len(row) - apart])
                if not len(first):
                    break
                code, product = codes[first + apart] + term[first], w[first] * w[first + apart]
                if self.lo or self.hi < start + len(weigh) * (len(weigh) + 1) // 2:
                    inside = (code >= 0) & (code < len(self.sums))
                    code, product = code[inside], product[inside]
                np.add.at(self.sums, code, product)

    def tiles(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.sums), TILE):
            part = np.zeros(TILE, np.float32)
            part[: len(self.sums) - at] = self.sums[at : at + TILE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([(self.lo + at) // TILE]), pa.array([part.tobytes()], pa.binary())], ["tile", "sums"])


def _pair_sums(shared, lo: int, hi: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = PairSums(shared.value, lo, hi)
        for passages in _passages(batches):
            sums.add(passages)
        yield from sums.tiles()

    return run


def _added(tiles: pa.Table) -> pa.Table:
    total = np.zeros(TILE)
    for part in tiles.column("sums"):
        total += np.frombuffer(part.as_py(), np.float32)
    return pa.table({"tile": tiles.column("tile")[:1], "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def pair_sums(words: DataFrame, plots: list[tuple[int, np.ndarray, np.ndarray]], end: int) -> DataFrame:
    """The sums of `PairSums` over all passages of `numbered` documents, as rows of `TILE` codes up to `end`. One reading for every `ROOM` codes."""
    context = words.sparkSession.sparkContext
    shared = context.broadcast(plots)
    # a task sends as much whatever it reads, so there are few
    dealt, parts = words.where("words is not null").select("words").coalesce(2 * context.defaultParallelism), None
    for lo in range(0, end, ROOM):
        part = dealt.mapInArrow(_pair_sums(shared, lo, min(end, lo + ROOM)), "tile long, sums binary")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("tile").applyInArrow(_added, "tile long, sums binary")


def _traces(plots: list[tuple[int, int]]):
    """Of tiles the sums over pairs of a word with itself, by space: how many passages hold one of its words. `plots`: first tile and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [first for first, _ in plots]
        for batch in batches:
            spaces, sums = [], []
            for tile, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k = int(np.searchsorted(firsts, tile, side="right")) - 1
                b, a = pairs_at((tile - firsts[k]) * TILE + np.arange(TILE))
                spaces.append(k)
                sums.append(float(np.frombuffer(part.as_py(), np.float32)[(a == b) & (b < plots[k][1])].sum(dtype=float)))
            yield pa.RecordBatch.from_arrays([pa.array(spaces, pa.int64()), pa.array(sums, pa.float64())], ["space", "n"])

    return run


def place(docs: DataFrame, renumber: np.ndarray, rows: list[Counter], parts: list[range], idf: np.ndarray, rank: int, energy: float) -> list[Space]:
    """The spaces of some parts of the items, each of `rank` items at most. `rows`: how often each item has each word; `docs`: all documents,
    `numbered`; `renumber`: what their numbers are here."""
    spark, plots, end, held = docs.sparkSession, [], 0, []
    for chosen in parts:
        words = np.unique(np.concatenate([[*rows[i]] for i in chosen]))
        local = np.full(len(idf) + 2, len(words), np.int32)
        local[words] = np.arange(len(words))
        plots.append((end, local[renumber], idf[words]))
        end += -(-(len(words) * (len(words) + 1) // 2) // TILE) * TILE  # tiles of one space each
        held.append((chosen, words, local))
    tiles, path = written(pair_sums(docs, plots, end), "latent-pairs")
    counts = tiles.mapInArrow(_traces([(start // TILE, len(w)) for start, _, w in plots]), "space long, n double").groupBy("space").agg(F.sum("n").alias("n"))
    passages = {r["space"]: r["n"] for r in counts.collect()}  # one a space
    spaces = []
    for k, (chosen, words, local) in enumerate(held):
        weights = [np.array([n * idf[t] for t, n in rows[i].items()]) for i in chosen]
        at = [local[[*rows[i]]] for i in chosen]
        norms = [np.sqrt((w**2).sum()) for w in weights]
        own = spark.createDataFrame([(t.tolist(), (EMPHASIS * w / x).tolist()) for t, w, x in zip(at, weights, norms, strict=True)], "terms array<int>, weights array<double>")
        first, last = plots[k][0] // TILE, (plots[k + 1][0] if k + 1 < len(plots) else end) // TILE
        # few tasks bound what the driver adds up
        theirs = tiles.where((F.col("tile") >= first) & (F.col("tile") < last)).coalesce(3)
        space = randomised_svd(own.coalesce(1), len(words), rank, pairs=(theirs, first, min(1.0, TOGETHER / max(1.0, passages.get(k, 0)))))
        placed = np.stack([(w / x) @ space[t] for t, w, x in zip(at, weights, norms, strict=True)])
        kept = np.cumsum(placed**2, axis=1)
        width = min(placed.shape[1], int((kept < energy).sum(axis=1).max()) + 1)
        terms = (space[:, :width] * idf[words, None]).astype(np.float32)
        spaces.append(Space(chosen[0], local, np.vstack((terms, np.zeros((1, width), np.float32))), placed[:, :width].astype(np.float32)))
    remove(spark, path)
    return spaces


Item = tuple[object, str, list[str]]


def vocabulary(items: list[Item]) -> dict[str, int]:
    vocab: dict[str, int] = {}
    for *_, words in items:
        for w in words:
            vocab.setdefault(w, len(vocab))
    return vocab


def build_index(docs: DataFrame, numbers: dict[str, int], kept: list[Item], counts: dict[str, float], n: int, rank: int, energy: float) -> Index:
    """`docs`: all documents, `numbered` by `numbers`; `counts`: in how many of the `n` documents each word is."""
    vocab = vocabulary(kept)
    renumber = np.array([*(vocab.get(w, -1) for w in numbers), -1])
    idf = np.log((n + 1) / (np.array([counts[w] for w in vocab]) + 1)) + 1e-3
    rows = [Counter(vocab[w] for w in words) for *_, words in kept]
    lengths = np.array([len(w) for *_, w in kept])
    parts = -(-len(rows) // rank)
    edges = [len(rows) * k // parts for k in range(parts + 1)]
    spaces = place(docs, renumber, rows, [range(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False)], idf, rank, energy)
    masks, answers = [], []
    for *_, words in kept:
        mask: dict[int, int] = {}
        for at, w in enumerate(words):
            mask[vocab[w]] = mask.get(vocab[w], 0) | (1 << at)
        masks.append(mask)
        rarest = sorted(set(words), key=lambda w: (-idf[vocab[w]], w))[: max(3, len(words) // 8)]
        answers.append(np.array([vocab[w] for w in rarest]))
    by_scale: dict[int, list[int]] = {}
    for i, m in enumerate(lengths.tolist()):
        by_scale.setdefault(scale_of(m), []).append(i)
    bags = [tuple(np.array(x) for x in zip(*sorted(row.items()), strict=True)) for row in rows]
    scales = {s: np.array(at) for s, at in by_scale.items()}
    space_of = np.repeat(np.arange(parts), np.diff(edges))
    return Index(vocab, np.append(idf, (0, idf.mean())), [i for i, *_ in kept], [t for _, t, _ in kept], lengths, masks, bags, answers, spaces, space_of, scales, renumber)


Match = tuple[int, float, float, float, int, int]


class Finder:
    """Finds leaks in texts, some at a time."""

    def __init__(self, x: Index, cosine: float, verbatim: float, paraphrase: float):
        self.x, self.cosine, self.verbatim, self.paraphrase = x, cosine, verbatim, paraphrase
        self.numbers = Numbers(x.vocab)
        self.scales = sorted(x.scales)
        #: Words of the smallest and of the largest blocks; a passage is two blocks, one at scale 1.
        self.least, self.most = (max(1, s // 2) for s in (self.scales[0], self.scales[-1]))
        self.reach = max(PIECE // self.most, 4) * self.most

    def matches(self, texts: Iterator[bytes | None]) -> Iterator[list[Match]]:
        """Per text its items: number, cosine, share of the item in common order, share of answer words, first and last word."""
        return self.matches_of(map(self.numbers.of, texts))

    def matches_of(self, docs: Iterator[np.ndarray]) -> Iterator[list[Match]]:
        """The same of texts given as the numbers of their words."""
        held, size = [], 0
        for words in docs:
            held.append(words)
            size += len(held[-1])
            if size >= self.reach:
                yield from self._found(held)
                held, size = [], 0
        if held:
            yield from self._found(held)

    def _found(self, docs: list[np.ndarray]) -> list[list[Match]]:
        best: list[dict[int, Match]] = [{} for _ in docs]
        # a piece goes one largest block beyond its reach, so every passage stands whole in one
        pieces = [(d, at, min(len(ids), at + self.reach + self.most)) for d, ids in enumerate(docs) for at in range(0, max(1, len(ids) - self.most), self.reach) if len(ids)]
        held, size = [], 0
        for piece in pieces:  # together about `reach` words, however long a text is
            held.append(piece)
            size += piece[2] - piece[1]
            if size >= self.reach:
                self._look(docs, held, best)
                held, size = [], 0
        if held:
            self._look(docs, held, best)
        return [[found[i] for i in sorted(found)] for found in best]

    def _look(self, docs: list[np.ndarray], pieces: list[tuple[int, int, int]], best: list[dict[int, Match]]) -> None:
        """All passages of some pieces against all items of their length. Each piece takes whole blocks of the largest size."""
        sizes = np.array([hi - lo for _, lo, hi in pieces])
        rooms = -(-sizes // self.most) * self.most
        bases = np.cumsum(rooms) - rooms
        ids = np.full(int(rooms.sum()), len(self.x.vocab), np.int32)  # none, where a piece has ended
        for (d, lo, hi), base in zip(pieces, bases.tolist(), strict=True):
            ids[base : base + hi - lo] = docs[d][lo:hi]
        squares = (self.x.weigh[ids] ** 2).reshape(-1, self.least).sum(axis=1)
        for k, space in enumerate(self.x.spaces):
            small = self._placed(space.terms, space.local[ids])
            for scale in self.scales:
                items = self.x.scales[scale]
                items = items[self.x.space_of[items] == k]
                if not len(items):
                    continue
                step = max(1, scale // 2)
                block = small.reshape(-1, step // self.least, small.shape[1]).sum(axis=1) if step > self.least else small
                square = squares.reshape(-1, step // self.least).sum(axis=1)
                first = np.arange(len(block))
                piece = np.searchsorted(bases, first * step, side="right") - 1
                if scale > 1:  # two blocks of a piece, or the only one it has
                    two = np.append(piece[1:] == piece[:-1], False)
                    only = rooms[piece] == step
                    first, piece, two = first[two | only], piece[two | only], two[two | only]
                    square = square[first] + np.where(two, square[np.minimum(first + 1, len(square) - 1)], 0)
                    block = block[first] + block[np.minimum(first + 1, len(block) - 1)] * two[:, None]
                norm = np.sqrt(square)
                norm[norm == 0] = np.inf
                alike = block @ space.placed[items - space.first].T
                for p, i in zip(*np.nonzero(alike >= (self.cosine * norm)[:, None].astype(np.float32)), strict=True):
                    at, q = int(first[p]) * step, int(piece[p])
                    d, lo, _ = pieces[q]
                    begin = lo + at - int(bases[q])
                    self._check(docs[d], begin, min(begin + scale, lo + int(sizes[q])), int(items[i]), float(alike[p, i] / norm[p]), best[d])

    def _placed(self, terms: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Sums of the words' places by smallest block; the last place, of words without one, is zero."""
        blocks = local.reshape(-1, self.least)
        out = np.empty((len(blocks), terms.shape[1]), np.float32)
        for start in range(0, len(blocks), 256):  # so few at a time that they stay in the processor's cache
            part = blocks[start : start + 256]
            total = terms[part[:, 0]]
            for k in range(1, self.least):
                total += terms[part[:, k]]
            out[start : start + 256] = total
        return out

    def _check(self, words: np.ndarray, lo: int, hi: int, i: int, alike: float, best: dict[int, Match]) -> None:
        m, answers = int(self.x.lengths[i]), self.x.answers[i]
        first, last = max(0, lo - m), min(len(words), hi + m)
        around = words[first:last]
        if self._common(i, around) < min(self.verbatim, self.paraphrase) * m - 1e-9:
            return
        share = lcs(self.x.masks[i], m, around.tolist()) / m
        if share < min(self.verbatim, self.paraphrase):
            return
        answer = float(np.isin(answers, around).mean())
        if share >= self.verbatim or (share >= self.paraphrase and answer > 0.5):
            row = (i, min(alike, 1.0), share, answer, first, last)
            if i not in best or (row[1:4], -first) > (best[i][1:4], -best[i][4]):
                best[i] = row


    def _common(self, i: int, around: np.ndarray) -> int:
        """Words that an item and a passage share, repeats included: no common subsequence is longer."""
        words, times = self.x.bags[i]
        at = np.searchsorted(words, around)
        at[at == len(words)] = 0
        return int(np.minimum(np.bincount(at[words[at] == around], minlength=len(words)), times).sum())


def _finder(index, id_type: pa.DataType, cosine: float, verbatim: float, paraphrase: float):
    names = ["_id", "item_id", "cosine", "common", "answer", "first_word", "last_word", "item_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Finder(x, cosine, verbatim, paraphrase) for x in index.value]
        for batch in batches:
            for finder in finders:
                x, at, found = finder.x, [], []
                for k, rows in enumerate(finder.matches_of(x.renumber[_words(t)] for t in batch.column(1))):
                    at += [k] * len(rows)
                    found += rows
                columns = list(zip(*found, strict=True)) or [()] * 6
                kinds = (id_type, pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                texts = pa.array([x.texts[i] for i in columns[0]], pa.string())
                columns[0] = [x.ids[i] for i in columns[0]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), texts], names)

    return run


def _cleaner(index, text_at: int, cosine: float, verbatim: float, paraphrase: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Finder(x, cosine, verbatim, paraphrase) for x in index.value]
        for batch in batches:
            for finder in finders:
                texts = batch.column(text_at).cast(pa.binary())
                batch = batch.filter(pa.array([not rows for rows in finder.matches(t.as_py() for t in texts)], pa.bool_()))  # noqa: PLW2901
            yield batch

    return run


def _passes_over(
    rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, rank: int, block: int, block_words: int, energy: float
) -> Iterator[tuple[list[Index], DataFrame, str]]:
    """The indexes of the blocks of items, some blocks at a time, and the rows (_id, text) `numbered` for them. An item is an id and a text: an id
    may have several texts, or be null."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).where("t is not null").distinct()
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    if not n:
        return
    blocks = max(1, -(-n // block), -(-chars // (4 * block_words)))
    for start in range(0, blocks, PER_PASS):
        held = []
        for b in range(start, min(blocks, start + PER_PASS)):
            taken = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
            held.append([(r["i"], r["t"], w) for r in taken if (w := words_of(r["t"].encode("utf-8", "replace")))])
        vocab = vocabulary([x for some in held for x in some])
        if vocab:
            words, path = numbered(rows, vocab)
            df, documents = document_frequencies(words, len(vocab))
            counts = dict(zip(vocab, df.tolist(), strict=True))
            yield [build_index(words, vocab, some, counts, documents, rank, energy) for some in held if some], words, path


def _passes(
    docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, rank: int, block: int, block_words: int, energy: float
) -> Iterator[list[Index]]:
    """The indexes alone."""
    rows = docs.select(F.lit(0).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    for indexes, _, path in _passes_over(rows, benchmark, item_col, item_text_col, rank, block, block_words, energy):
        remove(docs.sparkSession, path)
        yield indexes


def drop_leaking(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rank: int = 256, cosine: float = 0.3, verbatim: float = 0.6, paraphrase: float = 0.45, block: int = 2000, block_words: int = 100_000, energy: float = 0.9,
) -> DataFrame:
    """The documents that no item leaked into, with all their columns."""
    kept = docs
    for indexes in _passes(docs, benchmark, text_col, item_col, item_text_col, rank, block, block_words, energy):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)
        kept = kept.mapInArrow(_cleaner(shared, docs.columns.index(text_col), cosine, verbatim, paraphrase), docs.schema)
    return kept


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rank: int = 256, cosine: float = 0.3, verbatim: float = 0.6, paraphrase: float = 0.45, block: int = 2000, block_words: int = 100_000, energy: float = 0.9,
) -> DataFrame:
    """One row per document and leaked item: ids, cosine, common, answer, the words of the document looked at, the item's text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    id_kind = benchmark.schema[item_col].dataType
    schema = f"_id {kind}, item_id {id_kind.simpleString()}, cosine double, common double, answer double, first_word long, last_word long, item_text string"
    found = None
    for indexes, words, _ in _passes_over(rows, benchmark, item_col, item_text_col, rank, block, block_words, energy):
        shared = spark.sparkContext.broadcast(indexes)
        part = words.where("words is not null").select("_id", "words").mapInArrow(_finder(shared, to_arrow_type(id_kind), cosine, verbatim, paraphrase), schema)
        found = part if found is None else found.unionByName(part)
    return (spark.createDataFrame([], schema) if found is None else found).withColumnRenamed("_id", id_col)
