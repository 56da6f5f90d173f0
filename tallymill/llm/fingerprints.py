"""Document fingerprints as homomorphic multiset hashes: wide vectors of paragraph pieces, added up modulo powers of two.

A text is cut into paragraphs at line ends, a paragraph into pieces after sentence ends and after 12 words at most. The SHA-256 of
a piece gives a vector of 137 numbers: one 1, its eight 32-bit words, and the first 128 bits one by one. A fingerprint is the sum
of the vectors of all pieces, each number modulo 2**32. So it does not depend on the order of pieces; adding or deleting
pieces adds or subtracts theirs (`added`, `removed`), and equal multisets of pieces have equal fingerprints. The words tell
different multisets apart. The counts of bits, taken as bit times two less the number of pieces, are sums of vectors
of +1 and -1 that are independent for different pieces, so the cosine of two of them estimates that of the two multisets (deviation
about 1 / sqrt(128)): the likeness, held to 0 to 1.

Only built-in functions are used. Bits are added up two to a long, which cannot overflow below 2**31 pieces a text.

Defined results: a null text counts as empty; a text without words has no pieces and a fingerprint of zeros, which is like its own
kind (1) and unlike any other (0); equal fingerprints have likeness 1; in `neighbours`, null ids come last and rows of one id
stand in the order of a hash of the text, equal rows arbitrarily, which does not show in the result as a set; a single
row is its own neighbour; an empty table gives an empty result; very long texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import ranked, written

#: A piece: up to 11 words that end no sentence, each with a gap that is no line end, and one more word.
PIECE = r"(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?][\x20\x09]+){0,11}[^\x20\x09-\x0D]+"
WORDS, BITS = 8, 128
ROOM = 2**32


def _word(digest: Column, i: int) -> Column:
    """The i-th 32-bit number of a digest in hex."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fingerprinted(rows: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """One row per key: the key and `lanes`, the sum of the vectors of its text's pieces (array of long). Keys tell rows apart."""
    pieces = rows.select(*key, F.explode_outer(F.regexp_extract_all(F.col(text_col), F.lit(PIECE), F.lit(0))).alias("_fp_piece"))
    words = pieces.select(*key, F.sha2(F.col("_fp_piece").cast("binary"), 256).alias("_fp_hash"))
    words = words.select(*key, *[F.coalesce(_word(F.col("_fp_hash"), i), F.lit(0)).alias(f"_fp_w{i}") for i in range(WORDS)], F.col("_fp_hash").isNotNull().cast("long").alias("_fp_one"))
    ones = F.lit((1 << 32) | 1)  # two words side by side: a shift and a mask give one bit of each
    halves = [F.shiftrightunsigned(F.shiftleft(F.col(f"_fp_w{2 * h}"), 32).bitwiseOR(F.col(f"_fp_w{2 * h + 1}")), j).bitwiseAND(ones) for h in range(2) for j in range(32)]
    summed = words.groupBy(*key).agg(F.sum("_fp_one").alias("_fp_n"), *[F.sum(f"_fp_w{i}").alias(f"_fp_w{i}") for i in range(WORDS)], *[F.sum(h).alias(f"_fp_b{i}") for i, h in enumerate(halves)])
    room = F.lit(ROOM)
    bits = [x for i in range(BITS // 2) for x in (F.shiftrightunsigned(f"_fp_b{i}", 32), F.col(f"_fp_b{i}").bitwiseAND(ROOM - 1))]
    return summed.select(*key, F.array(F.pmod("_fp_n", room), *[F.pmod(f"_fp_w{i}", room) for i in range(WORDS)], *bits).alias("lanes"))


def added(a: Column, b: Column) -> Column:
    """Fingerprint of the pieces of both."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(ROOM)))


def removed(a: Column, b: Column) -> Column:
    """Fingerprint of the pieces of the first without those of the second."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(ROOM)))


def as_text(lanes: Column) -> Column:
    """Eight hex digits a number."""
    return F.lower(F.concat_ws("", F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two multisets of pieces, from 0 to 1; 1 for equal fingerprints."""
    signs = lambda x: F.transform(F.slice(x, -BITS, BITS), lambda c: (2 * c - F.element_at(x, 1)).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(signs(a), signs(a)) * dot(signs(b), signs(b)))
    cosine = F.when(norm > 0, dot(signs(a), signs(b)) / norm).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def edited_text(text: Column, following: Column) -> Column:
    """A text whose last half (rounded down) of code points is replaced by the first as many of another text, or all there are."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text (last half replaced from the next document by id, after the
    last the first), and how like it is to the edited text and to the next document.

    Order is found over narrow rows (`common.ranked`). Texts are dealt by row once, and all work on a text is done where it was dealt
    to; the part that a document gives to the one before it comes to that by a join, so a text travels at most one and a half
    times. The table is read twice and must give its rows in the same order both times, as files do.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("_id"), text.alias("_text"))
    narrow = rows.select("_row", "_id", F.xxhash64("_text").alias("_hash"), F.length("_text").alias("_chars"), F.lit(0).alias("_all"))
    placed, _ = written(ranked(narrow, ["_all"], [F.col("_id").isNull(), F.col("_id"), F.col("_hash")]), "document-order")
    before = placed.select(F.pmod(F.col("_pos") + 1, F.col("_of")).alias("_pos"), F.col("_row").alias("_to"), F.col("_id").alias("_to_id"), F.floor(F.col("_chars") / 2).cast("int").alias("_need"))
    links, _ = written(placed.select("_row", "_pos").join(before, "_pos").drop("_pos"), "document-links")
    # both uses have the same columns, so the second reads the exchange of the first
    dealt = rows.select("_row", "_text").repartition("_row")
    gifts = dealt.join(links.hint("shuffle_hash"), "_row").select(F.col("_to").alias("_row"), F.col("_to_id").alias("_id"), F.col("_row").alias("_next"), F.substring("_text", F.lit(1), F.col("_need")).alias("_gift"))
    both = dealt.join(gifts.hint("merge"), "_row").withColumn("_edited", edited_text(F.col("_text"), F.col("_gift")))
    facts = ["_row", "_next", "_id", "_n", "_sha"]
    each = both.select(
        "_row", "_next", "_id", F.length("_text").cast("long").alias("_n"), F.unhex(F.sha2(F.col("_edited").cast("binary"), 256)).alias("_sha"),
        F.explode(F.array(F.struct(F.lit(False).alias("new"), F.col("_text").alias("text")), F.struct(F.lit(True).alias("new"), F.col("_edited").alias("text")))).alias("_of"),
    ).select(*facts, F.col("_of.new").alias("_new"), F.col("_of.text").alias("_text"))
    prints = fingerprinted(each, [*facts, "_new"], "_text").groupBy(*facts).agg(F.array_sort(F.collect_list(F.struct("_new", "lanes"))).alias("_two"))
    prints, _ = written(prints.select(*facts, F.col("_two")[0]["lanes"].alias("_own"), F.col("_two")[1]["lanes"].alias("_edited")), "fingerprints")
    following = prints.select(F.col("_row").alias("_next"), F.col("_own").alias("_following"))
    return prints.join(following, "_next").select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_chars"),
        F.lower(F.hex("_sha")).alias("edited_sha256"),
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_following")).alias("near_next"),
    )
