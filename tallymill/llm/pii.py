r"""Personal data by weak supervision, with built-in functions only.

Candidates are spans of four strict patterns (email, ip, card, phone; those that pass their check are the base spans) and
of looser ones: phone numbers without a country code, emails that are spelt out, identity numbers, names after a title,
assigned secrets (keys, tokens, passwords) and bank account numbers. Five labelers vote +1, 0 or -1 on each: the pattern
(the strict one, or a shape that issuers give to their keys), a format check (lengths, check digits, mix of characters), a
gazetteer (domains, country codes, issuers, first names, names of secrets, bank countries), cue words to the left, and the
characters at both ends. Votes are counted by pattern of votes; there are at most 8 x 3^5 patterns, whatever the input. Expectation-maximisation over these counts estimates how often each labeler
votes which way on true and false spans, without labelled data, and a logistic regression (the final span classifier)
learns the resulting probabilities from kind and votes. Base spans always stay; others are added where the classifier
gives at least one half and they overlap no base span.

Spans come from splitting a text at the matches of a pattern: the lengths of the pieces and of the matches add up to
places. The running sums are taken in runs of about the square root of their number, what stands around a span is cut from
segments of the text, and overlaps are found by halving, so texts with very many matches stay cheap. Patterns never backtrack over a repeated group, so very long texts neither take quadratic time nor a deep stack.

Only the value of a secret is a span, not its name or its quotes; a secret has 16 to 256 characters.

Defined results: very long texts are read whole; a null text counts as empty; repeated rows get equal results; an empty table gives an empty result;
without candidates of one class the classifier adds nothing; other columns are ignored. Places count code points.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm import gazetteers
from tallymill.llm.common import written

KINDS = ("email", "ip", "card", "phone")
LOOSE = ("email", "phone", "ident", "name", "secret", "iban")
ALL = ("email", "ip", "card", "phone", "ident", "name", "secret", "iban")
VOTES = ("regex", "format", "gazetteer", "context", "border")

#: Strict patterns. A single separator between digits stands as U+0001 in the text that `card` reads.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": "[0-9\x01]{16,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "ident": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}\p{Ll}{1,30}+(?: \p{Lu}\p{Ll}{1,30}+)?",
    "secret": rf"(?:(?<=[=:] {{0,2}}[\"'`]?)(?<![A-Za-z0-9+/_=-])[A-Za-z0-9][A-Za-z0-9+/_=-]{{15,255}}+|(?<![A-Za-z0-9+/_=-])(?:{'|'.join(gazetteers.KEYS)}))(?![A-Za-z0-9+/_=-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
DOMAINS, COUNTRIES, ISSUERS, NAMES, BANKS, KEYS = map("|".join, (gazetteers.DOMAINS, gazetteers.COUNTRIES, gazetteers.ISSUERS, gazetteers.NAMES, gazetteers.BANKS, gazetteers.KEYS))
SECRETS = "|".join(x.replace(" ", "[_ -]?") for x in gazetteers.SECRETS)
#: Words to the left that speak for and against a span.
FOR = "mail|contact|write to|reach|phone|tel|call|mobile|fax|card|visa|credit|payment|host|server|address|ssn|social|name|iban|bank|account|token|secret|password|key|kontakt|konto|compte|cuenta|anruf|karte|adresse|correo|llama|tarjeta|carte|appel"
AGAINST = "version|isbn|issn|chapter|section|page|figure|invoice|order no|serial|build|doi|commit|revision|checksum|digest|sha1|sha256|sha512|md5|etag|uuid|guid|fingerprint|request id|trace"
#: Characters to the left that the context labeler sees; length of the segments that texts are cut to for that.
LEFT, SEGMENT = 40, 4096
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _let(value: Column, then) -> Column:
    """A value that an expression uses many times, computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running_sums(steps: Column) -> Column:
    """Running sums of an array of longs, in runs of about the square root of its length."""
    none = F.array().cast("array<long>")
    zero = F.lit(0).cast("long")

    def push(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), zero) + x))

    def cut(all_steps: Column) -> Column:
        width = F.floor(F.sqrt(F.size(all_steps))).cast("int") + 1
        return F.transform(F.sequence(F.lit(1), F.size(all_steps), width), lambda at: F.aggregate(F.slice(all_steps, at, width), none, push))

    def ends(runs: Column) -> Column:
        return F.aggregate(F.transform(runs, lambda x: F.element_at(x, -1)), none, push)

    def moved(both: Column) -> Column:
        pairs = F.zip_with(both["runs"], both["bases"], lambda run, base: F.struct(run.alias("run"), (base - F.element_at(run, -1)).alias("before")))
        return F.flatten(F.transform(pairs, lambda p: F.transform(p["run"], lambda y: y + p["before"])))

    placed = _let(_let(steps, cut), lambda runs: _let(F.struct(runs.alias("runs"), ends(runs).alias("bases")), moved))
    return F.when(F.size(steps) == 0, none).otherwise(placed)


def _pieces(df: DataFrame, name: str, text: str, pattern: str, if_has: Column) -> DataFrame:
    """Adds the lengths of what is between the matches, and the matches."""
    hit = if_has & F.rlike(text, F.lit(pattern))
    return df.withColumns(
        {
            f"{name}_gap": F.when(hit, F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))),
            f"{name}_hit": F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
        }
    )


def _placed(name: str) -> Column:
    """Structs of start, end and text of the matches; null without any."""
    gap, hit = F.col(f"{name}_gap"), F.col(f"{name}_hit")
    sizes = F.transform(hit, lambda m: F.length(m).cast("long"))
    steps = F.zip_with(F.slice(gap, F.lit(1), F.size(hit)), F.slice(F.concat(F.array(F.lit(0).cast("long")), sizes), F.lit(1), F.size(hit)), lambda a, b: a + b)
    return F.zip_with(running_sums(steps), hit, lambda s, m: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda n, x: n + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether the check digits of a bank account number are right."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.ascii(c) - F.when(F.ascii(c) >= 65, 55).otherwise(48)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda n, c: (n * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97) == 1


def _passes(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.rlike(m, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda x: _passes(kind, x["m"])


def _based(kind: str):
    return lambda x: x["base"] & (x["kind"] == kind)


def _vote(plus: Column, minus: Column | None = None) -> Column:
    none = F.lit(0) if minus is None else F.when(minus, -1).otherwise(0)
    return F.when(plus, 1).otherwise(none)


def _votes(kind: str, strict: bool, x: Column) -> list[Column]:
    m, n = x["m"], F.length(_digits(x["m"]))
    forms = {
        "email": _vote(F.length(m) <= 120, F.length(m) > 320),
        "ip": _vote(~F.rlike(m, F.lit(r"(?:^|\.)0[0-9]")), F.rlike(m, F.lit("^0"))),
        "card": _vote(n == 16),
        "phone": _vote((n >= 10) & (n <= 13), n < 8),
        "ident": _vote(~F.rlike(m, F.lit("^(?:000|666|9)|-00-|0000$")), F.rlike(m, F.lit("^(?:000|666|9)|-00-|0000$"))),
        "name": _vote(F.rlike(m, F.lit(r"^\S+ \S+ \S+$"))),
        "secret": _vote(F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Za-z]")) & (F.size(F.array_distinct(F.split(m, ""))) >= 8), ~F.rlike(m, F.lit("[0-9]")) | ~F.rlike(m, F.lit("[A-Za-z]"))),
        "iban": _vote(mod97(m), ~mod97(m)),
    }
    gazetteers = {
        "email": _vote(F.rlike(F.lower(m), F.lit(rf"[.\])] ?(?:{DOMAINS})$"))),
        "ip": F.lit(0),
        "card": _vote(F.rlike(m, F.lit(f"^{ISSUERS}")), ~F.rlike(m, F.lit(f"^{ISSUERS}"))),
        "phone": _vote(F.rlike(m, F.lit(rf"^\+(?:{COUNTRIES})"))),
        "ident": F.lit(0),
        "name": _vote(F.rlike(m, F.lit(rf" (?:{NAMES})\b"))),
        "secret": _vote(F.rlike(x["left"], F.lit(rf"(?:^|[^a-z])(?:[a-z0-9]{{1,20}}[_-])?(?:{SECRETS})[\"'`]? {{0,2}}(?:=|:|=>|:=) {{0,2}}[\"'`]?$"))),
        "iban": _vote(F.rlike(m, F.lit(f"^(?:{BANKS})")), ~F.rlike(m, F.lit(f"^(?:{BANKS})"))),
    }
    shape = F.when(F.rlike(m, F.lit(rf"^(?:{KEYS})$")), 1).otherwise(0) if kind == "secret" else F.lit(1 if strict else 0)
    context = _vote(F.rlike(x["left"], F.lit(FOR)) & ~F.rlike(x["left"], F.lit(AGAINST)), F.rlike(x["left"], F.lit(AGAINST)))
    border = _vote(~F.rlike(x["ends"], F.lit(r"[\p{L}\p{N}_@]")), F.rlike(x["ends"], F.lit(r"[\p{L}\p{N}_@]")))
    return [shape, forms[kind], gazetteers[kind], context, border]


def segments(text: Column) -> Column:
    """The text in overlapping segments, so that what stands around a span is cut from a short string, wherever in the text it is: with LEFT
    blanks before the text, the i-th one has the SEGMENT + LEFT + 1 characters from place i * SEGMENT on."""
    padded = F.concat(F.lit(" " * LEFT), text)
    starts = F.sequence(F.lit(0), F.floor(F.length(text) / SEGMENT).cast("int"))
    return _let(padded, lambda whole: F.transform(starts, lambda i: F.substring(whole, i * SEGMENT + 1, F.lit(SEGMENT + LEFT + 1))))


def _around(segments: Column, at: Column, start: int, length: int) -> Column:
    """Characters of the text from `at` + `start` - LEFT on; blanks before its beginning, nothing after its end."""
    place = at.cast("int")
    return F.substring(F.get(segments, F.floor(place / SEGMENT).cast("int")), place % SEGMENT + start + 1, F.lit(length))


def _voted(kind: str, strict: bool, spans: Column, cut: Column) -> Column:
    """Spans with their votes. `cut`: the text's segments."""
    seen = F.transform(
        spans,
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            x["m"].alias("m"),
            F.lower(_around(cut, x["s"], 0, LEFT)).alias("left"),
            F.concat(_around(cut, x["s"], LEFT - 1, 1), _around(cut, x["e"], LEFT, 1)).alias("ends"),
        ),
    )
    fields = lambda x: [F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(strict).alias("base")]
    return F.transform(seen, lambda x: F.struct(*fields(x), *[v.cast("int").alias(n) for n, v in zip(VOTES, _votes(kind, strict, x), strict=True)]))


def overlapped(x: Column, spans: Column, steps: Column) -> Column:
    """Whether a span overlaps one of `spans`, which lie apart in the order of their places: looks for the last one that starts before
    its end by halving. `steps`: powers of two from high to low, their sum at least the number of spans."""
    n = F.size(spans)
    before = F.aggregate(steps, F.lit(0), lambda at, p: F.when(at + p <= n, F.when(F.get(spans, at + p - 1)["s"] < x["e"], at + p).otherwise(at)).otherwise(at))
    return _let(before, lambda k: (k > 0) & F.coalesce(F.get(spans, k - 1)["e"] > x["s"], F.lit(False)))


def halvings(n: Column) -> Column:
    """Powers of two up to a number, the largest first."""
    return F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda p: p <= n)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and its candidate spans with votes; base spans first, looser ones only where they overlap none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    joined = F.regexp_replace(F.translate("_text", "\x01", "\x02"), "(?<=[0-9])[ -](?=[0-9])", "\x01")
    df = df.withColumn("_card", F.when(F.rlike("_text", F.lit("[0-9](?:[ -]?[0-9]){15}")), joined))
    has = {"email": F.contains("_text", F.lit("@")), "card": F.col("_card").isNotNull(), "phone": F.contains("_text", F.lit("+"))}
    for kind in KINDS:
        df = _pieces(df, f"b_{kind}", "_card" if kind == "card" else "_text", STRICT[kind], has.get(kind, F.lit(True)))
    for kind in LOOSE:
        df = _pieces(df, f"l_{kind}", "_text", LOOSER[kind], F.lit(True))
    none = "array<struct<s:bigint,e:bigint,m:string>>"
    names = [*(f"b_{k}" for k in KINDS), *(f"l_{k}" for k in LOOSE)]
    df = df.select("_id", "_text", *[F.coalesce(_placed(n), F.array().cast(none)).alias(n) for n in names])
    df = df.withColumns({f"b_{k}": F.filter(f"b_{k}", _checked(k)) for k in KINDS})
    # loose spans that overlap a base span of some kind go before votes are taken
    steps = {k: F.when(F.size(f"b_{k}") > 0, halvings(F.size(f"b_{k}"))).otherwise(F.array().cast("array<int>")).alias(f"t_{k}") for k in KINDS}
    df = df.select("_id", "_text", *names, *steps.values())
    df = df.select("_id", "_text", *[f"b_{k}" for k in KINDS], *[F.filter(f"l_{k}", _apart).alias(f"l_{k}") for k in LOOSE])
    # only texts with a candidate are cut
    some = sum((F.size(n) for n in names), F.lit(0)) > 0
    df = df.select("_id", *names, F.when(some, segments(F.col("_text"))).alias("_cut"))
    base = F.concat(*[_voted(k, True, F.col(f"b_{k}"), F.col("_cut")) for k in KINDS])
    loose = F.concat(*[_voted(k, False, F.col(f"l_{k}"), F.col("_cut")) for k in LOOSE])
    return df.select(F.col("_id").alias(id_col), F.concat(base, loose).alias("found"))


def _apart(x: Column) -> Column:
    """Whether a loose span overlaps no base span of any kind; each kind's own lie apart."""
    hits = [overlapped(x, F.col(f"b_{k}"), F.col(f"t_{k}")) for k in KINDS]
    return ~(hits[0] | hits[1] | hits[2] | hits[3])


def expectation_maximisation(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[str, tuple[int, ...]], float]:
    """The probability that a span is true, by kind and votes, from how many spans have which.

    Each labeler has a table of how often it votes which way on true and on false spans; tables and the share of true
    spans of each kind are estimated in turn with the probabilities. The start is the majority of the votes. Labelers are
    taken to be no worse than chance: a vote for a span never speaks against it, a vote against it never for it, and no vote
    lies between the two. Without that, two kinds of true spans that differ in their votes could be told apart as true and false.
    """
    weight = {(k, v): n for k, v, n in patterns}
    belief = {key: min(0.95, max(0.05, 0.5 + 0.2 * sum(key[1]))) for key in weight}
    for _ in range(rounds):
        true = {k: sum(n * belief[x] for x, n in weight.items() if x[0] == k) for k in ALL}
        total = {k: sum(n for x, n in weight.items() if x[0] == k) for k in ALL}
        prior = {k: (true[k] + 1) / (total[k] + 2) for k in ALL}
        tables = []
        for i in range(len(VOTES)):
            cells = {(c, v): 1.0 for c in (0, 1) for v in (-1, 0, 1)}
            for (k, votes), n in weight.items():
                cells[1, votes[i]] += n * belief[k, votes]
                cells[0, votes[i]] += n * (1 - belief[k, votes])
            share = {(c, v): x / sum(cells[c, u] for u in (-1, 0, 1)) for (c, v), x in cells.items()}
            down, none, up = (math.log(share[1, v] / share[0, v]) for v in (-1, 0, 1))
            down, up = min(down, 0.0), max(up, 0.0)
            tables.append({-1: down, 0: min(max(none, down), up), 1: up})
        for k, votes in weight:
            odds = math.log(prior[k] / (1 - prior[k])) + sum(t[v] for t, v in zip(tables, votes, strict=True))
            belief[k, votes] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return belief


def span_classifier(found: DataFrame) -> tuple[float, dict[str, float]]:
    """Intercept and weights of the logistic regression over kind and votes."""
    counted = found.select(F.explode("found").alias("x")).groupBy("x.kind", *[f"x.{v}" for v in VOTES]).count().collect()
    patterns = [(r["kind"], tuple(r[v] for v in VOTES), r["count"]) for r in counted]
    if not patterns:
        return -1.0, {}
    belief = expectation_maximisation(patterns)
    features = [f"is_{k}" for k in ALL] + [f"{v}_{way}" for v in VOTES for way in ("plus", "minus")]
    rows = []
    for k, votes, n in patterns:
        x = [float(k == other) for other in ALL] + [float(v == way) for v in votes for way in (1, -1)]
        p = belief[k, votes]
        rows += [(1.0, n * p, *x), (0.0, n * (1 - p), *x)]
    frame = found.sparkSession.createDataFrame(rows, ["label", "weight", *features]).where("weight > 0").coalesce(1)
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(VectorAssembler(inputCols=features, outputCol="features").transform(frame))
    return float(fitted.intercept), dict(zip(features, map(float, fitted.coefficients), strict=True))


def _logit(x: Column, intercept: float, weights: dict[str, float]) -> Column:
    z = F.lit(intercept)
    for k in ALL:
        z = z + F.when(x["kind"] == k, weights.get(f"is_{k}", 0.0)).otherwise(0.0)
    for v in VOTES:
        z = z + F.when(x[v] == 1, weights.get(f"{v}_plus", 0.0)).when(x[v] == -1, weights.get(f"{v}_minus", 0.0)).otherwise(0.0)
    return z


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, and `found`: structs of kind, s, e, base, ordered by kind and place."""
    found, _ = written(candidates(docs, id_col, text_col), "pii-candidates")
    intercept, weights = span_classifier(found)
    kept = F.filter("found", lambda x: x["base"] | (_logit(x, intercept, weights) >= 0))
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in ALL]), x["kind"])
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct(rank(x).alias("rank"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["base"].alias("base"))))
    return found.select(id_col, F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"))).alias("found"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, a digest of them, all spans as text, their number, and the number of those that were added."""
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["base"])
    counts = [F.size(F.filter("found", _based(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        id_col, *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("found").alias("spans"),
        F.size("found").cast("long").alias("n_spans"), F.size(F.filter("found", lambda x: ~x["base"])).cast("long").alias("n_added"),
    )
