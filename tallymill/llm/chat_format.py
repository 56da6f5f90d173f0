r"""Chat formatting with a grammar round trip.

A conversation becomes `<|im_start|>role<|im_sep|>text<|im_end|>` per turn. Rendered text is parsed again by a deterministic
parser: it splits at the marks, takes one backslash out of escaped control strings, and does not accept a control string
that stands unescaped inside a role or text. Each turn is rendered, parsed and compared to its source, and escaped once
more until it comes back the same, `ATTEMPTS` times at most; a turn that never does raises an error, and so does a
conversation that does not come back as a whole. To escape, one more backslash goes after the first character of every control
string, also of those that carry backslashes there already (`</s>` to `<\/s>`, `<\/s>` to `<\\/s>`). Texts without control
strings are never changed. Only built-in functions are used.

Defined results: null role or text counts as empty; turns stand in the order of turn, role, text (nulls first), repeated
rows stay; a null conv_id is one conversation; an empty table gives an empty result; other columns are ignored. A
conversation is one row of the result, so its text must fit a row, up to 2 GB; tests hold one of 200,000 characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A turn is escaped fewer times than this.
ATTEMPTS = 3


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    #: Other strings that a tokenizer reads as control tokens.
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    #: The role whose texts are learned from.
    learned: str = "assistant"

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.middle, self.end, *self.reserved)

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._marked(), r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._marked(r"\\"), "$1$2")

    def accepts(self, text: Column) -> Column:
        """Whether no control string stands unescaped."""
        return ~F.rlike(text, F.lit("|".join(re.escape(c) for c in self.controls)))

    def _marked(self, lead: str = "") -> str:
        """One group for a control string's first character, one for the backslashes and the rest of it."""
        firsts = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        rests = "|".join(re.escape(c[1:]) for c in self.controls)
        return rf"([{firsts}]){lead}(\\*(?:{rests}))"


def _turn(t: Template, role: Column, text: Column) -> Column:
    return F.concat(F.lit(t.start), role, F.lit(t.middle), text, F.lit(t.end))


def parse(formatted: Column, t: Template = Template()) -> Column:
    """The turns of a rendered text: array of role and text, unescaped; null for one that has an unescaped control string."""
    quoted = lambda s: "\\Q" + s + "\\E"
    blocks = F.slice(F.split(formatted, quoted(t.end), -1), F.lit(1), F.greatest(F.size(F.split(formatted, quoted(t.end), -1)) - 1, F.lit(0)))
    inner = F.transform(blocks, lambda b: F.split(F.substring(b, F.lit(len(t.start) + 1), F.length(b)), quoted(t.middle), 2))
    fields = F.transform(inner, lambda p: F.struct(p[0].alias("role"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("text")))
    read = lambda x: F.when(t.accepts(x), t.unescape(x))
    return F.transform(fields, lambda p: F.struct(read(p["role"]).alias("role"), read(p["text"]).alias("text")))


def format_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    template: Template = Template(),
) -> DataFrame:
    """One row per conversation: id, formatted, turns (as parsed from it), escaped (turns that needed it), round_trip."""
    t = template
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    raw = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), role.alias("_role"), text.alias("_text"))

    def comes_back(r: Column, x: Column) -> Column:
        turns = parse(_turn(t, r, x), t)
        return (F.size(turns) == 1) & F.get(turns, F.lit(0)).eqNullSafe(F.struct(F.col("_role").alias("role"), F.col("_text").alias("text")))

    tries = [(F.col("_role"), F.col("_text"))]
    while len(tries) < ATTEMPTS:
        tries.append(tuple(t.escape(c) for c in tries[-1]))
    found = None
    for k, (r, x) in enumerate(tries):
        value = F.struct(r.alias("r"), x.alias("x"), F.lit(min(k, 1)).alias("escaped"))
        found = F.when(comes_back(r, x), value) if found is None else found.when(comes_back(r, x), value)
    found = found.otherwise(F.raise_error(F.lit("a turn does not come back from its rendered text")))
    rendered = raw.withColumn("_as", found).select("_conv", "_turn", "_role", "_text", F.col("_as.r").alias("_r"), F.col("_as.x").alias("_x"), F.col("_as.escaped").alias("_escaped"))
    grouped = rendered.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("_turn", "_role", "_text", "_r", "_x", "_escaped"))).alias("_all"))
    # array_sort puts null turns last; they are moved to the front
    ordered = F.concat(F.filter("_all", lambda x: x["_turn"].isNull()), F.filter("_all", lambda x: x["_turn"].isNotNull()))
    built = grouped.withColumn("_all", ordered).select(
        F.col("_conv").alias(conv_col),
        F.array_join(F.transform("_all", lambda x: _turn(t, x["_r"], x["_x"])), "").alias("formatted"),
        F.transform("_all", lambda x: F.struct(x["_role"].alias("role"), x["_text"].alias("text"))).alias("_source"),
        F.aggregate("_all", F.lit(0), lambda n, x: n + x["_escaped"]).alias("escaped"),
    )
    back = F.when(F.col("turns") == F.col("_source"), True).otherwise(F.raise_error(F.lit("a conversation does not come back from its rendered text")))
    return built.withColumn("turns", parse(F.col("formatted"), t)).select(conv_col, "formatted", "turns", "escaped", back.alias("round_trip"))


def digests(formatted: DataFrame, conv_col: str = "conv_id", learned: str = "assistant") -> DataFrame:
    """Counts and digests of what was read back: turns, text under the loss mask, rendered length."""
    listed = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == learned), lambda x: x["text"]), "")
    return formatted.withColumns({"_listed": listed, "_loss": loss}).select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("_listed").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("escaped").cast("long").alias("escaped_turns"),
        "round_trip",
    )
