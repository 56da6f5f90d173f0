"""A Parquet copy of all `tokens` rows that is refreshed file by file.

The unit is a log file, told apart by tool, modification time and size, and by a digest of its end where it was changed so shortly
before it was read that a later change might bear the same time. Rows are filed by a hash of their log's path into `PARTS`
parts, and each refresh adds one numbered folder with the rows of changed and new logs.

What a refresh replaces is not rewritten. The state names, for each log with rows that no longer count, the number up to which
they do not (a deletion vector), and reading leaves them out; a deleted log writes no row file at all. A part is written
anew only when too many of its logs are dead or it lies in too many folders (`DEAD`, `FOLDERS`). Beside the rows of each part lie
mergeable summaries by log, day, tool and project (operators.sketches), which dead logs leave in the same way.

The state is a manifest that is published whole. Manifests are numbered; the last that can be read counts, and the one before
it and its folders are kept, so a reader that has begun goes on with the old state. A tree that cannot be listed keeps the
rows it has. Logs and cache may lie in any store that Spark reads. One refresh at a time.
"""

from __future__ import annotations

import json
import os
import time
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators import sketches
from tallymill.sources import schemas
from tallymill.sources.session_logs import Tally, read_all
from tallymill.sources.storage import Files

VERSION = 4
PARTS = 32
#: Seconds before a listing in which a file's time may not tell a later change apart.
UNSURE = 2.0
#: A part is written anew when it has this many dead logs and they are a quarter of its logs, or when it lies in as many folders.
DEAD, FOLDERS = 8, 12
#: What summaries are kept by.
SUMMARIES = ("source_file", "tool", "project", "date")


@dataclass(frozen=True)
class Tree:
    tool: str
    root: str
    pattern: str


def default_trees(*homes: str) -> list[Tree]:
    """Where the three tools keep their logs, under each of the homes; under the user's own if none is named."""
    found = []
    for home in homes or (os.path.expanduser("~"),):
        found += [
            Tree("Claude Code", f"{home}/.claude/projects", "*.jsonl"),
            Tree("Codex", f"{home}/.codex/sessions", "*.jsonl"),
            Tree("Gemini", f"{home}/.gemini/tmp", "chats/*.json"),
        ]
    return found


@dataclass(frozen=True)
class Snapshot:
    tool: str
    mtime_ns: int
    size: int
    #: Digest of the file's end, where time and size may not tell a change.
    tail: str = ""


@dataclass(frozen=True)
class Listing:
    """Log files by path, and the roots that could not be listed."""

    files: dict[str, Snapshot]
    failed: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class State:
    """The logs that are filed, the folders of each part, and up to which number a log's rows are dead."""

    number: int
    files: dict[str, Snapshot]
    parts: dict[int, list[str]]
    dead: dict[str, int] = field(default_factory=dict)


def scan(spark: SparkSession, trees: list[Tree], now: float | None = None) -> Listing:
    """Every log file under the trees. A root that is not there has no files; one that cannot be listed is named as failed."""
    store, found, failed = Files(spark), {}, []
    now = time.time() if now is None else now
    for tree in trees:
        try:
            seen = store.under(tree.root, tree.pattern.rsplit("/", 1)[-1])
            for path, changed, size in seen:
                if fnmatch(path, f"*/{tree.pattern}"):
                    fresh = changed >= (now - UNSURE) * 1e9
                    found[path] = Snapshot(tree.tool, changed, size, store.tail(path) if fresh else "")
        except Exception:  # noqa: BLE001 - a store that is away must not hide the other tools
            failed.append(tree.root)
    return Listing(found, failed)


def newest(files: dict[str, Snapshot]) -> float:
    """Seconds of the latest change; 0 without files."""
    return max((s.mtime_ns / 1e9 for s in files.values()), default=0.0)


def _by_tool(files: dict[str, Snapshot], paths) -> dict[str, list[str]]:
    grouped: dict[str, list[str]] = {}
    for path in sorted(paths):
        grouped.setdefault(files[path].tool, []).append(path)
    return grouped


def part_of(path: str) -> int:
    """The part that a log's rows are filed in."""
    return zlib.crc32(path.encode()) % PARTS


class TokenCache:
    def __init__(self, spark: SparkSession, folder: str, trees: list[Tree], reader: Callable[..., DataFrame] = read_all):
        self.spark, self.folder, self.trees, self.reader, self.store = spark, folder.rstrip("/"), trees, reader, Files(spark)
        #: What the last load did, and what it read, by tool, for timing output.
        self.steps: list[str] = []
        self.read: dict[str, dict[str, int]] = {}

    def _manifests(self) -> list[int]:
        """Numbers of the manifests that are there, the last first."""
        named = [n[len("manifest-") : -len(".json")] for n in self.store.names(self.folder) if fnmatch(n, "manifest-*.json")]
        return sorted((int(n) for n in named if n.isdigit()), reverse=True)

    def manifest(self, number: int) -> str:
        return f"{self.folder}/manifest-{number}.json"

    def _state(self, number: int) -> State | None:
        try:
            raw = json.loads(self.store.read(self.manifest(number)))
            if raw["version"] != VERSION:
                return None
            files = {p: Snapshot(str(s["tool"]), int(s["mtime_ns"]), int(s["size"]), str(s["tail"])) for p, s in raw["files"].items()}
            parts = {int(k): [str(x) for x in names] for k, names in raw["parts"].items()}
            dead = {str(p): int(n) for p, n in raw["dead"].items()}
        except (ValueError, KeyError, TypeError, AttributeError):
            return None
        there = {name for folder in {n.split("/")[0] for names in parts.values() for n in names} for name in (f"{folder}/{x}" for x in self.store.names(f"{self.folder}/{folder}"))}
        return State(number, files, parts, dead) if all(n in there for names in parts.values() for n in names) else None

    def state(self) -> State | None:
        """The last stored state that can be used; None if there is none."""
        return next((s for s in map(self._state, self._manifests()) if s is not None), None)

    def _alive(self, state: State, parts: Iterable[int], kind: str = "rows") -> DataFrame:
        """Rows, or summaries, of some parts that still count. Parts without dead logs are read as they are."""
        with_dead = {part_of(p) for p in state.dead}
        read = lambda names: self.spark.read.schema(self._schema(kind)).parquet(*sorted(f"{self.folder}/{kind}{n[len('rows') :]}" for n in names))
        clean = [n for k in parts if k not in with_dead for n in state.parts.get(k, [])]
        mixed = [n for k in parts if k in with_dead for n in state.parts.get(k, [])]
        out = read(clean) if clean else self.spark.createDataFrame([], self._schema(kind))
        if mixed:
            dead = self.spark.createDataFrame(sorted((p, n) for p, n in state.dead.items() if part_of(p) in set(parts)), "source_file string, upto long")
            marked = read(mixed).join(dead, "source_file", "left").where("upto is null or filed > upto")
            out = out.unionByName(marked.drop("upto"))
        return out

    def _schema(self, kind: str):
        if kind == "rows":
            return schemas.FILED
        return sketches.summarized(self.spark.createDataFrame([], schemas.FILED), [*SUMMARIES, "filed"]).schema

    def tokens(self, state: State) -> DataFrame:
        return self._alive(state, state.parts).select(schemas.TOKENS.fieldNames())

    def summaries(self) -> DataFrame:
        """The stored summaries of all logs (operators.sketches), read without any row; brought up to date by `load`."""
        state = self.state()
        return self._alive(state, state.parts, "sums") if state else self.spark.createDataFrame([], self._schema("sums"))

    def estimates(self, first: str | None = None, last: str | None = None, by: Sequence[str] = ("tool",)) -> DataFrame:
        """Turns, tokens, estimated sessions and quantiles of turn sizes of a range of days."""
        return sketches.estimates(sketches.merged(sketches.between(self.summaries(), first, last), by))

    def _write(self, tokens: DataFrame, number: int, parts: dict[int, list[str]]) -> dict[int, list[str]]:
        """Files rows and their summaries in new folders; the parts with these added."""
        name = uuid.uuid4().hex
        part = F.pmod(F.crc32(F.col("source_file").cast("binary")), F.lit(PARTS)).cast("int")
        out = lambda df, kind: df.withColumn("part", part).repartition("part").write.option("compression", "zstd").partitionBy("part").parquet(f"{self.folder}/{kind}-{name}")
        with Tally.gathering(self.spark):
            out(tokens.withColumn("filed", F.lit(number).cast("long")), "rows")
        there = sorted(int(n.split("=")[1]) for n in self.store.names(f"{self.folder}/rows-{name}") if n.startswith("part="))
        if there:
            rows = self.spark.read.schema(schemas.FILED).parquet(*[f"{self.folder}/rows-{name}/part={k}" for k in there])
            out(sketches.summarized(rows, [*SUMMARIES, "filed"]), "sums")
        return {k: [*parts.get(k, []), *([f"rows-{name}/part={k}"] if k in there else [])] for k in {*parts, *there}}

    def _publish(self, state: State) -> None:
        """Makes a state the last one, and drops what neither it nor the one before names."""
        listed = {p: {"tool": s.tool, "mtime_ns": s.mtime_ns, "size": s.size, "tail": s.tail} for p, s in sorted(state.files.items())}
        parts = {str(k): names for k, names in sorted(state.parts.items())}
        text = json.dumps({"version": VERSION, "files": listed, "parts": parts, "dead": dict(sorted(state.dead.items()))}, separators=(",", ":"))
        self.store.publish(self.manifest(state.number), text)
        kept, used = [], set()
        for number in self._manifests():
            found = self._state(number) if len(kept) < 2 else None
            if found is None:
                self.store.delete(self.manifest(number))
            else:
                kept.append(number)
                used |= {n.split("/")[0].split("-")[1] for names in found.parts.values() for n in names}
        for old in self.store.names(self.folder):
            if old.split("-")[0] in ("rows", "sums") and old.split("-")[-1] not in used:
                self.store.delete(f"{self.folder}/{old}")

    def _changed(self, listing: Listing, known: State) -> list[str]:
        """Logs that are new or differ from what is filed; where only the time is unsure, their ends are compared."""
        out = []
        for path, now in listing.files.items():
            filed = known.files.get(path)
            if filed is None or replace(filed, tail="") != replace(now, tail="") or (filed.tail and filed.tail != (now.tail or self.store.tail(path))):
                out.append(path)
        return out

    def _crowded(self, state: State, files: dict[str, Snapshot]) -> set[int]:
        dead, logs = Counter(map(part_of, state.dead)), Counter(map(part_of, files))
        return {k for k, names in state.parts.items() if len(names) >= FOLDERS or (dead[k] >= DEAD and 4 * dead[k] >= logs[k])}

    def load(self, refresh: bool = False) -> DataFrame:
        self.steps, self.read, tally = [], {}, Tally()
        listing = scan(self.spark, self.trees)
        known = None if refresh else self.state()
        first = next((n for names in known.parts.values() for n in names), None) if known else None
        if first and not {"source_file", "filed"} <= set(self.spark.read.parquet(f"{self.folder}/{first}").columns):
            known = None
        number = max(self._manifests(), default=0) + 1
        if known is None:
            self.steps.append("rebuild")
            rows = self._read(_by_tool(listing.files, listing.files), tally)
            state = State(number, listing.files, self._write(rows, number, {}))
            self.read = tally.counts()
            self._publish(state)
            return self.tokens(state)
        self.steps.append("load cache")
        lost = lambda path: any(path.startswith(f"{root.rstrip('/')}/") for root in listing.failed)
        if listing.failed:
            self.steps.append("keep rows of trees that cannot be listed")
        files = {p: s for p, s in known.files.items() if p not in listing.files and lost(p)} | listing.files
        changed, gone = self._changed(listing, known), [p for p in known.files if p not in files]
        if not changed and not gone:
            return self.tokens(known)
        stale = {*gone, *(p for p in changed if p in known.files)}
        if stale:
            self.steps.append("drop changed rows")
        # a part none of whose filed logs counts any more needs no deletion vector
        left = {part_of(p) for p in known.files if p not in stale}
        dead = {p: known.number for p in stale} | {p: n for p, n in known.dead.items() if p not in stale}
        state = State(number, files, {k: v for k, v in known.parts.items() if k in left}, {p: n for p, n in dead.items() if part_of(p) in left})
        rows = None
        if changed:
            self.steps.append("append changed files")
            rows = self._read(_by_tool(files, changed), tally).select(schemas.TOKENS.fieldNames())
        if crowded := self._crowded(state, files):
            self.steps.append("write crowded parts anew")
            again = self._alive(state, crowded).select(schemas.TOKENS.fieldNames())
            rows = again if rows is None else rows.unionByName(again)
            state = replace(state, parts={k: v for k, v in state.parts.items() if k not in crowded}, dead={p: n for p, n in state.dead.items() if part_of(p) not in crowded})
        if rows is not None:
            state = replace(state, parts=self._write(rows, number, state.parts))
            self.read = tally.counts()
        self._publish(state)
        return self.tokens(state)

    def _read(self, by_tool: dict[str, list[str]], tally: Tally) -> DataFrame:
        return self.reader(self.spark, by_tool, tally) if self.reader is read_all else self.reader(self.spark, by_tool)
