import json
import os
import random
import time
from datetime import date

import pytest

from tallymill import cli
from tallymill.sources import schemas
from tallymill.sources.cache import Listing, TokenCache, Tree, default_trees, newest, part_of, scan
from tallymill.sources.session_logs import read_claude, read_codex
from tallymill.sources.storage import Files, shared_dir

FIELDS = "project string, session string, date string, model string, input_tokens int, output_tokens int, cache_write_tokens int, cache_read_tokens int, total_tokens long"


def toy(spark, by_tool):
    files = [f for fs in by_tool.values() for f in fs]
    if not files:
        return spark.createDataFrame([], schemas.TOKENS)
    return spark.read.schema(FIELDS).json(files).selectExpr("'Toy' AS tool", "*", "regexp_replace(_metadata.file_path, '^file:/+', '/') AS source_file")


class Place:
    """A folder of logs, each one line, and a cache over it."""

    def __init__(self, spark, tmp_path):
        self.root, self.clock = tmp_path / "logs", 1
        self.root.mkdir()
        self.cache = TokenCache(spark, str(tmp_path / "cache"), [Tree("Toy", str(self.root), "*.jsonl")], toy)

    def put(self, name, total):
        path = self.root / f"{name}.jsonl"
        path.write_text(json.dumps({"project": f"of {name}", "date": "2026-03-15", "total_tokens": total}) + "\n")
        self.clock += 1
        os.utime(path, ns=(self.clock * 10**9, self.clock * 10**9))

    def drop(self, name):
        (self.root / f"{name}.jsonl").unlink(missing_ok=True)

    def totals(self, refresh=False):
        return {r.project.removeprefix("of "): r.total_tokens for r in self.cache.load(refresh).collect()}

    def parts(self):
        """Where each part lies."""
        return dict(self.cache.state().parts)

    def manifest(self):
        return self.cache.manifest(self.cache._manifests()[0])


@pytest.fixture
def place(spark, tmp_path):
    p = Place(spark, tmp_path)
    for k, name in enumerate(["north", "south", "east", "west"]):
        p.put(name, 10 * k + 1)
    return p


FIRST = {"north": 1, "south": 11, "east": 21, "west": 31}


def rows_folders(place):
    return {n for n in place.cache.store.names(place.cache.folder) if n.startswith("rows-")}


def test_only_changed_logs_are_written(place):
    assert place.totals() == FIRST and place.cache.steps == ["rebuild"]
    before, folders = place.parts(), rows_folders(place)
    assert place.totals() == FIRST and place.cache.steps == ["load cache"] and place.parts() == before
    place.put("south", 500)
    place.put("up", 7)
    place.drop("west")
    assert place.totals() == {"north": 1, "south": 500, "east": 21, "up": 7}
    assert place.cache.steps == ["load cache", "drop changed rows", "append changed files"]
    # the new folder holds the two logs that were read; what was there is as it was
    (new,) = rows_folders(place) - folders
    written = place.cache.spark.read.parquet(f"{place.cache.folder}/{new}").collect()
    assert sorted(r.project for r in written) == ["of south", "of up"] and folders <= rows_folders(place)


def test_deleted_log_writes_no_rows(place):
    """One that shares its part with others is marked in the state; a part of its own is let go. No folder is added either way."""
    mate = next(f"n{i}" for i in range(10_000) if part_of(str(place.root / f"n{i}.jsonl")) == part_of(str(place.root / "north.jsonl")))
    place.put(mate, 77)
    assert place.totals() == FIRST | {mate: 77}
    folders = rows_folders(place)
    place.drop("north")
    assert place.totals() == {"south": 11, "east": 21, "west": 31, mate: 77} and place.cache.steps == ["load cache", "drop changed rows"]
    assert rows_folders(place) == folders and list(place.cache.state().dead) == [str(place.root / "north.jsonl")]
    place.put("north", 5)
    assert place.totals()["north"] == 5 and place.totals()["north"] == 5


def test_crowded_parts_are_written_anew(place, monkeypatch):
    monkeypatch.setattr("tallymill.sources.cache.DEAD", 2)
    monkeypatch.setattr("tallymill.sources.cache.PARTS", 1)
    place.totals()
    place.put("north", 2)
    place.totals()
    assert len(place.cache.state().dead) == 1 and len(place.parts()[0]) == 2
    place.put("south", 3)
    assert place.totals() == {"north": 2, "south": 3, "east": 21, "west": 31} and "write crowded parts anew" in place.cache.steps
    assert place.cache.state().dead == {} and len(place.parts()[0]) == 1
    monkeypatch.setattr("tallymill.sources.cache.FOLDERS", 1)
    place.put("up", 1)
    assert place.totals() == {"north": 2, "south": 3, "east": 21, "west": 31, "up": 1} and len(place.parts()[0]) == 1


def test_the_state_before_is_kept(place):
    """A frame made before a refresh can still be read after it, not after two; only the folders of two states are there."""
    old = place.cache.load()
    for total in (100, 200):
        for name in FIRST:
            place.put(name, total)
        new = place.cache.load()
        if total == 100:
            assert sorted(r.total_tokens for r in old.collect()) == [1, 11, 21, 31]
    assert {r.total_tokens for r in new.collect()} == {200} and len(place.cache._manifests()) == 2 and len(rows_folders(place)) == 2


BROKEN = ["{", '{"version":1,"files":{}}', '{"version":4}', "[]", '{"version":4,"files":{},"dead":{},"parts":{"1":["rows-gone/part=1"]}}']


@pytest.mark.parametrize("broken", BROKEN)
def test_broken_manifest(place, broken):
    """The last state that can be used counts; without one all logs are read again."""
    place.totals()
    last = place.cache._manifests()[0]
    place.cache.store.publish(place.cache.manifest(last + 1), broken)
    assert place.totals() == FIRST and place.cache.steps == ["load cache"]
    place.cache.store.delete(place.cache.manifest(last))
    assert place.totals() == FIRST and place.cache.steps == ["rebuild"]


def test_explicit_refresh_and_no_files(place):
    place.totals()
    assert place.totals(refresh=True) == FIRST and place.cache.steps == ["rebuild"]
    for name in FIRST:
        place.drop(name)
    assert place.totals(refresh=True) == {} and place.totals() == {}


def test_old_cache_without_source_file(place, spark):
    place.totals()
    for folders in place.parts().values():
        for folder in folders:
            spark.range(1).write.mode("overwrite").parquet(f"{place.cache.folder}/{folder}")
    assert place.totals() == FIRST and place.cache.steps == ["rebuild"]


def test_incremental_equals_rebuild(place, monkeypatch):
    """Rows and summaries after random changes are those of a rebuild, with and without parts written anew."""
    chance = random.Random(4)
    for dead in (8, 1):
        monkeypatch.setattr("tallymill.sources.cache.DEAD", dead)
        for _ in range(4):
            for name in "abcdefgh":
                step = chance.random()
                if step < 0.4:
                    place.put(name, chance.randint(1, 99))
                elif step < 0.6:
                    place.drop(name)
            got, summed = place.totals(), place.cache.estimates().first()
            assert got == place.totals(refresh=True) and (summed.turns, summed.total_tokens) == (len(got), sum(got.values()))
            place.cache.store.delete(place.cache.manifest(place.cache._manifests()[0]))  # go on from the refreshed state


def test_same_size_within_one_tick(place):
    """A log that is rewritten with the same size and time right after it was read is found by its end."""
    path = place.root / "north.jsonl"
    stamp = time.time_ns()
    place.put("north", 3)
    os.utime(path, ns=(stamp, stamp))
    assert place.totals()["north"] == 3
    size = path.stat().st_size
    place.put("north", 4)
    os.utime(path, ns=(stamp, stamp))
    assert path.stat().st_size == size and place.totals()["north"] == 4
    assert place.totals()["north"] == 4 and place.cache.steps == ["load cache"]


def test_failed_listing_keeps_rows(place, monkeypatch):
    """A tree whose store is away keeps its rows; one that is gone loses them."""
    place.totals()
    under = Files.under
    monkeypatch.setattr(Files, "under", lambda self, root, pattern: (_ for _ in ()).throw(OSError("away")))
    assert scan(place.cache.spark, place.cache.trees).failed == [str(place.root)]
    assert place.totals() == FIRST and place.cache.steps == ["load cache", "keep rows of trees that cannot be listed"]
    monkeypatch.setattr(Files, "under", under)
    place.root.rename(place.root.with_name("elsewhere"))
    assert place.totals() == {}


def test_summaries_without_rows(place, monkeypatch):
    """Estimates read the stored summaries alone, of any range of days."""
    place.totals()
    for name in rows_folders(place):
        place.cache.store.delete(f"{place.cache.folder}/{name}/_SUCCESS")
    kinds = []
    alive = TokenCache._alive
    monkeypatch.setattr(TokenCache, "_alive", lambda self, state, parts, kind="rows": kinds.append(kind) or alive(self, state, parts, kind))
    (row,) = place.cache.estimates("2026-03-15", "2026-03-15").collect()
    assert kinds == ["sums"] and (row.turns, row.total_tokens, row.sessions, row.p50, row.p99) == (4, 64, 0, 11, 31)
    assert place.cache.estimates("2026-03-16").count() == 0


def _home(tmp_path):
    log = tmp_path / ".claude/projects/-p/session.jsonl"
    log.parent.mkdir(parents=True)
    usage = {"input_tokens": 1000, "output_tokens": 200, "cache_creation_input_tokens": 500, "cache_read_input_tokens": 8000}
    log.write_text(json.dumps({"type": "assistant", "sessionId": "s", "timestamp": "2026-03-15T01:02", "cwd": "/x/Proj", "message": {"model": "claude-sonnet-4", "usage": usage}}))
    chat = tmp_path / ".gemini/tmp/g/chats/chat.json"
    chat.parent.mkdir(parents=True)
    chat.write_text(json.dumps({"sessionId": "g", "messages": [{"timestamp": "2026-03-10", "model": "gemini-2.5-pro", "tokens": {"input": 5, "output": 1, "cached": 0, "total": 6}}]}))
    return str(tmp_path)


def test_scan(spark, tmp_path):
    files = scan(spark, default_trees(_home(tmp_path))).files
    assert len(files) == 2 and newest(files) > 0 and newest({}) == 0.0
    assert all(os.stat(p).st_size == s.size and os.stat(p).st_mtime_ns // 10**6 == s.mtime_ns // 10**6 for p, s in files.items())
    assert scan(spark, [Tree("Toy", str(tmp_path / "nowhere"), "*.json")]) == Listing({}, [])


def test_several_homes(spark, tmp_path):
    one, two = _home(tmp_path / "one"), _home(tmp_path / "two")
    assert len(scan(spark, default_trees(one, two)).files) == 4
    args = ["--home", one, "--home", two, "--cache", str(tmp_path / "cache"), "--table"]
    assert cli.main(args, spark, date(2026, 3, 16), lambda command: None) == 0
    assert TokenCache(spark, str(tmp_path / "cache"), default_trees(one, two)).load().count() == 4


def test_cli(spark, tmp_path, capsys):
    args = ["--home", _home(tmp_path / "home"), "--cache", str(tmp_path / "cache")]
    reports = {"one json": '{"plan": "default_claude_max_5x"}', "two": None, "three": '{"account_quota": {"user_tier": "g1-pro-tier"}}'}
    args += ["--plan-command", "claude=one json", "--plan-command", "codex=two", "--plan-command", "gemini=three"]
    run = lambda *more: cli.main([*args, *more], spark, date(2026, 3, 16), reports.get)
    assert run("--table") == 0 and "proj" in capsys.readouterr().out
    assert run("--table", "--tool", "gemini", "--by", "model") == 0
    out = capsys.readouterr().out
    assert "gemini-2.5-pro" in out and "sonnet" not in out
    assert run("--sql", "SELECT fmt(sum(total_tokens)) AS t FROM tokens", "--since", "1d", "--debug-timing") == 0
    shown = capsys.readouterr()
    assert "9.7k" in shown.out and "load cache" in shown.err
    assert run("--share", "--subscription", "20") == 0 and "of AI compute this week for $20.0/mo" in capsys.readouterr().out
    assert run("--chart-file", str(tmp_path / "chart.svg"), "--subscription", "20") == 0 and "of AI compute this week" in (tmp_path / "chart.svg").read_text()
    assert run("--share", "--debug-timing") == 0  # without a price, what the tools report counts
    shown = capsys.readouterr()
    assert "of AI compute this week for $120.0/mo" in shown.out and "Claude Code: max_5x, $100 a month" in shown.err
    assert run("--estimate", "--since", "3d") == 0
    out = capsys.readouterr().out
    assert "Claude Code" in out and "9700" in out and "Gemini" not in out
    assert run("--table", "--refresh", "--debug-timing") == 0 and "Claude Code: 1 read, 0 malformed, 0 too long, 1 kept" in capsys.readouterr().err
    assert run("--table", "--profile") == 0 and "cumulative" in capsys.readouterr().err
    assert cli.main(["--home", str(tmp_path / "none"), "--cache", str(tmp_path / "empty")], spark) == 1


def test_plans_are_asked_for_by_default(spark, tmp_path, capsys):
    """Without an option the tools' usual commands are run; here what they print is made up."""
    asked = []

    def printed(command):
        asked.append(command)
        return '{"plan": "pro"}' if "ccusage" not in command else None

    args = ["--home", _home(tmp_path / "home"), "--cache", str(tmp_path / "cache"), "--share"]
    assert cli.main(args, spark, date(2026, 3, 16), printed) == 0
    assert "of AI compute this week for $220.0/mo" in capsys.readouterr().out
    assert len(asked) == 3 and all(c.endswith(" json") and " -m " in c for c in asked)


def test_counts_of_logs_without_rows(spark, tmp_path):
    """Logs that give no row are counted too: malformed lines, a header alone, a chat without messages, an empty file."""
    for name, text in {"c/a.jsonl": "bad\n{\n", "x/a.jsonl": '{"type": "session_meta", "payload": {"cwd": "/a"}}\n', "x/b.jsonl": "", "g/chats/a.json": '{"sessionId": "q", "messages": []}'}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    trees = [Tree("Claude Code", str(tmp_path / "c"), "*.jsonl"), Tree("Codex", str(tmp_path / "x"), "*.jsonl"), Tree("Gemini", str(tmp_path / "g"), "chats/*.json")]
    cache = TokenCache(spark, str(tmp_path / "cache"), trees)
    assert cache.load().count() == 0
    none = {"malformed": 0, "too_long": 0, "kept": 0}
    assert cache.read == {"Claude Code": none | {"read": 2, "malformed": 2}, "Codex": none | {"read": 1}, "Gemini": none | {"read": 1}}
    assert cache.load().count() == 0 and cache.read == {} and cache.estimates().count() == 0


def test_version(capsys):
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert "tallymill" in capsys.readouterr().out


def test_numbers_in_quotes(spark, tmp_path):
    """Counts may stand in quotes; what is no number counts as missing."""
    log = tmp_path / "projects/p/session.jsonl"
    log.parent.mkdir(parents=True)
    turn = {"type": "assistant", "sessionId": "s", "timestamp": "2026-03-15T01:02", "cwd": "/x/Proj"}
    usage = [{"input_tokens": "12", "output_tokens": 7}, {"input_tokens": "many", "output_tokens": 1.0, "cache_read_input_tokens": "3"}]
    log.write_text("\n".join(json.dumps({**turn, "message": {"model": "m", "usage": u}}) for u in usage))
    got = sorted((r.input_tokens, r.output_tokens, r.cache_read_tokens, r.total_tokens) for r in read_claude(spark, [str(log)]).collect())
    assert got == [(0, 1, 3, 4), (12, 7, 0, 19)]
    log = tmp_path / "rollout.jsonl"
    info = {"total_token_usage": {"total_tokens": "90"}, "last_token_usage": {"total_tokens": "40", "input_tokens": "30"}}
    log.write_text(json.dumps({"type": "event_msg", "timestamp": "2026-03-15T01", "payload": {"type": "token_count", "info": info}}))
    assert [(r.total_tokens, r.input_tokens) for r in read_codex(spark, [str(log)]).collect()] == [(40, 30)]


def test_shared_folder(spark, monkeypatch):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

    class Remote:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Remote)
