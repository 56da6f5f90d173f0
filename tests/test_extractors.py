import json

import pytest

from tallymill.sources import session_logs


def _write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def _turn(model="claude-opus-4", usage=(9, 9, 9, 9), at="2026-03-15T10:00", cwd="/home/u/Alpha", **more):
    names = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    own = None if usage is None else {k: v for k, v in zip(names, usage, strict=True) if v is not None}
    return {"type": "assistant", "sessionId": "S1", "timestamp": at, "cwd": cwd, "message": {"model": model, "usage": own}} | more


def test_claude(spark, tmp_path):
    main = _write(
        tmp_path / "projects/-home-u-Alpha/a.jsonl",
        [
            _turn("claude-sonnet-4", (1000, 200, 500, 8000), isSidechain=False),
            _turn(usage=(10, 20, None, None), cwd="C:\\Users\\u\\WinProj"),
            _turn("claude-haiku-4", (1, 2, 3, 4), "2026-03-16T10:00", "/home/u/Alpha/"),
            _turn("claude-haiku-4", (5, 5, 5, 5), "2026-03-16T10:01", None),
            _turn("<synthetic>"),
            _turn(None),
            _turn(isSidechain=True),
            _turn(at=None),
            _turn() | {"type": "user"},
            _turn(usage=None),
            "{bad json",
        ],
    )
    side = _write(tmp_path / "projects/-home-u-Alpha/subagents/x.jsonl", [_turn()])
    spaced = _write(tmp_path / "projects/-home-u-my proj+1/b.jsonl", [_turn("claude-sonnet-4", (1, 1, 0, 0), "2026-03-17T00:00", "")])
    rows = session_logs.read_claude(spark, [main, side, spaced]).collect()
    got = sorted((r.project, r.date, r.model, r.total_tokens) for r in rows)
    assert got == [
        ("-home-u-alpha", "2026-03-16", "claude-haiku-4", 10),
        ("-home-u-alpha", "2026-03-16", "claude-haiku-4", 20),
        ("-home-u-my proj+1", "2026-03-17", "claude-sonnet-4", 2),
        ("alpha", "2026-03-15", "claude-sonnet-4", 9700),
        ("winproj", "2026-03-15", "claude-opus-4", 30),
    ]
    assert {r.source_file for r in rows} == {main, spaced}


def _meta(cwd):
    return {"type": "session_meta", "timestamp": "2026-03-15T00:00:00", "payload": {"cwd": cwd}}


def _count(second, total, last, used):
    info = {"last_token_usage": dict(zip(("input_tokens", "output_tokens", "cached_input_tokens"), used, strict=True))}
    if last is not None:
        info["last_token_usage"]["total_tokens"] = last
    if total is not None:
        info["total_token_usage"] = {"total_tokens": total}
    return {"type": "event_msg", "timestamp": f"2026-03-15T00:00:{second:02d}", "payload": {"type": "token_count", "info": info}}


@pytest.fixture
def codex_files(tmp_path):
    day = tmp_path / "sessions/2026/03/15"
    no_info = {"type": "event_msg", "timestamp": "2026-03-15T00:00:00", "payload": {"type": "token_count", "info": None}}
    steps = [(100, 100, (80, 20, 10)), (100, 100, (80, 20, 10)), (160, 0, (40, 20, 0)), (None, 5, (4, 1, 0)), (200, None, (9, 9, 9)), (150, None, (1, 1, 1)), (190, None, (30, 10, 0))]
    return [
        _write(day / "roll-1.jsonl", [_meta("/home/u/Cdx"), no_info, {"type": "event_msg", "payload": {"type": "agent_message"}}, *[_count(i, *s) for i, s in enumerate(steps, 1)]]),
        _write(day / "roll-2.jsonl", [_count(1, 50, None, (1, 1, 1)), _count(2, 90, 40, (30, 10, 0))]),
        _write(day / "roll-3.jsonl", [_meta("/home/u/One"), _meta("/home/u/Two"), _count(1, 10, 10, (8, 2, 0))]),
        _write(day / "roll-4.jsonl", [_meta("/home/u/slash/"), _count(1, 10, 10, (8, 2, 0))]),
    ]


def test_codex(spark, codex_files):
    rows = session_logs.read_codex(spark, codex_files).collect()
    got = sorted((r.project, r.session, r.total_tokens) for r in rows)
    assert got == [("", "roll-4", 10), ("cdx", "roll-1", 5), ("cdx", "roll-1", 40), ("cdx", "roll-1", 60), ("cdx", "roll-1", 100), ("one", "roll-3", 10), ("roll-2", "roll-2", 40), ("two", "roll-3", 10)]
    assert {(r.model, r.cache_write_tokens, r.date) for r in rows} == {("", 0, "2026-03-15")}


def test_codex_without_fan_out(spark, codex_files):
    assert session_logs.read_codex(spark, codex_files, dedupe_session_meta=True).count() == 7


def test_gemini(spark, tmp_path):
    def chat(name, session, messages):
        path = tmp_path / ".gemini/tmp" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"sessionId": session, "messages": messages}, indent=2))
        return str(path)

    said = lambda model, at="2026-03-15T10:00", **t: {"timestamp": at, "model": model, "tokens": t}
    files = [
        chat("ab12" * 16 + "/chats/c1.json", "G1", [{"timestamp": "2026-03-15"}, said("gemini-2.5-pro", input=500, output=50, cached=200, total=760), said("gemini-2.5-flash", total=0), said("gemini-3.1-pro", None, input=3, total=3)]),
        chat("MyGem/chats/c2.json", "G2", [said("gemini-2.5-flash", "2026-03-18T00:00", input=5, output=6, cached=7, total=18)]),
        chat("MyGem/chats/c3.json", "G3", []),
    ]
    got = sorted((r.project, r.session, r.total_tokens, r.date, r.output_tokens, r.cache_read_tokens) for r in session_logs.read_gemini(spark, files).collect())
    assert got == [("ab12ab12", "G1", 3, None, 0, 0), ("ab12ab12", "G1", 760, "2026-03-15", 50, 200), ("mygem", "G2", 18, "2026-03-18", 6, 7)]


def test_no_files(spark):
    assert session_logs.read_all(spark, {}).count() == 0


def test_tally(spark, tmp_path):
    """Records read, malformed and too long, and rows kept, from the pass that gives the rows."""
    turn = {"type": "assistant", "sessionId": "s", "timestamp": "2026-03-15T01:02", "cwd": "/x/Proj", "message": {"model": "m", "usage": {"input_tokens": 1}}}
    long = json.dumps({**turn, "cwd": "/" + "y" * 400})
    log = tmp_path / "projects/p/a.jsonl"
    log.parent.mkdir(parents=True)
    log.write_text("\n".join([json.dumps(turn), "{cut", "", "  ", long, json.dumps({**turn, "type": "user"}), json.dumps({**turn, "isSidechain": "odd"})]))
    step = {"type": "event_msg", "timestamp": "2026-03-15T01", "payload": {"type": "token_count", "info": {"last_token_usage": {"total_tokens": 4}}}}
    (tmp_path / "roll.jsonl").write_text("\n".join([json.dumps(step), "nonsense"]))
    chats = tmp_path / ".gemini/tmp/g/chats"
    chats.mkdir(parents=True)
    (chats / "good.json").write_text(json.dumps({"sessionId": "g", "messages": [{"tokens": {"total": 3}}, {"tokens": {"total": 4}}]}, indent=1))
    (chats / "bad.json").write_text('{"sessionId": ')
    (chats / "long.json").write_text(json.dumps({"sessionId": "l", "messages": [{"tokens": {"total": 9}, "model": "z" * 400}]}))
    tally = session_logs.Tally()
    parts = [
        session_logs.read_claude(spark, [str(log)], tally, longest=300),
        session_logs.read_codex(spark, [str(tmp_path / "roll.jsonl")], tally),
        session_logs.read_gemini(spark, [str(p) for p in sorted(chats.iterdir())], tally, longest=300),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).collect()
    assert tally.counts() == {
        "Claude Code": {"read": 5, "malformed": 2, "too_long": 1, "kept": 2},
        "Codex": {"read": 2, "malformed": 1, "too_long": 0, "kept": 1},
        "Gemini": {"read": 3, "malformed": 1, "too_long": 1, "kept": 2},
    }
    assert sorted(r.total_tokens for r in rows) == [1, 1, 3, 4, 4]
    plan = parts[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
