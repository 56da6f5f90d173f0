"""Monthly prices of subscriptions, from what the tools' usage commands report."""

from __future__ import annotations

import json
import re
import shlex
import subprocess
import sys
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

#: USD a month by plan, and the plans that one tool prices differently.
PRICES = {"pro": 20, "max_5x": 100, "max_20x": 200, "plus": 20, "ultra": 250, "free": 0}
OWN = {("Codex", "pro"): 200, ("Codex", "plus"): 20}
#: What else a report may call a plan: a prefix before the name, and names of tiers.
PREFIX, TIERS = "default_claude_", {"g1-pro-tier": "pro", "g1-ultra-tier": "ultra"}
#: Python modules that print a tool's plan when run with `json`.
MODULES = {"Claude Code": "ccusage", "Codex": "codex_cli_usage", "Gemini": "gemini_cli_usage"}
SECONDS = 10


#: Every form in which a report may name a plan, and the plan.
_FORMS = re.compile("|".join(re.escape(x) for x in (PREFIX, *TIERS)))


def plan_name(told: str) -> str:
    """A plan's own name: tiers are named by their plan, and the prefix goes."""
    return _FORMS.sub(lambda form: TIERS.get(form[0], ""), told)


def price(tool: str, plan: str) -> int:
    """USD a month; 0 for a plan without a known price."""
    return OWN.get((tool, plan), PRICES.get(plan, 0))


@dataclass(frozen=True)
class Report:
    """What a usage command says, in the two forms there are: a plan, or the tier of a quota."""

    plan: str | None
    tier: str | None

    @classmethod
    def parse(cls, text: str) -> Report | None:
        """None for text that is no JSON object, or whose fields are of another kind."""
        try:
            data = json.loads(text)
        except ValueError:
            return None
        quota = data.get("account_quota") if isinstance(data, dict) else None
        if not isinstance(data, dict) or not isinstance(quota, dict | None):
            return None
        named = (data.get("plan") or None, (quota or {}).get("user_tier") or None)
        return cls(*named) if all(isinstance(x, str | None) for x in named) else None


def plan_of(tool: str, text: str) -> tuple[str, int] | None:
    """Plan and price from a report; None if it is not one. A report that names no plan has one called unknown."""
    if (report := Report.parse(text)) is None:
        return None
    plan = plan_name(report.plan or report.tier or "unknown")
    return plan, price(tool, plan)


def default_commands() -> dict[str, str]:
    """The usage commands of the three tools, by tool."""
    return {tool: shlex.join([sys.executable, "-m", module, "json"]) for tool, module in MODULES.items()}


def detect(reports: dict[str, str | None]) -> dict[str, tuple[str, int]]:
    """Plans by tool; tools without a usable report are left out."""
    found = {tool: plan_of(tool, text) for tool, text in reports.items() if text is not None}
    return {tool: plan for tool, plan in found.items() if plan is not None}


def printed(command: str) -> str | None:
    """What a usage command prints; None where it is missing, fails or takes too long."""
    try:
        done = subprocess.run(shlex.split(command), capture_output=True, text=True, timeout=SECONDS)
    except (OSError, ValueError, subprocess.TimeoutExpired):
        return None
    return None if done.returncode else done.stdout


def reports(commands: dict[str, str], run: Callable[[str], str | None] = printed) -> dict[str, str | None]:
    """The tools' reports by the given commands, asked for at the same time. `run` gives a command's output and may be replaced."""
    with ThreadPoolExecutor(max(1, len(commands))) as pool:
        return dict(zip(commands, pool.map(run, commands.values()), strict=True))
