"""The usage chart as an SVG file: columns by project for up to three dates, else areas by day; one colour a tool, stacked.

Only chart data comes here, rows of (date or project, tool, cost) that Spark has added up. Every mark says its value when pointed
at; light and dark surfaces have their own steps of the same colours.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from html import escape

from tallymill.functions.formatting import card_cost, short_date
from tallymill.plans.charts import chart_kind

WIDTH, HEIGHT = 1200, 675
LEFT, RIGHT, TOP, BOTTOM = 90, 40, 150, 60
#: Each tool's class, in the order in which tools are stacked; the colours of light and of dark surfaces.
TOOLS = {"Claude Code": "a", "Codex": "b", "Gemini": "c"}
LIGHT = {"surface": "#fcfcfb", "ink": "#0b0b0b", "quiet": "#52514e", "line": "#dddcd8", "a": "#2a78d6", "b": "#eb6834", "c": "#1baf7a"}
DARK = {"surface": "#1a1a19", "ink": "#ffffff", "quiet": "#c3c2b7", "line": "#3a3a38", "a": "#3987e5", "b": "#d95926", "c": "#199e70"}


def _style() -> str:
    def rules(colours: dict[str, str]) -> str:
        marks = "".join(f".{k}{{fill:{colours[k]};stroke:{colours['surface']};stroke-width:2}}" for k in TOOLS.values())
        return f".s{{fill:{colours['surface']}}}.i{{fill:{colours['ink']}}}.q{{fill:{colours['quiet']}}}.g{{stroke:{colours['line']}}}{marks}"

    text = "text{font-family:system-ui,sans-serif;font-size:15px}.h{font-size:34px;font-weight:600}.hit{fill:transparent}"
    return f"<style>{text}{rules(LIGHT)}@media (prefers-color-scheme:dark){{{rules(DARK)}}}</style>"


def _text(x: float, y: float, words: str, kind: str = "q", anchor: str = "start") -> str:
    return f'<text class="{kind}" x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}">{escape(words)}</text>'


def ticks(most: float, count: int = 4) -> list[float]:
    """Round values from 0 to just above `most`."""
    if most <= 0:
        return [0.0, 1.0]
    size = 10.0 ** math.floor(math.log10(most / count))
    step = next(k * size for k in (1, 2, 5, 10) if k * size * count >= most)
    return [step * k for k in range(int(-(-most // step)) + 1)]


def stacks(rows: Sequence[tuple[str, str, float]], keys: Sequence[str]) -> dict[str, list[tuple[str, float, float]]]:
    """By key the tools with a cost: name, where it begins and where it ends on the stack. Other tools than the known ones come last."""
    cost: dict[tuple[str, str], float] = {}
    for key, tool, value in rows:
        cost[key, tool] = cost.get((key, tool), 0.0) + (value or 0.0)
    names = [*TOOLS, *sorted({t for _, t in cost} - TOOLS.keys())]
    out: dict[str, list[tuple[str, float, float]]] = {}
    for key in keys:
        at, out[key] = 0.0, []
        for tool in names:
            value = cost.get((key, tool), 0.0)
            out[key].append((tool, at, at + value))
            at += value
    return out


def _plot(piled: dict[str, list[tuple[str, float, float]]], labels: dict[str, str], area: bool) -> str:
    most = max((parts[-1][2] for parts in piled.values() if parts), default=0.0)
    marks = ticks(most)
    width, height = WIDTH - LEFT - RIGHT, HEIGHT - TOP - BOTTOM
    y = lambda v: TOP + height * (1 - v / marks[-1])
    out = []
    for v in marks:
        out.append(f'<line class="g" x1="{LEFT}" x2="{WIDTH - RIGHT}" y1="{y(v):.1f}" y2="{y(v):.1f}"/>')
        out.append(_text(LEFT - 12, y(v) + 5, card_cost(v) if v else "", "q", "end"))
    keys = list(piled)
    slot = width / max(1, len(keys))
    middle = {k: LEFT + slot * (i + 0.5) for i, k in enumerate(keys)}
    if area:
        for n in range(len(piled[keys[0]])):
            tool = piled[keys[0]][n][0]
            above = [f"{middle[k]:.1f},{y(piled[k][n][2]):.1f}" for k in keys]
            below = [f"{middle[k]:.1f},{y(piled[k][n][1]):.1f}" for k in reversed(keys)]
            out.append(f'<polygon class="{TOOLS.get(tool, "q")}" points="{" ".join(above + below)}"/>')
        for k in keys:
            told = "\n".join(f"{t}: {card_cost(hi - lo)}" for t, lo, hi in piled[k] if hi > lo)
            out.append(f'<rect class="hit" x="{middle[k] - slot / 2:.1f}" y="{TOP}" width="{slot:.1f}" height="{height}"><title>{escape(labels[k])}\n{escape(told)}</title></rect>')
    else:
        wide = min(0.6 * slot, 90)
        for k in keys:
            for tool, lo, hi in piled[k]:
                if hi > lo:
                    box = f'x="{middle[k] - wide / 2:.1f}" y="{y(hi):.1f}" width="{wide:.1f}" height="{y(lo) - y(hi):.1f}"'
                    out.append(f'<rect class="{TOOLS.get(tool, "q")}" {box}><title>{escape(labels[k])}\n{escape(tool)}: {card_cost(hi - lo)}</title></rect>')
    every = max(1, -(-len(keys) // 10)) if len(keys) > 14 or not area else 1
    out += [_text(middle[k], HEIGHT - BOTTOM + 28, labels[k], "q", "middle") for k in keys[::every]]
    return "".join(out)


def chart(headline: str, notes: Sequence[str], daily: Sequence[tuple[str | None, str, float]], projects: Sequence[tuple[str | None, str, float]]) -> str | None:
    """The chart as text; None where nothing costs anything. `daily`: date, tool, cost; `projects`: the same by project, costliest first."""
    dates = sorted({d for d, _, _ in daily if d})
    area = chart_kind(len(dates)) == "area"
    if area:
        keys, rows = dates, [(d, t, c) for d, t, c in daily if d]
    else:
        keys, rows = list(dict.fromkeys(p for p, _, _ in projects if p is not None)), [(p, t, c) for p, t, c in projects if p is not None]
    if not keys or not any(c for *_, c in rows):
        return None
    labels = {k: short_date(k) if area and k[4:5] == k[7:8] == "-" and k.replace("-", "").isdigit() else k[:18] for k in keys}
    piled = stacks(rows, keys)
    legend, at = [], LEFT
    for tool in [t for t, *_ in next(iter(piled.values()))]:
        total = sum(hi - lo for parts in piled.values() for t, lo, hi in parts if t == tool)
        if total:
            words = f"{tool} {card_cost(total)}"
            legend.append(f'<rect class="{TOOLS.get(tool, "q")}" x="{at}" y="104" width="16" height="16" rx="4"/>{_text(at + 24, 117, words, "i")}')
            at += 60 + 9 * len(words)
    title = _text(LEFT, 60, headline, "i h")
    body = f"{title}{_text(LEFT, 88, ' · '.join(notes))}{''.join(legend)}{_plot(piled, labels, area)}"
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" role="img" aria-label="{escape(headline)}">{_style()}<rect class="s" width="{WIDTH}" height="{HEIGHT}"/>{body}</svg>'
