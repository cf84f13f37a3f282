"""The weekly report and the gate over the operational figures."""

from __future__ import annotations

import html
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame


def gate(checks: Sequence[bool | None], days: int | None, least_days: int = 28) -> bool | None:
    """Whether all checks hold; unknown before the pilot has run ``least_days`` days or while a check has no data."""
    if days is None or days < least_days or any(c is None for c in checks):
        return None
    return all(checks)


def _word(ready: bool | None) -> str:
    return "no data" if ready is None else "met" if ready else "not met"


def weekly(day: date, excess: DataFrame, episodes: dict | None, ready: bool | None, proof_days: int, tracking: dict | None, tolerance: float = 0.005) -> tuple[str, str]:
    """(Markdown, message) of a week.

    ``excess``: rows of ``ops.weekly_excess``, one for each portfolio; ``episodes``: episodes, rate and ready of ``ops.episode_gate``;
    ``tracking``: status, n and difference of ``ops.tracking``. What is missing is said to be so, and portfolios come by name.
    """
    rows = excess.orderBy("portfolio").collect()
    known = episodes or {"episodes": 0, "rate": 0.0, "ready": False}
    head = [f"proof days: {proof_days}", f"episodes: {known['episodes']}, positive {known['rate']:.1%}", f"operations gate: {_word(ready)}"]
    if tracking and tracking["status"] == "ok":
        gap = tracking["difference"]
        head.append(f"real basket against proxy: {gap * 100:+.2f} pp over {tracking['n']} days ({_word(abs(gap) <= tolerance)})")
    else:
        head.append(f"real basket against proxy: not assessed ({tracking['status'] if tracking else 'no data'})")
    if known["ready"]:
        head.append("enough episodes are positive: decide on real capital")
    table = ["| portfolio | return % | excess pp | equity |", "|---|---:|---:|---:|"]
    table += [f"| {x['portfolio']} | {x['ret'] * 100:.2f} | {x['excess'] * 100:+.2f} | {x['latest']:.2f} |" for x in rows]
    lines = [f"# Week to {day}", "", *[f"- {x}" for x in head], "", *table]
    message = [f"<b>Week to {day}</b>", *head, *[f"{html.escape(x['portfolio'])}: {x['ret'] * 100:.2f} % ({x['excess'] * 100:+.2f} pp)" for x in rows]]
    return "\n".join(lines) + "\n", "\n".join(message)
