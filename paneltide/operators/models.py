"""Jump regimes without outside libraries (boosting: ``boosting.py``; hidden-Markov regimes and the gate: ``regimes.py``)."""

from __future__ import annotations

import numpy as np


def jump_model(x: np.ndarray, states: int = 2, penalty: float = 50.0, starts: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(centres, labels) of least squared distance plus ``penalty`` a switch, the best of several random starts.

    Either is optimal given the other: labels by dynamic programming, centres as means. So the total falls until it stays.
    """
    rng = np.random.default_rng(seed)

    def descend(centres: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        total = np.inf
        while True:
            labels, now = switch_path(_squared(x, centres), penalty)
            if now >= total - 1e-12:
                return total, centres, labels
            total = now
            one = np.eye(states)[labels]
            size = one.sum(0)[:, None]
            centres = np.where(size > 0, one.T @ x / np.maximum(size, 1), centres)

    runs = [descend(x[rng.choice(len(x), states, replace=False)].astype(float)) for _ in range(starts)]
    return min(runs, key=lambda r: r[0])[1:]


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(2)


def switch_path(cost: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Cheapest path through states when each switch costs ``penalty``.

    From the end: what each state still costs from each row on. Then from the start: stay, unless another state is cheaper
    by more than the price of a switch.
    """
    to_go = cost.astype(float)
    for i in range(len(cost) - 2, -1, -1):
        to_go[i] += np.minimum(to_go[i + 1], to_go[i + 1].min() + penalty)
    path = np.zeros(len(cost), np.int64)
    path[0] = to_go[0].argmin()
    for i in range(1, len(cost)):
        cheapest = to_go[i].argmin()
        path[i] = path[i - 1] if to_go[i, path[i - 1]] <= to_go[i, cheapest] + penalty else cheapest
    return path, float(to_go[0].min())


def online_states(x: np.ndarray, centres: np.ndarray, penalty: float) -> np.ndarray:
    """State by state, knowing only the past: the nearest centre, where leaving the last state costs ``penalty``."""
    cost = _squared(x, centres)
    out = [int(cost[0].argmin())] if len(x) else []
    for row in cost[1:]:
        best = int(row.argmin())
        out.append(best if row[best] + penalty < row[out[-1]] else out[-1])
    return np.array(out, np.int64)
