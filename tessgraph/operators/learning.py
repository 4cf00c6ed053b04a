"""Learning the weights of a labeling model: joint feature vectors, gradients, updates, working sets, the training loop.

A weight vector is a model's size, whatever the data: it lives on the driver. What is summed over regions and edges
(psi, loss, inference) is a Spark job of one row per entry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

LOSSES = ("hinge", "log", "squared_hinge")


def score(w: np.ndarray, psi: np.ndarray) -> float:
    return float(w @ psi)


def margin(w: np.ndarray, truth: np.ndarray, guess: np.ndarray, loss: float) -> float:
    """By how much a guess, with its loss, outdoes the truth."""
    return loss + score(w, guess) - score(w, truth)


def gradient(w: np.ndarray, truth: np.ndarray, guess: np.ndarray, loss: float, kind: str = "hinge") -> np.ndarray:
    """Gradient of one example's loss: the difference of the joint feature vectors, as far as the margin is violated."""
    m = margin(w, truth, guess, loss)
    step = guess - truth
    if kind == "hinge":
        return step if m > 0 else np.zeros_like(step)
    if kind == "log":
        return step / (1 + np.exp(-np.clip(m, -500, 500)))
    if kind == "squared_hinge":
        return 2 * m * step if m > 0 else np.zeros_like(step)
    raise ValueError(f"unknown loss {kind}")


def mean_gradient(w: np.ndarray, truth: np.ndarray, kept: list[tuple[np.ndarray, float]], kind: str = "hinge") -> np.ndarray:
    """Average over a working set of (psi, loss); the hinge counts its violated members only."""
    used = [(p, x) for p, x in kept if kind != "hinge" or margin(w, truth, p, x) > 0]
    return sum((gradient(w, truth, p, x, kind) for p, x in used), np.zeros_like(w)) / max(len(used), 1)


def updated(w: np.ndarray, g: np.ndarray, rate: float, regularization: float = 0.0, momentum: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(new weights, step): w - step, step = rate * (g + regularization * w) + momentum's weight * its last step."""
    step = rate * (g + regularization * w)
    if momentum is not None:
        step = step + momentum[1] * momentum[0]
    return w - step, step


def projected(w: np.ndarray, most: float) -> np.ndarray:
    """Scaled to a sum of weights of at most most (the sum, not the norm: the defined behaviour); no bound if most <= 0."""
    total = w.sum()
    return w * (most / total) if most > 0 and total > most else w


def attractive(pairs: np.ndarray, margin: float = 1e-8) -> bool:
    """Whether two-class pair weights (level, 2 x 2) never favour unequal labels, cumulated over the levels."""
    d, a = np.cumsum(pairs[:, 0] + pairs[:, 3]), np.cumsum(pairs[:, 1] + pairs[:, 2])
    return not (a > d - margin).any()


@dataclass
class WorkingSet:
    """Violated labelings of one example: distinct joint feature vectors with their loss, at most capacity; the lowest margin goes first."""

    truth: np.ndarray
    capacity: int = 0
    rows: list[tuple[np.ndarray, float]] = field(default_factory=list)

    def add(self, w: np.ndarray, psi: np.ndarray, loss: float) -> bool:
        """Whether it was added: not if an equal vector is there."""
        if any(np.array_equal(p, psi) for p, _ in self.rows):
            return False
        self.rows.append((psi, loss))
        if 0 < self.capacity < len(self.rows):
            self.rows.pop(int(np.argmin([margin(w, self.truth, p, x) for p, x in self.rows])))
        return True

    def most_violated(self, w: np.ndarray) -> tuple[np.ndarray, float]:
        return max(self.rows, key=lambda r: margin(w, self.truth, *r))

    def __len__(self) -> int:
        return len(self.rows)


def best_iteration(trace: list[tuple[int, float]]) -> int:
    """The first iteration of the highest score."""
    return min(trace, key=lambda r: (-r[1], r[0]))[0]


def train(w: np.ndarray, truths: list[np.ndarray], oracle: Callable[[int, np.ndarray], tuple[np.ndarray, float]], iterations: int = 100, rate: float = 0.1, regularization: float = 0.0, kind: str = "hinge", most: float = 0.0,
          decay_after: int = 0, capacity: int = 0, momentum: float = 0.0) -> tuple[np.ndarray, list[float]]:
    """(weights, objective of every iteration) by stochastic gradient steps.

    oracle(example, w) gives the joint feature vector and loss of its most violating labeling: a Spark job per call. An
    iteration asks it for every example, keeps the answers in working sets, and updates after each example."""
    sets = [WorkingSet(t, capacity) for t in truths]
    last, trace = np.zeros_like(w), []
    for it in range(iterations):
        step = rate / (1 + it - decay_after) if decay_after and it >= decay_after else rate
        total = 0.0
        found = [oracle(k, w) for k in range(len(truths))]
        for k, (psi, loss) in enumerate(found):
            total += max(margin(w, truths[k], psi, loss), 0.0)
            sets[k].add(w, psi, loss)
            w, last = updated(w, mean_gradient(w, truths[k], sets[k].rows, kind), step, regularization, (last, momentum) if momentum else None)
            w = projected(w, most)
        trace.append(total + regularization / 2 * float(w @ w))
    return w, trace
