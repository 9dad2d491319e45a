"""Cheapest one-to-one assignment, by near candidates.

Every row first knows its cheapest partners only.  Shortest augmenting paths
with prices solve the assignment over these candidates; then all other pairs
are held against the prices, a few rows at a time.  A pair that the prices
don't rule out becomes a candidate and its row is assigned anew.  When none
is left, the prices bound every assignment from below by the cost found, so it
is the cheapest.  Memory grows with the candidates, not with all pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

NEAREST, ROWS, SLACK = 8, 256, 1e-9


class Assignment:
    """n rows and n partners; ``costs(rows)`` gives the costs of some rows with all
    partners.  ``of[i]`` is the partner of row i."""

    def __init__(self, n: int, costs: Callable[[np.ndarray], np.ndarray], nearest: int = NEAREST):
        self.n, self.costs = n, costs
        self.known: list[dict[int, float]] = [{} for _ in range(self.n)]
        self.u, self.v = np.zeros(self.n), np.zeros(self.n)
        self.of, self.to = [-1] * self.n, [-1] * self.n
        self.pending: list[int] = []
        self._meet(range(self.n), min(nearest, self.n))
        for i in range(self.n):
            j = min(self.known[i], key=lambda j: (self.known[i][j], j))
            self.u[i] = self.known[i][j]
            if self.to[j] < 0:
                self.of[i], self.to[j] = j, i
            else:
                self.pending.append(i)
        self.pending.reverse()
        while True:
            while self.pending:
                self._augment(self.pending.pop())
            if not self._doubtful():
                break

    @classmethod
    def of_points(cls, p: np.ndarray, q: np.ndarray, nearest: int = NEAREST) -> Assignment:
        """Points p to as many points q by distance."""
        return cls(len(p), lambda rows: np.hypot(p[rows, None, 0] - q[None, :, 0], p[rows, None, 1] - q[None, :, 1]), nearest)

    @property
    def cost(self) -> float:
        return float(sum(self.known[i][j] for i, j in enumerate(self.of)))

    @property
    def bound(self) -> float:
        """No assignment costs less, up to the slack of a pair each."""
        return float(self.u.sum() + self.v.sum())

    def _meet(self, rows, k: int) -> None:
        """The k nearest partners of rows become candidates."""
        rows = np.fromiter(rows, int)
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            d = self.costs(some)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            for i, js, ds in zip(some.tolist(), near.tolist(), np.take_along_axis(d, near, 1).tolist(), strict=True):
                self._learn(i, zip(js, ds, strict=True))

    def _learn(self, i: int, pairs) -> None:
        """New candidates of i; where one undercuts its price, i is assigned anew."""
        low = np.inf
        for j, d in pairs:
            self.known[i][j] = d
            low = min(low, d - self.v[j])
        if self.of[i] >= 0 and low < self.u[i] - SLACK / 2:
            self.to[self.of[i]] = -1
            self.of[i] = -1
            self.pending.append(i)
        if self.of[i] < 0:
            self.u[i] = min(self.u[i], low) if self.known[i] else low

    def _augment(self, start: int) -> None:
        if self.of[start] >= 0:
            return
        u, v = self.u, self.v
        best, back, done, heap = {}, {}, {}, []
        i, base = start, 0.0
        while True:
            for j, d in self.known[i].items():
                if j not in done:
                    reach = base + max(0.0, d - u[i] - v[j])
                    if reach < best.get(j, np.inf):
                        best[j], back[j] = reach, i
                        heapq.heappush(heap, (reach, j))
            while heap and (heap[0][1] in done or heap[0][0] > best[heap[0][1]]):
                heapq.heappop(heap)
            if not heap:  # these rows compete for fewer partners than they are: more candidates
                rows = [start, *(self.to[j] for j in done)]
                self.pending.append(start)
                self._meet(rows, min(self.n, 2 * max(len(self.known[r]) for r in rows)))
                return
            base, j = heapq.heappop(heap)
            done[j] = base
            if self.to[j] < 0:
                break
            i = self.to[j]
        for k, reach in done.items():
            if k != j:
                u[self.to[k]] += base - reach
                v[k] += reach - base
        u[start] += base
        while True:
            i = back[j]
            self.to[j], j, self.of[i] = i, self.of[i], j
            if i == start:
                break

    def _doubtful(self) -> bool:
        """Pairs that cost less than their prices become candidates."""
        for at in range(0, self.n, ROWS):
            d = self.costs(np.arange(at, min(self.n, at + ROWS)))
            under = d < self.u[at : at + ROWS, None] + self.v[None, :] - SLACK
            for r in np.flatnonzero(under.any(axis=1)).tolist():
                js = np.flatnonzero(under[r])
                self._learn(at + r, zip(js.tolist(), d[r, js].tolist(), strict=True))
        return bool(self.pending)
