"""Minimum-cost pairing of the rows that two copies hold under one key.

The number of differing fields is least; of pairings with the same number the one in which the first field differs least often is
taken, then the second field, and so on. So how often each field differs doesn't depend on the order of rows or the way of solving.
"""

from __future__ import annotations

import heapq
from itertools import combinations

import numpy as np


def weights(fields: int, pairs: int) -> list[int]:
    """Cost of a difference in each field, so that sums over so many pairs compare like (differences, those of the first field, ...)."""
    base = pairs + 1
    return [base**fields + base ** (fields - 1 - f) for f in range(fields)]


def _hungarian(left: np.ndarray, right: np.ndarray, cost_of: list[int]) -> np.ndarray:
    """For each left row (not more of them than right rows) its right row at the least cost.
    Costs are made a row at a time, so memory stays in proportion to the rows."""
    n, m = len(left), len(right)
    far = 4 * (n + 2) * (sum(cost_of) + 1)
    kind = np.int64 if far < 2**62 else object  # whole numbers of any size where 64 bits don't hold the sums
    weight = np.array(cost_of, dtype=kind)
    u, v = np.zeros(n + 1, dtype=kind), np.zeros(m + 1, dtype=kind)
    owner, way = np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
    for i in range(1, n + 1):
        owner[0], col = i, 0
        best, used = np.full(m + 1, far, dtype=kind), np.zeros(m + 1, dtype=bool)
        while True:
            used[col] = True
            row = owner[col]
            cost = ((left[row - 1] != right) * weight).sum(axis=1) - u[row] - v[1:]
            better = ~used[1:] & (cost < best[1:])
            best[1:][better], way[1:][better] = cost[better], col
            free = np.where(used[1:], far, best[1:])
            step = int(free.argmin()) + 1
            delta = free[step - 1]
            u[owner[used]] += delta
            v[used] -= delta
            best[~used] -= delta
            col = step
            if owner[col] == 0:
                break
        while col:
            owner[col], col = owner[way[col]], way[col]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _parts(left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows joined through equal field values. Rows of different parts agree in nothing, so parts are solved on their own."""
    rows = np.vstack([left, right])
    label = np.arange(len(rows))
    while True:
        before = label.copy()
        for f in range(rows.shape[1]):
            least = np.full(rows[:, f].max() + 1, len(rows))
            np.minimum.at(least, rows[:, f], label)
            label = np.minimum(label, least[rows[:, f]])
        if (label == before).all():
            break
    cut = len(left)
    return [(np.flatnonzero(label[:cut] == p), np.flatnonzero(label[cut:] == p)) for p in np.unique(label)]


#: Pairs up to which costs are taken row by row, and fields up to which a flow over shared values is used beyond that.
DENSE_PAIRS, FLOW_FIELDS = 250_000, 8


class _Flow:
    """Cheapest largest flow of unit edges with small whole costs: potentials, and Dinic's levels over edges without reduced cost."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)

    def run(self, source: int, sink: int) -> None:
        to, room, cost, out = self.to, self.room, self.cost, self.out
        height = [0] * len(out)
        while True:
            far = [-1] * len(out)
            heap = [(0, source)]
            while heap:
                d, x = heapq.heappop(heap)
                if far[x] >= 0:
                    continue
                far[x] = d
                for e in out[x]:
                    if room[e] and far[to[e]] < 0:
                        heapq.heappush(heap, (d + cost[e] + height[x] - height[to[e]], to[e]))
            if far[sink] < 0:
                return
            for x, d in enumerate(far):
                height[x] += d if 0 <= d < far[sink] else far[sink]
            while self._block(source, sink, height):
                pass

    def _block(self, source: int, sink: int, height: list[int]) -> bool:
        """One blocking flow over the levels of edges without reduced cost; whether it moved anything."""
        to, room, cost, out = self.to, self.room, self.cost, self.out
        level = [-1] * len(out)
        level[source], wave = 0, [source]
        while wave and level[sink] < 0:
            ahead = []
            for x in wave:
                for e in out[x]:
                    y = to[e]
                    if room[e] and level[y] < 0 and cost[e] + height[x] == height[y]:
                        level[y] = level[x] + 1
                        ahead.append(y)
            wave = ahead
        if level[sink] < 0:
            return False
        at, path, x, moved = [0] * len(out), [], source, False
        while True:
            if x == sink:
                for e in path:
                    room[e] -= 1
                    room[e ^ 1] += 1
                moved, path, x = True, [], source
            while at[x] < len(out[x]):
                e = out[x][at[x]]
                y = to[e]
                if room[e] and level[y] == level[x] + 1 and cost[e] + height[x] == height[y]:
                    break
                at[x] += 1
            else:
                if x == source:
                    return moved
                e = path.pop()
                x = to[e ^ 1]
                at[x] += 1
                continue
            path.append(e)
            x = y


def _flow_pairs(left: np.ndarray, right: np.ndarray, cost_of: list[int]) -> list[tuple[int, int]]:
    """Cheapest pairing through nodes for shared values: a row may pass through any set of its field values that the other side
    has as well, at the cost of the fields outside the set. Edges grow with the rows, not with their pairs."""
    n, m, fields = len(left), len(right), left.shape[1]
    source, sink = 0, n + m + 1
    links = [(np.zeros(n, dtype=np.int64), np.zeros(m, dtype=np.int64), sum(cost_of), 1)]
    for size in range(1, fields + 1):
        for chosen in combinations(range(fields), size):
            _, group = np.unique(np.vstack([left[:, chosen], right[:, chosen]]), axis=0, return_inverse=True)
            group = group.ravel()
            both = np.intersect1d(group[:n], group[n:])
            place = np.full(group.max() + 1, -1)
            place[both] = np.arange(len(both))
            links.append((place[group[:n]], place[group[n:]], sum(c for f, c in enumerate(cost_of) if f not in chosen), len(both)))
    flow = _Flow(sink + 1 + sum(k for *_, k in links))
    for i in range(n):
        flow.edge(source, 1 + i, 1, 0)
    for j in range(m):
        flow.edge(1 + n + j, sink, 1, 0)
    base = sink + 1
    for mine, theirs, cost, k in links:
        for i in np.flatnonzero(mine >= 0):
            flow.edge(1 + int(i), base + int(mine[i]), 1, cost)
        for j in np.flatnonzero(theirs >= 0):
            flow.edge(base + int(theirs[j]), 1 + n + int(j), 1, 0)
        base += k
    flow.run(source, sink)
    come: dict[int, list[int]] = {}
    for i in range(n):
        for e in flow.out[1 + i]:
            if e % 2 == 0 and flow.room[e] == 0:
                come.setdefault(flow.to[e], []).append(i)
    pairs = []
    for node, rows in come.items():
        gone = [flow.to[e] - 1 - n for e in flow.out[node] if e % 2 == 0 and flow.room[e] == 0]
        pairs += zip(rows, gone)
    return pairs


def pair_rows(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs min(len) rows of two integer-coded arrays (equal code: equal value) at the least cost (see above).

    Both ways are exact and differ in speed only. Large parts go to a flow whose size follows the rows; row-by-row costs remain for
    small parts and for more fields than FLOW_FIELDS."""
    pairs: list[tuple[int, int]] = []
    cost_of = weights(left.shape[1], min(len(left), len(right)))
    for a, b in _parts(left, right):
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) > DENSE_PAIRS and left.shape[1] <= FLOW_FIELDS:
            pairs += [(int(a[i]), int(b[j])) for i, j in _flow_pairs(left[a], right[b], cost_of)]
        else:
            swap = len(a) > len(b)
            x, y = (b, a) if swap else (a, b)
            for i, j in enumerate(_hungarian((right if swap else left)[x], (left if swap else right)[y], cost_of)):
                pairs.append((int(y[j]), int(x[i])) if swap else (int(x[i]), int(y[j])))
    taken_l, taken_r = {i for i, _ in pairs}, {j for _, j in pairs}
    rest_l, rest_r = [i for i in range(len(left)) if i not in taken_l], [j for j in range(len(right)) if j not in taken_r]
    return pairs + list(zip(rest_l, rest_r))
