"""A robust-pruned directed graph over the vectors of one shard, in numpy.

Points are inserted in batches.  A beam search for each point over the graph so
far proposes its neighbours; relaxed distance pruning keeps the nearest and of
the rest those that no kept one is nearer to by the factor ``ALPHA``; kept
edges are added in reverse and lists that overflow are pruned alike.  Searches
of a batch advance in lock-step, so each step is a few array operations.
"""

from __future__ import annotations

import numpy as np

DEGREE = 24
BEAM = 32
WIDTH = 4  # nodes a search expands in one step
ALPHA = 1.5
ENTRIES = 48
BATCH = 512
PASSES = 2


def _robust_prune(x: np.ndarray, points: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Out-neighbours (-1: none) of ``points`` from candidates ``ids`` (-1: none) at squared distance ``dist``."""
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    # A candidate that occurs twice counts once.
    by_id = np.argsort(ids, axis=1, kind="stable")
    sorted_ids = np.take_along_axis(ids, by_id, 1)
    again = np.zeros(ids.shape, bool)
    np.put_along_axis(again, by_id[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
    alive = (ids >= 0) & ~again & (ids != points[:, None])
    v = x[np.maximum(ids, 0)]
    between = 2.0 - 2.0 * np.matmul(v, v.transpose(0, 2, 1))
    out = np.full((len(points), DEGREE), -1, np.int32)
    rows = np.arange(len(points))
    for k in range(DEGREE):
        some = alive.any(axis=1)
        if not some.any():
            break
        nearest = alive.argmax(axis=1)
        out[some, k] = ids[rows[some], nearest[some]]
        covered = ALPHA * ALPHA * between[rows, nearest] <= dist
        alive &= ~covered
        alive[rows, nearest] = False
    return out


def search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, start: np.ndarray | None = None, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query (-1: none) and their squared distances."""
    n, q = len(x), len(queries)
    rows = np.arange(q)[:, None]
    first = np.broadcast_to(entries, (q, len(entries)))
    if start is not None:
        first = np.concatenate([first, start[:, None]], axis=1)
    seen = np.zeros((q, n + 1), bool)  # the last column takes what is no node
    seen[:, n] = True
    ids = np.full((q, beam), -1, np.int32)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)

    def merge(more: np.ndarray) -> None:
        nonlocal ids, dist, done
        more = np.where(more < 0, n, more)
        new = ~seen[rows, more]
        seen[rows, more] = True
        if not new.any():
            return
        # Twins inside one step: only the first of equal ids counts.
        by_id = np.argsort(more, axis=1, kind="stable")
        s = np.take_along_axis(more, by_id, 1)
        twin = np.zeros(more.shape, bool)
        np.put_along_axis(twin, by_id[:, 1:], s[:, 1:] == s[:, :-1], 1)
        new &= ~twin
        r, c = np.nonzero(new)
        d = np.full(more.shape, np.inf, np.float32)
        d[r, c] = 2.0 - 2.0 * np.einsum("ij,ij->i", x[more[r, c]], queries[r])
        all_ids = np.concatenate([ids, np.where(new, more, -1).astype(np.int32)], axis=1)
        all_dist = np.concatenate([dist, d], axis=1)
        all_done = np.concatenate([done, ~new], axis=1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        ids, dist, done = (np.take_along_axis(a, best, 1) for a in (all_ids, all_dist, all_done))

    merge(first)
    while True:
        open_dist = np.where(done, np.inf, dist)
        if not np.isfinite(open_dist).any():
            break
        w = min(WIDTH, beam)
        pick = np.argpartition(open_dist, w - 1, axis=1)[:, :w]
        chosen = np.where(np.isfinite(np.take_along_axis(open_dist, pick, 1)), np.take_along_axis(ids, pick, 1), -1)
        np.put_along_axis(done, pick, True, 1)
        out = np.where(chosen[:, :, None] >= 0, graph[np.maximum(chosen, 0)], -1).reshape(q, -1)
        merge(out)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def build(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Graph (n x DEGREE, -1: none) and entry nodes of unit vectors ``x``."""
    n = len(x)
    rng = np.random.default_rng(seed)
    entries = np.sort(rng.permutation(n)[:ENTRIES]).astype(np.int32)
    graph = np.full((n, DEGREE), -1, np.int32)
    if n < 2:
        return graph, entries
    half = min(DEGREE // 2, n - 1)
    graph[:, :half] = (np.arange(n)[:, None] + rng.integers(1, n, (n, half))) % n
    order = rng.permutation(n).astype(np.int32)
    for _ in range(PASSES):
        for at in range(0, n, BATCH):
            batch = order[at : at + BATCH]
            found, dist = search(x, graph, entries, x[batch])
            old = graph[batch]
            old_dist = np.where(old >= 0, 2.0 - 2.0 * np.einsum("ijk,ik->ij", x[np.maximum(old, 0)], x[batch]), np.inf)
            graph[batch] = _robust_prune(x, batch, np.concatenate([found, old], 1), np.concatenate([dist, old_dist.astype(np.float32)], 1))
            _add_reverse(x, graph, batch)
    return graph, entries


def _add_reverse(x: np.ndarray, graph: np.ndarray, batch: np.ndarray) -> None:
    """Give the out-neighbours of ``batch`` an edge back."""
    head = graph[batch].ravel()
    tail = np.repeat(batch, DEGREE)[head >= 0]
    head = head[head >= 0]
    order = np.argsort(head, kind="stable")
    head, tail = head[order], tail[order]
    start = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    nodes = head[start]
    slot = np.arange(len(head)) - np.repeat(start, np.diff(np.append(start, len(head))))
    most = 2 * DEGREE  # a node that is given more in one batch takes the nearest of each round of this many
    for base in range(0, int(slot.max()) + 1 if len(slot) else 0, most):
        now = (slot >= base) & (slot < base + most)
        which = np.searchsorted(nodes, head[now])
        rows = np.unique(which)
        more = np.full((len(rows), most), -1, np.int32)
        more[np.searchsorted(rows, which), slot[now] - base] = tail[now]
        points = nodes[rows]
        ids = np.concatenate([graph[points], more], axis=1)
        dist = np.where(ids >= 0, 2.0 - 2.0 * np.einsum("ijk,ik->ij", x[np.maximum(ids, 0)], x[points]), np.inf).astype(np.float32)
        graph[points] = _robust_prune(x, points, ids, dist)
