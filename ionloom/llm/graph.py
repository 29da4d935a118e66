"""A robust-pruned directed graph over the vectors of one shard, built and searched for many vectors at once."""

from __future__ import annotations

import numpy as np


class ShardGraph:
    """Vamana-style graph on unit vectors: greedy searches propose neighbours, relaxed pruning keeps diverse edges.

    ``degree``: edges a node keeps; ``alpha``: a candidate is pruned if it is alpha times closer to a kept edge than
    to the node; ``beam``: nodes a search keeps. All steps are array operations over blocks of vectors.
    """

    def __init__(self, x: np.ndarray, degree: int = 32, alpha: float = 1.1, beam: int = 48, seed: int = 7, block: int = 256):
        self.x, self.degree, self.alpha2, self.block = np.ascontiguousarray(x, dtype=np.float32), degree, alpha * alpha, block
        n = len(x)
        rng = np.random.default_rng(seed)
        self.edges = np.full((n, degree), -1, dtype=np.int32)
        if n > 1:
            first = min(degree, n - 1)
            self.edges[:, :first] = (np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, (n, first))) % n
        centre = self.x.mean(axis=0) if n else np.zeros(x.shape[1], np.float32)
        starts = [int((self.x @ centre).argmax())] if n else []
        starts += rng.integers(0, n, 7).tolist() if n else []
        self.starts = np.unique(np.array(starts, dtype=np.int32))
        order = rng.permutation(n)
        for i in range(0, n, block):
            self._insert(order[i : i + block], beam)

    def _insert(self, nodes: np.ndarray, beam: int) -> None:
        found, sims = self.search(self.x[nodes], beam, own=nodes)
        old = self.edges[nodes]
        own = np.einsum("bkd,bd->bk", self.x[old], self.x[nodes])
        cand = np.concatenate([found, old], axis=1)
        sim = np.concatenate([sims, np.where(old < 0, -np.inf, own)], axis=1)
        sim[cand == nodes[:, None]] = -np.inf
        self.edges[nodes] = self._prune(cand, sim)
        # reverse edges: every neighbour hears of its new neighbour, and prunes if it has too many
        into = self.edges[nodes]
        src, dst = np.repeat(nodes, self.degree), into.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.lexsort((src, dst))
        src, dst = src[order], dst[order]
        targets, start, count = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(targets), 4 * self.block):
            t, s, c = (a[lo : lo + 4 * self.block] for a in (targets, start, count))
            width = int(min(c.max(), 2 * self.degree))
            col = np.arange(width)
            new = np.where(col < c[:, None], src[np.minimum(s[:, None] + col, len(src) - 1)], -1)
            cand = np.concatenate([self.edges[t], new], axis=1)
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            sim = np.where(cand < 0, -np.inf, np.einsum("bkd,bd->bk", self.x[cand], self.x[t]))
            full = (cand >= 0).sum(axis=1) > self.degree
            if full.any():
                self.edges[t[full]] = self._prune(cand[full], sim[full])
            rest = cand[~full]
            keep = np.argsort(rest < 0, axis=1, kind="stable")[:, : self.degree]
            self.edges[t[~full]] = np.take_along_axis(rest, keep, axis=1)

    def _prune(self, cand: np.ndarray, sim: np.ndarray) -> np.ndarray:
        """The diverse nearest ``degree`` of each row's candidates (-inf: none), closest first."""
        order = np.argsort(-sim, axis=1, kind="stable")[:, : 3 * self.degree]
        cand, sim = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sim, order, axis=1)
        alive = np.isfinite(sim)
        vectors = self.x[np.maximum(cand, 0)]
        among = 1 - np.matmul(vectors, vectors.transpose(0, 2, 1))
        far = 1 - sim
        out = np.full((len(cand), self.degree), -1, dtype=np.int32)
        used = np.zeros(len(cand), dtype=np.int64)
        kept = np.zeros(cand.shape, dtype=bool)
        for c in range(cand.shape[1]):
            take = np.flatnonzero(alive[:, c] & (used < self.degree))
            if not len(take):
                continue
            out[take, used[take]] = cand[take, c]
            used[take] += 1
            alive[take] &= self.alpha2 * among[take, c] > far[take]
            kept[take, c] = True
        # slots that the diverse edges leave free go to the closest of the others
        spare = np.argsort(kept | ~np.isfinite(sim), axis=1, kind="stable")
        rest = np.where(np.take_along_axis(kept | ~np.isfinite(sim), spare, axis=1), -1, np.take_along_axis(cand, spare, axis=1))
        at = np.arange(self.degree) - used[:, None]
        fill = np.take_along_axis(rest, np.clip(at, 0, rest.shape[1] - 1), axis=1)
        return np.where(at < 0, out, np.where(at < rest.shape[1], fill, -1)).astype(np.int32)

    def search(self, queries: np.ndarray, beam: int, width: int = 4, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(node, similarity) of the ``beam`` best nodes found for each query, best first; -1 where there are fewer.

        ``own``: the node that a query is itself (-1: none), where its search begins as well.
        """
        queries = np.ascontiguousarray(queries, dtype=np.float32)
        ids = np.full((len(queries), beam), -1, dtype=np.int32)
        sims = np.full((len(queries), beam), -np.inf, dtype=np.float32)
        for lo in range(0, len(queries), self.block):
            part = slice(lo, lo + self.block)
            ids[part], sims[part] = self._search(queries[part], beam, width, None if own is None else own[part])
        return ids, sims

    def _search(self, q: np.ndarray, beam: int, width: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        m, n = len(q), len(self.x)
        seen = np.zeros((m, n + 1), dtype=bool)  # the last column stands for "no node"
        seen[:, n] = True
        ids = np.full((m, beam), -1, dtype=np.int32)
        sims = np.full((m, beam), -np.inf, dtype=np.float32)
        done = np.ones((m, beam), dtype=bool)
        rows, fresh = np.arange(m), np.broadcast_to(self.starts, (m, len(self.starts)))
        if own is not None:
            fresh = np.concatenate([fresh, own[:, None]], axis=1)
        while len(rows):
            near = np.where(fresh < 0, n, fresh)
            near = np.sort(near, axis=1)
            new = ~seen[rows[:, None], near]
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[rows[:, None], near] = True
            r, c = np.nonzero(new)
            value = np.full(near.shape, -np.inf, dtype=np.float32)
            value[r, c] = np.einsum("ed,ed->e", self.x[near[r, c]], q[rows[r]])
            all_ids = np.concatenate([ids[rows], np.where(new, near, -1)], axis=1)
            all_sims = np.concatenate([sims[rows], value], axis=1)
            all_done = np.concatenate([done[rows], ~new], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam] if all_sims.shape[1] > beam else np.broadcast_to(np.arange(all_sims.shape[1]), all_sims.shape)
            order = np.argsort(-np.take_along_axis(all_sims, top, axis=1), axis=1, kind="stable")
            top = np.take_along_axis(top, order, axis=1)
            k = top.shape[1]
            ids[rows, :k], sims[rows, :k], done[rows, :k] = (np.take_along_axis(a, top, axis=1) for a in (all_ids, all_sims, all_done))
            left = ~done[rows]
            go = left.any(axis=1)
            rows, left = rows[go], left[go]
            if not len(rows):
                break
            pick = np.argsort(~left, axis=1, kind="stable")[:, :width]  # the best that aren't expanded yet
            valid = np.take_along_axis(left, pick, axis=1)
            node = ids[rows[:, None], pick]
            done[rows[:, None], pick] = True
            fresh = np.where(valid[:, :, None], self.edges[node], -1).reshape(len(rows), -1)
        return ids, sims
