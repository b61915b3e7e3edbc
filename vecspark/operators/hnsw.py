"""Hierarchical navigable small-world graphs over one shard of vectors, built and searched with arrays.

Levels are drawn as floor(-ln(u) / ln(M)). Nodes are inserted in order, a block at a time: in each level
up to its own a node is linked to neighbours that the selection heuristic keeps, those nearer to it than
to any neighbour kept before. Its candidates are the ``ef`` nearest of all nodes inserted before, found
exactly by matrix products, where a beam search would find nearly these. Level 0 allows 2M links, the
others M; a node with more is pruned by the same heuristic, and the nearest of the others fill its places,
so that links back to later nodes are seldom lost.

A search descends greedily to level 0 and goes on there with a beam, for many queries at once.
"""

from __future__ import annotations

import io
import math

import numpy as np

#: Numbers that a block of nodes gathers at once, and columns of a tile of distances.
GATHERED, COLUMNS = 1 << 22, 8192
#: Queries searched at once, and nodes of a beam that are expanded at once.
QUERIES, EXPANDED = 256, 4


class Graph:
    def __init__(self, dim: int, metric: str = "L2", m: int = 16, ef: int = 100, seed: int = 100):
        self.dim, self.metric, self.m, self.ef, self.seed = dim, metric, m, max(ef, m), seed
        self.points = np.zeros((0, dim), np.float32)
        self.ids = np.zeros(0, np.int64)
        #: For each level the nodes that are in it and their links, -1 where there is none.
        self.nodes: list[np.ndarray] = []
        self.near: list[np.ndarray] = []
        #: Distances that the last search evaluated for each query.
        self.evaluated = np.zeros(0, np.int64)

    # -- distances

    def _ready(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as the graph compares them: cosine normalised, packed words as ones and minus ones."""
        v = np.asarray(vectors)
        if self.metric == "HAMMING":
            bits = np.unpackbits(np.ascontiguousarray(v.astype(">i8")).view(np.uint8).reshape(len(v), -1), axis=1)
            return bits.astype(np.float32) * 2 - 1
        v = v.astype(np.float32).reshape(len(v), -1)
        return v / np.maximum(1e-30, np.linalg.norm(v, axis=1, keepdims=True)) if self.metric == "COSINE" else v

    def _from_dots(self, dots: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Distances from products and the squared lengths of both sides."""
        if self.metric == "L2":
            return np.maximum(0, left + right - 2 * dots)
        return (self.points.shape[1] - dots) / 2 if self.metric == "HAMMING" else 1 - dots

    # -- building

    def build(self, ids: np.ndarray, vectors: np.ndarray) -> Graph:
        """Insert all vectors in order; packed words of 64 bits for the Hamming distance."""
        self.ids, self.points = np.asarray(ids, np.int64), self._ready(vectors)
        self.square = np.einsum("ij,ij->i", self.points, self.points)
        u = np.random.default_rng(self.seed).random(len(self.ids))
        level = np.floor(-np.log(np.maximum(1e-12, u)) / math.log(max(2, self.m))).astype(np.int64)
        for lv in range(int(level.max(initial=-1)) + 1):
            nodes = np.flatnonzero(level >= lv)
            self.nodes.append(nodes)
            self.near.append(self._level(nodes, 2 * self.m if lv == 0 else self.m))
        return self

    def _level(self, nodes: np.ndarray, most: int) -> np.ndarray:
        """The links of a level's nodes, as numbers among ``nodes``, then of all."""
        v, square = self.points[nodes], self.square[nodes]
        near = np.full((len(nodes), most), -1, np.int32)
        size = max(16, min(256, GATHERED // (self.ef * max(1, v.shape[1]))))
        for a in range(1, len(nodes), size):
            block = np.arange(a, min(len(nodes), a + size))
            cand, far = self._earlier(v, square, block)
            kept = self._choose(v, square, cand, far, self.m)
            near[block, : self.m] = kept
            row, col = np.nonzero(kept >= 0)
            self._back(v, square, near, kept[row, col], block[row])
        return np.where(near >= 0, nodes[near], -1).astype(np.int32)

    def _earlier(self, v: np.ndarray, square: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` nearest of the nodes before each of a block, near first, filled with -1."""
        row, col, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        bound = np.full(len(block), np.inf, np.float32)
        for b in range(0, block[-1], COLUMNS):
            end = min(b + COLUMNS, block[-1])
            d = self._from_dots(v[block] @ v[b:end].T, square[block][:, None], square[b:end][None, :])
            if end > block[0]:
                d[np.arange(b, end)[None, :] >= block[:, None]] = np.inf
            if d.shape[1] > self.ef:
                bound = np.fmin(bound, np.partition(d, self.ef - 1, axis=1)[:, self.ef - 1]) if not b else bound
            x, y = np.nonzero((d <= bound[:, None]) & (d < np.inf))
            row, col, far = np.concatenate([row, x]), np.concatenate([col, y + b]), np.concatenate([far, d[x, y]])
            order = np.lexsort((col, far, row))
            row, col, far = row[order], col[order], far[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = place < self.ef
            row, col, far, place = row[keep], col[keep], far[keep], place[keep]
            full = place == self.ef - 1
            bound[row[full]] = far[full]
        cand, dist = np.full((len(block), self.ef), -1, np.int64), np.full((len(block), self.ef), np.inf, np.float32)
        cand[row, place], dist[row, place] = col, far
        return cand, dist

    def _choose(self, v: np.ndarray, square: np.ndarray, cand: np.ndarray, far: np.ndarray, most: int, fill: bool = False) -> np.ndarray:
        """Of candidates, near first, up to ``most`` that are nearer to the node than to any one chosen before.

        With ``fill`` the nearest others take the places that are left.
        """
        width = int((cand >= 0).sum(axis=1).max(initial=0))
        cand, far = cand[:, :width], far[:, :width]
        points, length = v[cand], square[cand]
        between = self._from_dots(points @ points.transpose(0, 2, 1), length[:, :, None], length[:, None, :])
        out, count, shut = np.full((len(cand), most), -1, np.int64), np.zeros(len(cand), np.int64), cand < 0
        left = cand >= 0
        for p in range(width):
            take = np.flatnonzero(~shut[:, p] & (count < most))
            if len(take):
                out[take, count[take]] = cand[take, p]
                count[take] += 1
                left[take, p] = False
                shut[take] |= between[take, p] < far[take]
        for p in range(width if fill else 0):
            take = np.flatnonzero(left[:, p] & (count < most))
            out[take, count[take]] = cand[take, p]
            count[take] += 1
        return out

    def _back(self, v: np.ndarray, square: np.ndarray, near: np.ndarray, to: np.ndarray, new: np.ndarray) -> None:
        """Link the nodes ``to`` with ``new`` ones, and prune those with too many links."""
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        each, start, n = np.unique(to, return_index=True, return_counts=True)
        have = (near[each] >= 0).sum(axis=1)
        fits = have + n <= near.shape[1]
        at = np.repeat(np.arange(len(each)), n)
        place = have[at] + np.arange(len(to)) - start[at]
        ok = fits[at]
        near[to[ok], place[ok]] = new[ok]
        over = np.flatnonzero(~fits)
        step = max(1, GATHERED // max(1, 2 * near.shape[1] * v.shape[1]))
        for i in range(0, len(over), step):
            part = over[i : i + step]
            width = int((have[part] + n[part]).max())
            cand = np.full((len(part), width), -1, np.int64)
            cand[:, : near.shape[1]] = near[each[part], :]
            back = np.full(len(each), -1)
            back[part] = np.arange(len(part))
            mine = back[at] >= 0
            cand[back[at[mine]], place[mine]] = new[mine]
            q = each[part]
            far = self._from_dots(np.einsum("rpd,rd->rp", v[cand], v[q]), square[cand], square[q][:, None])
            far[cand < 0] = np.inf
            sort = np.lexsort((cand, far), axis=1)
            near[q] = self._choose(v, square, np.take_along_axis(cand, sort, 1), np.take_along_axis(far, sort, 1), near.shape[1], fill=True)

    # -- searching

    def search(self, queries: np.ndarray, k: int, ef: int, gone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``queries``, ids and distances: for each query about the ``k`` nearest, near first.

        The beam is as wide as ``k`` at least. ``gone`` are ids that may be passed but not returned.
        """
        q = self._ready(queries)
        beam = max(ef, k)
        away = None
        if gone is not None and len(gone):
            away = np.isin(self.ids, gone)
            beam += min(int(away.sum()), beam)  # room for those that are dropped
        found, seen = [], []
        for a in range(0, len(q) if len(self.ids) else 0, QUERIES):
            node, far, n = self._beam(q[a : a + QUERIES], beam)
            if away is not None:
                far = np.where((node >= 0) & ~away[node], far, np.inf)
                order = np.argsort(far, axis=1, kind="stable")
                node, far = np.take_along_axis(node, order, 1), np.take_along_axis(far, order, 1)
            row, col = np.nonzero(np.isfinite(far[:, :k]))
            found.append((row + a, self.ids[node[row, col]], far[row, col].astype(np.float64)))
            seen.append(n)
        self.evaluated = np.concatenate(seen) if seen else np.zeros(0, np.int64)
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _far(self, q: np.ndarray, qq: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        return self._from_dots(np.einsum("ij,ij->i", self.points[node], q[row]), self.square[node], qq[row])

    def _beam(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and distances of each query's beam, near first, and the number of distances evaluated."""
        every, qq = np.arange(len(q)), np.einsum("ij,ij->i", q, q)
        at = np.full(len(q), self.nodes[-1][0], np.int64)
        best, count = self._far(q, qq, every, at), np.ones(len(q), np.int64)
        for lv in range(len(self.nodes) - 1, 0, -1):
            moving = every
            while len(moving):
                near = self.near[lv][np.searchsorted(self.nodes[lv], at[moving])]
                row, col = np.nonzero(near >= 0)
                far = np.full(near.shape, np.inf, np.float32)
                far[row, col] = self._far(q, qq, moving[row], near[row, col])
                count[moving] += (near >= 0).sum(axis=1)
                pick = far.argmin(axis=1)
                low = far[np.arange(len(moving)), pick]
                better = low < best[moving]
                best[moving[better]], at[moving[better]] = low[better], near[np.flatnonzero(better), pick[better]]
                moving = moving[better]
        node, far = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), np.inf, np.float32)
        node[:, 0], far[:, 0] = at, best
        todo = np.zeros((len(q), ef), bool)
        todo[:, 0] = True
        seen = np.zeros((len(q), len(self.ids)), bool)
        seen[every, at] = True
        active = every
        while len(active):
            open_ = todo[active]
            nth = np.cumsum(open_, axis=1)
            row, col = np.nonzero(open_ & (nth <= EXPANDED))
            todo[active[row], col] = False
            near = self.near[0][node[active[row], col]]
            code = (active[row][:, None] * np.int64(len(self.ids)) + near)[near >= 0]
            code = np.unique(code[~seen.ravel()[code]])
            r, n = code // len(self.ids), code % len(self.ids)
            seen[r, n] = True
            d = self._far(q, qq, r, n)
            count += np.bincount(r, minlength=len(q))
            use = d < far[r, -1]
            r, n, d = r[use], n[use], d[use]
            if len(r):
                rows, start, size = np.unique(r, return_index=True, return_counts=True)
                width = int(size.max())
                place = np.arange(len(r)) - np.repeat(start, size)
                own = np.repeat(np.arange(len(rows)), size)
                more, less = np.full((len(rows), width), -1, np.int64), np.full((len(rows), width), np.inf, np.float32)
                more[own, place], less[own, place] = n, d
                every_node, every_far = np.concatenate([node[rows], more], axis=1), np.concatenate([far[rows], less], axis=1)
                every_todo = np.concatenate([todo[rows], more >= 0], axis=1)
                order = np.argsort(every_far, axis=1, kind="stable")[:, :ef]
                node[rows], far[rows], todo[rows] = (np.take_along_axis(x, order, 1) for x in (every_node, every_far, every_todo))
            active = np.flatnonzero(todo.any(axis=1))
        return node, far, count

    # -- storing

    def dump(self) -> bytes:
        out = io.BytesIO()
        levels = {f"nodes{i}": x.astype(np.int32) for i, x in enumerate(self.nodes)} | {f"near{i}": x for i, x in enumerate(self.near)}
        points = np.packbits(self.points > 0, axis=1) if self.metric == "HAMMING" else self.points
        np.savez(out, points=points, ids=self.ids, head=np.array([len(self.nodes), self.m, self.ef, self.dim], np.int64), **levels)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes, metric: str) -> Graph:
        z = np.load(io.BytesIO(raw))
        levels, m, ef, dim = z["head"].tolist()
        g = cls(dim, metric, m, ef)
        g.ids, g.points = z["ids"], z["points"]
        if metric == "HAMMING":
            g.points = np.unpackbits(g.points, axis=1).astype(np.float32) * 2 - 1
        g.square = np.einsum("ij,ij->i", g.points, g.points)
        g.nodes, g.near = [z[f"nodes{i}"].astype(np.int64) for i in range(levels)], [z[f"near{i}"] for i in range(levels)]
        return g

    def faults(self) -> list[str]:
        """What is wrong with the graph: links that are too many, lead nowhere, to the node itself or twice to one."""
        out = []
        if len(np.unique(self.ids)) != len(self.ids):
            out.append("an id occurs twice")
        for lv, (nodes, near) in enumerate(zip(self.nodes, self.near, strict=True)):
            if near.shape != (len(nodes), 2 * self.m if lv == 0 else self.m):
                out.append(f"level {lv} has links for other nodes")
            live = near >= 0
            if not np.isin(near[live], nodes).all():
                out.append(f"a link of level {lv} leads out of it")
            if (near == nodes[:, None]).any():
                out.append(f"a node of level {lv} is linked to itself")
            sort = np.sort(near, axis=1)
            if ((sort[:, 1:] == sort[:, :-1]) & (sort[:, 1:] >= 0)).any():
                out.append(f"a node of level {lv} is linked twice to another")
            if len(nodes) > 1 and not live.any(axis=1).all():
                out.append(f"a node of level {lv} has no link")
        return out
