"""A hierarchical navigable small-world graph in numpy, as flat neighbour arrays.

After Y. Malkov, D. Yashunin, "Efficient and robust approximate nearest neighbor search using Hierarchical Navigable Small World graphs",
2016. All steps work on batches of points: beam search, neighbour selection and reverse links are array operations. Layers are
filled from the top, so that every search enters a layer at the nearest point found in the layer above.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Hnsw:
    """``x``: (n, dim) vectors; ``layers``: from 0 up, pairs of member ids and an (n, width) array of neighbours, -1 where free."""

    x: np.ndarray
    m: int = 12
    ef: int = 48
    seed: int = 5
    layers: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def build(self, batch: int = 1024) -> Hnsw:
        n = len(self.x)
        rng = np.random.default_rng(self.seed)
        level = np.minimum((-np.log(1.0 - rng.random(n)) / math.log(self.m)).astype(int), 12)
        top = int(level.max()) if n else 0
        self.layers = []
        above: np.ndarray | None = None
        stack: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(top, -1, -1):
            members = np.nonzero(level >= at)[0]
            width = self.m * (2 if at == 0 else 1)
            adj = np.full((n, width), -1, dtype=np.int32)
            done = np.zeros(0, dtype=np.int64)
            if above is not None:
                adj[above, : self.m] = stack[-1][1][above][:, : self.m]
                done = above
            new = np.setdiff1d(members, done)
            new = new[rng.permutation(len(new))]
            while len(new):
                size = min(batch, max(64, len(done)))
                now, new = new[:size], new[size:]
                self._insert(now, done, adj, stack)
                done = np.concatenate([done, now])
            stack.append((members, adj))
            above = members
        self.layers = stack[::-1]
        return self

    # -- insertion ----------------------------------------------------------------------------------------------------

    def _insert(self, now: np.ndarray, done: np.ndarray, adj: np.ndarray, stack: list) -> None:
        q = self.x[now]
        cid = np.full((len(now), 0), -1, dtype=np.int64)
        cd = np.full((len(now), 0), np.inf)
        if len(done):
            start = self._descend(q, stack) if stack else np.full(len(now), done[0])
            cid, cd = self._beam(q, start[:, None], adj, self.ef, expand=4)
        d = _d2(q, self.x[now])
        np.fill_diagonal(d, np.inf)
        k = min(self.m, len(now) - 1)
        if k > 0:
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            cid = np.concatenate([cid, now[near]], axis=1)
            cd = np.concatenate([cd, np.take_along_axis(d, near, 1)], axis=1)
        if not cid.shape[1]:
            return
        chosen = self._select(cid, cd, self.m)
        adj[now, : chosen.shape[1]] = chosen
        src = np.repeat(now, chosen.shape[1])
        dst = chosen.ravel()
        keep = dst >= 0
        self._link_back(dst[keep], src[keep].astype(np.int64), adj)

    def _select(self, cid: np.ndarray, cd: np.ndarray, m: int) -> np.ndarray:
        """Up to m of the candidates of each row, nearest first, leaving out those nearer to a chosen one than to the row's point;
        free places go to the nearest left out."""
        order = np.argsort(cd, axis=1, kind="stable")
        cid, cd = np.take_along_axis(cid, order, 1), np.take_along_axis(cd, order, 1)
        rows, c = cid.shape
        out = np.full((rows, m), -1, dtype=np.int32)
        for lo in range(0, rows, 512):
            i, dd = cid[lo : lo + 512], cd[lo : lo + 512]
            v = self.x[np.maximum(i, 0)]
            sq = np.einsum("rcd,rcd->rc", v, v)
            between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
            ok = np.zeros(i.shape, dtype=bool)
            usable = np.isfinite(dd) & (i >= 0)
            for j in range(c):
                blocked = (ok[:, :j] & (between[:, j, :j] < dd[:, j : j + 1])).any(axis=1) if j else np.zeros(len(i), dtype=bool)
                ok[:, j] = usable[:, j] & ~blocked & (ok[:, :j].sum(axis=1) < m)
            # chosen ones first, then the others, each by distance
            rank = np.where(ok, 0, np.where(usable, 1, 2)) * c + np.arange(c)
            best = np.argsort(rank, axis=1)[:, :m]
            got = np.where(np.take_along_axis(usable, best, 1), np.take_along_axis(i, best, 1), -1)
            out[lo : lo + 512, : got.shape[1]] = got
        return out

    def _link_back(self, to: np.ndarray, new: np.ndarray, adj: np.ndarray) -> None:
        width = adj.shape[1]
        d = np.einsum("nd,nd->n", self.x[to] - self.x[new], self.x[to] - self.x[new])
        order = np.lexsort((d, to))
        to, new = to[order], new[order]
        heads, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        keep = place < width  # of the links offered at once to one point, the nearest
        extra = np.full((len(heads), int(min(width, count.max()))), -1, dtype=np.int64)
        extra[np.repeat(np.arange(len(heads)), count)[keep], place[keep]] = new[keep]
        old = adj[heads]
        room = (old < 0).sum(axis=1) >= np.minimum(count, width)
        both = np.concatenate([old.astype(np.int64), extra], axis=1)
        fits = both[room]
        if len(fits):
            adj[heads[room]] = np.take_along_axis(fits, np.argsort(fits < 0, axis=1, kind="stable"), 1)[:, :width]
        tight = both[~room]
        if len(tight):
            h = heads[~room]
            diff = self.x[np.maximum(tight, 0)] - self.x[h][:, None, :]
            dd = np.where(tight >= 0, np.einsum("rcd,rcd->rc", diff, diff), np.inf)
            adj[h] = self._select(tight, dd, width)

    # -- search -------------------------------------------------------------------------------------------------------

    def _descend(self, q: np.ndarray, stack: list) -> np.ndarray:
        """The nearest point found for each query in the layers of ``stack`` (from the top down)."""
        cur = np.full(len(q), stack[0][0][0], dtype=np.int64)
        best = _rows_d2(q, self.x[cur])
        for _, adj in stack:
            live = np.arange(len(q))
            while len(live):
                nb = adj[cur[live]].astype(np.int64)
                diff = self.x[np.maximum(nb, 0)] - q[live][:, None, :]
                d = np.where(nb >= 0, np.einsum("rcd,rcd->rc", diff, diff), np.inf)
                j = d.argmin(axis=1)
                dj = d[np.arange(len(live)), j]
                better = dj < best[live]
                live, j, nb, dj = live[better], j[better], nb[better], dj[better]
                cur[live] = nb[np.arange(len(live)), j]
                best[live] = dj
        return cur

    def _beam(self, q: np.ndarray, start: np.ndarray, adj: np.ndarray, ef: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef nearest points met from ``start`` (rows, s): ids (-1 where fewer) and squared distances, nearest first."""
        n, rows = len(self.x), len(q)
        ids = np.full((rows, ef), -1, dtype=np.int64)
        dist = np.full((rows, ef), np.inf)
        open_ = np.zeros((rows, ef), dtype=bool)
        seen = np.zeros(rows * n, dtype=bool)
        s = min(start.shape[1], ef)
        ids[:, :s] = start[:, :s]
        for j in range(s):
            there = ids[:, j] >= 0
            dist[there, j] = _rows_d2(q[there], self.x[ids[there, j]])
            open_[there, j] = True
            seen[np.nonzero(there)[0] * n + ids[there, j]] = True
        live = np.arange(rows)
        while len(live):
            o, di = open_[live], dist[live]
            key = np.where(o, di, np.inf)
            pick = np.argpartition(key, expand - 1, axis=1)[:, :expand] if expand < ef else np.argsort(key, axis=1)
            good = np.isfinite(np.take_along_axis(key, pick, 1))
            some = good.any(axis=1)
            live, pick, good = live[some], pick[some], good[some]
            if not len(live):
                break
            r = np.repeat(live, pick.shape[1])[good.ravel()]
            c = pick.ravel()[good.ravel()]
            open_[r, c] = False
            nb = adj[ids[r, c]].astype(np.int64)
            rr = np.repeat(r, nb.shape[1])
            flat = nb.ravel()
            keep = flat >= 0
            code = rr[keep] * n + flat[keep]
            code = code[~seen[code]]
            if not len(code):
                continue
            code = np.unique(code)
            seen[code] = True
            rr, flat = code // n, code % n
            diff = self.x[flat] - q[rr]
            d = np.einsum("nd,nd->n", diff, diff)
            near = d < dist[rr, ef - 1]
            rr, flat, d = rr[near], flat[near], d[near]
            if not len(rr):
                continue
            heads, first, count = np.unique(rr, return_index=True, return_counts=True)
            place = np.arange(len(rr)) - np.repeat(first, count)
            row = np.repeat(np.arange(len(heads)), count)
            w = int(count.max())
            xi = np.full((len(heads), w), -1, dtype=np.int64)
            xd = np.full((len(heads), w), np.inf)
            xi[row, place], xd[row, place] = flat, d
            ai, ad = np.concatenate([ids[heads], xi], axis=1), np.concatenate([dist[heads], xd], axis=1)
            ao = np.concatenate([open_[heads], xi >= 0], axis=1)
            order = np.argsort(ad, axis=1, kind="stable")[:, :ef]
            ids[heads], dist[heads], open_[heads] = (np.take_along_axis(a, order, 1) for a in (ai, ad, ao))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def search(self, q: np.ndarray, ef: int, own: np.ndarray | None = None, batch: int = 1024, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """ids and squared distances of the ef nearest points met for each query. ``own``: the queries' own positions, if they are indexed
        here; the walk in layer 0 then starts there, else below the layers."""
        n = len(self.x)
        ids, dist = np.full((len(q), ef), -1, dtype=np.int64), np.full((len(q), ef), np.inf)
        batch = max(64, min(batch, (64 << 20) // max(1, n)))
        for lo in range(0, len(q), batch):
            part = q[lo : lo + batch]
            above = self.layers[:0:-1]
            start = self._descend(part, above)[:, None] if above else np.full((len(part), 1), self.layers[0][0][0], dtype=np.int64)
            if own is not None:
                start = np.concatenate([own[lo : lo + batch, None], np.where(start == own[lo : lo + batch, None], -1, start)], axis=1)
            ids[lo : lo + batch], dist[lo : lo + batch] = self._beam(part, start, self.layers[0][1], ef, expand)
        return ids, dist

    # -- flat form ----------------------------------------------------------------------------------------------------

    def flat(self) -> dict[str, bytes | int]:
        """The graph as byte arrays: layer 0 whole, the layers above by their members."""
        upper = [(m.astype(np.int32), a[m].astype(np.int32)) for m, a in self.layers[1:]]
        return {
            "n": len(self.x), "dim": self.x.shape[1], "m": self.m, "vectors": self.x.astype("<f8").tobytes(), "base": self.layers[0][1].astype("<i4").tobytes(),
            "sizes": np.array([len(m) for m, _ in upper], dtype="<i4").tobytes(),
            "members": b"".join(m.tobytes() for m, _ in upper), "links": b"".join(a.tobytes() for _, a in upper),
        }

    @classmethod
    def load(cls, f: dict) -> Hnsw:
        n, dim, m = int(f["n"]), int(f["dim"]), int(f["m"])
        h = cls(np.frombuffer(f["vectors"], dtype="<f8").reshape(n, dim), m=m)
        h.layers = [(np.arange(n), np.frombuffer(f["base"], dtype="<i4").reshape(n, 2 * m))]
        members, links, at = np.frombuffer(f["members"], dtype="<i4"), np.frombuffer(f["links"], dtype="<i4"), 0
        for size in np.frombuffer(f["sizes"], dtype="<i4"):
            ids = members[at : at + size].astype(np.int64)
            adj = np.full((n, m), -1, dtype=np.int32)
            adj[ids] = links[at * m : (at + size) * m].reshape(size, m)
            h.layers.append((ids, adj))
            at += size
        return h


def _d2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _rows_d2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("nd,nd->n", d, d)
