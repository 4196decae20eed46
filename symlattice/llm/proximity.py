"""Proximity graphs over blocks of vectors, built and searched in batches with numpy."""

from __future__ import annotations

import io

import numpy as np

NONE = -1
#: Queries that are searched side by side.
BATCH = 256


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of each query to each of its points: (b, d), (b, k, d) -> (b, k)."""
    return ((queries**2).sum(1)[:, None] + (points**2).sum(2) - 2 * np.einsum("bd,bkd->bk", queries, points, optimize=True)).clip(0)


def beam_search(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the `width` nearest points met, nearest first: (numbers, squared distances).

    links: (n, degree) with NONE for no link; entries: (b, e) points where the search begins. Each
    step expands every query's nearest point that has not been expanded yet.
    """
    b = len(queries)
    seen = np.zeros((b, len(points)), bool)
    rows = np.arange(b)
    np.put_along_axis(seen, entries, True, 1)
    d0 = distances(queries, points[entries])
    first = np.argsort(d0, 1, kind="stable")[:, :width]
    ids = np.full((b, width), NONE, np.int64)
    dist = np.full((b, width), np.inf)
    done = np.ones((b, width), bool)
    k = first.shape[1]
    ids[:, :k], dist[:, :k], done[:, :k] = np.take_along_axis(entries, first, 1), np.take_along_axis(d0, first, 1), False
    while len(rows):
        best = np.where(done[rows], np.inf, dist[rows])
        at = best.argmin(1)
        live = np.isfinite(best[np.arange(len(rows)), at])
        rows, at = rows[live], at[live]
        if not len(rows):
            break
        done[rows, at] = True
        near = links[ids[rows, at]]
        new = near != NONE
        new &= ~seen[rows[:, None], near]
        r, c = np.nonzero(new)
        seen[rows[r], near[r, c]] = True
        d = np.full(near.shape, np.inf)
        if len(r):
            diff = points[near[r, c]] - queries[rows[r]]
            d[r, c] = np.einsum("ij,ij->i", diff, diff)
        all_d = np.concatenate([dist[rows], d], 1)
        all_i = np.concatenate([ids[rows], near], 1)
        all_done = np.concatenate([done[rows], ~new], 1)
        order = np.argpartition(all_d, width - 1, 1)[:, :width]
        ids[rows], dist[rows], done[rows] = (np.take_along_axis(x, order, 1) for x in (all_i, all_d, all_done))
        done[rows] |= ~np.isfinite(dist[rows])
    order = np.argsort(dist, 1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), ids, NONE), dist


def prune(points: np.ndarray, centres: np.ndarray, ids: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(b, degree) links for each centre out of its candidates (b, c), NONE where there are fewer.

    The nearest candidate stays, and those go that lie alpha times nearer to it than to the centre;
    and so on. alpha over 1 keeps some longer edges, which shorten the searches.
    """
    ids = np.where(ids == centres[:, None], NONE, ids)
    order = np.argsort(np.where(ids == NONE, np.inf, dist), 1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    srt = np.sort(ids, 1)
    if (srt[:, 1:] == srt[:, :-1])[srt[:, 1:] != NONE].any():  # a candidate that is named twice counts once
        by = np.argsort(ids, 1, kind="stable")
        val = np.take_along_axis(ids, by, 1)
        twice = np.zeros(ids.shape, bool)
        np.put_along_axis(twice, by[:, 1:], val[:, 1:] == val[:, :-1], 1)
        ids = np.where(twice, NONE, ids)
    alive = ids != NONE
    p = points[np.where(alive, ids, 0)]
    norm = np.einsum("bcd,bcd->bc", p, p)
    apart = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(p, p.transpose(0, 2, 1))
    out = np.full((len(ids), degree), NONE, np.int64)
    rows = np.arange(len(ids))
    for k in range(degree):
        at = np.where(alive, dist, np.inf).argmin(1)
        ok = alive[rows, at]
        if not ok.any():
            break
        out[ok, k] = ids[rows, at][ok]
        alive &= ~(ok[:, None] & (alpha * alpha * apart[rows, at] <= dist))
        alive[rows, at] = False
    return out


def _add_back(points: np.ndarray, links: np.ndarray, sources: np.ndarray, alpha: float) -> None:
    """Every point that a source links to links back; where that is too many, its links are pruned again."""
    degree = links.shape[1]
    to, frm = links[sources].ravel(), np.repeat(sources, degree)
    ok = to != NONE
    to, frm = to[ok], frm[ok]
    have = (links[to] == frm[:, None]).any(1)
    to, frm = to[~have], frm[~have]
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    targets, start, count = np.unique(to, return_index=True, return_counts=True)
    free = (links[targets] == NONE).sum(1)
    for fits in (True, False):
        sel = count <= free if fits else count > free
        t, s, c = targets[sel], start[sel], count[sel]
        if not len(t):
            continue
        if fits:
            rank = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            pos = np.repeat(degree - free[sel], c) + rank
            # links are kept packed to the left
            links[np.repeat(t, c), pos] = frm[np.repeat(s, c) + rank]
        else:
            wide = np.full((len(t), int(c.max())), NONE, np.int64)
            rank = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            wide[np.repeat(np.arange(len(t)), c), rank] = frm[np.repeat(s, c) + rank]
            for lo in range(0, len(t), 4 * BATCH):
                tt = t[lo : lo + 4 * BATCH]
                cand = np.concatenate([links[tt], wide[lo : lo + 4 * BATCH]], 1)
                d = np.where(cand == NONE, np.inf, distances(points[tt], points[np.maximum(cand, 0)]))
                links[tt] = prune(points, tt, cand, d, degree, alpha)


def _insert(points: np.ndarray, links: np.ndarray, fresh: np.ndarray, found: tuple[np.ndarray, np.ndarray], alpha: float, mates: int = 16) -> None:
    """Links the points `fresh` to the candidates found and to the nearest of each other."""
    ids, dist = found
    if len(fresh) > 1:
        x = points[fresh]
        own = ((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T).clip(0)
        np.fill_diagonal(own, np.inf)
        k = min(mates, len(fresh) - 1)
        at = np.argpartition(own, k - 1, 1)[:, :k]
        ids = np.concatenate([ids, fresh[at]], 1)
        dist = np.concatenate([dist, np.take_along_axis(own, at, 1)], 1)
    old = links[fresh]
    ids = np.concatenate([ids, old], 1)
    dist = np.concatenate([dist, np.where(old == NONE, np.inf, distances(points[fresh], points[np.maximum(old, 0)]))], 1)
    links[fresh] = prune(points, fresh, ids, dist, links.shape[1], alpha)
    _add_back(points, links, fresh, alpha)


def _batches(order: np.ndarray, most: int = BATCH):
    at = 0
    while at < len(order):
        size = min(most, max(1, at))
        yield order[at : at + size]
        at += size


def groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of n numbers is linked to over any steps."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _ends(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r, c = np.nonzero(links != NONE)
    return r, links[r, c]


def connect(points: np.ndarray, links: np.ndarray, members: np.ndarray, entry: int, width: int = 32) -> np.ndarray:
    """links with bridges to the members that no search from entry could reach.

    A crowd of near copies prefers links within the crowd, and pruning may cut it off. Each such
    island gets a bridge, both ways, between the two nearest of its members and the points found; each
    round reaches some more, or it is an error.
    """
    if not np.isfinite(points[members]).all():
        raise ValueError("vectors must be finite")
    links, before = links.copy(), len(points) + 1
    while True:
        reached = np.zeros(len(points), bool)
        front = np.array([entry])
        while len(front):
            reached[front] = True
            near = np.unique(links[front])
            near = near[near != NONE]
            front = near[~reached[near]]
        lost = members[~reached[members]]
        if not len(lost):
            return links
        if len(lost) >= before:
            raise RuntimeError("a bridge led nowhere")
        before = len(lost)
        a, b = _ends(links)
        inner = ~reached[a] & ~reached[b]
        island = groups(len(points), a[inner], b[inner])[lost]
        order = np.argsort(island, kind="stable")
        rank = np.arange(len(lost)) - np.searchsorted(island[order], island[order])
        chosen, of = lost[order][rank < 32], island[order][rank < 32]
        best: dict[int, tuple[float, int, int]] = {}
        for lo in range(0, len(chosen), BATCH):
            part = chosen[lo : lo + BATCH]
            ids, dist = beam_search(points, links, points[part], np.full((len(part), 1), entry), width)
            if (ids[:, 0] == NONE).any():
                raise ValueError("squared distances must be finite")
            for g, m, x, d in zip(of[lo : lo + BATCH], part, ids[:, 0], dist[:, 0], strict=True):
                best[int(g)] = min(best.get(int(g), (np.inf, -1, -1)), (float(d), int(m), int(x)))
        for _, m, x in best.values():
            for u, v in ((x, m), (m, x)):
                free = np.flatnonzero(links[u] == NONE)
                if not len(free):
                    links = np.concatenate([links, np.full((len(links), 4), NONE, np.int64)], 1)
                    free = np.flatnonzero(links[u] == NONE)
                links[u, free[0]] = v


class RobustGraph:
    """A directed graph with relaxed pruning: greedy searches for every point from a central one
    propose its neighbours; the second pass prunes with alpha over 1."""

    def __init__(self, points: np.ndarray, links: np.ndarray, entry: int):
        self.points, self.links, self.entry = points, links, entry

    @classmethod
    def build(cls, points: np.ndarray, degree: int = 32, width: int = 64, alpha: float = 1.2, seed: int = 7) -> RobustGraph:
        points = np.ascontiguousarray(points)
        n = len(points)
        links = np.full((n, degree), NONE, np.int64)
        entry = int(((points - points.mean(0)) ** 2).sum(1).argmin()) if n else 0
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[entry], order[order != entry]]).astype(np.int64) if n else order
        for relax in (1.0, alpha):
            for fresh in _batches(order[1:]):
                start = np.full((len(fresh), 1), entry)
                _insert(points, links, fresh, beam_search(points, links, points[fresh], start, width), relax)
        return cls(points, connect(points, links, order, entry) if n else links, entry)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        ids, dist = [np.zeros((0, width), np.int64)], [np.zeros((0, width))]
        for lo in range(0, len(queries), BATCH):
            q = np.ascontiguousarray(queries[lo : lo + BATCH], self.points.dtype)
            i, d = beam_search(self.points, self.links, q, np.full((len(q), 1), self.entry), width)
            ids.append(i)
            dist.append(d)
        return np.concatenate(ids), np.concatenate(dist)


class LayeredGraph:
    """A hierarchical navigable small world: each point is on layer 0 and, with a chance of 1 / degree
    a step, on the layers above; a search descends from the top and widens its beam on layer 0."""

    def __init__(self, points: np.ndarray, layers: list[np.ndarray], members: list[np.ndarray]):
        self.points, self.layers, self.members = points, layers, members

    def to_bytes(self) -> bytes:
        """Links and members of the layers; the points are kept elsewhere."""
        out = io.BytesIO()
        np.savez(out, **{f"l{i}": x.astype(np.int32) for i, x in enumerate(self.layers)}, **{f"m{i}": x.astype(np.int32) for i, x in enumerate(self.members)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, points: np.ndarray, data: bytes) -> LayeredGraph:
        with np.load(io.BytesIO(data)) as f:
            n = len(f.files) // 2
            return cls(np.ascontiguousarray(points, np.float32), [f[f"l{i}"].astype(np.int64) for i in range(n)], [f[f"m{i}"].astype(np.int64) for i in range(n)])

    def _both_ways(self) -> tuple[np.ndarray, np.ndarray]:
        """Layer 0 as (offsets, points), each link also taken backwards."""
        a, b = _ends(self.layers[0])
        pair = np.unique(np.concatenate([a * len(self.points) + b, b * len(self.points) + a]))
        return np.searchsorted(pair // len(self.points), np.arange(len(self.points) + 1)), pair % len(self.points)

    @classmethod
    def build(cls, points: np.ndarray, degree: int = 16, width: int = 48, seed: int = 11) -> LayeredGraph:
        points = np.ascontiguousarray(points, np.float32)
        n, r = len(points), np.random.default_rng(seed)
        height = np.floor(-np.log(r.random(n).clip(1e-12)) / np.log(degree)).astype(int) if n else np.zeros(0, int)
        order = r.permutation(n).astype(np.int64)
        top = int(height.max()) if n else 0
        layers, members = [], []
        for layer in range(top + 1):
            members.append(order[height[order] >= layer])
            layers.append(np.full((n, degree * 2 if layer == 0 else degree), NONE, np.int64))
        # upper layers first: each is the way into the one below
        graph = cls(points, layers, members)
        for layer in range(top, -1, -1):
            mine = members[layer]
            for fresh in _batches(mine[1:]):
                start = graph._descend(points[fresh], layer, mine[0])
                # before a layer has links the way in may be a point that it does not hold yet
                start = np.where((graph.layers[layer][start[:, 0]] != NONE).any(1)[:, None], start, mine[0])
                _insert(points, layers[layer], fresh, beam_search(points, layers[layer], points[fresh], start, width), 1.0)
            if len(mine):
                layers[layer] = connect(points, layers[layer], mine, mine[0])
        return graph

    def _descend(self, queries: np.ndarray, to: int, first: int) -> np.ndarray:
        at = np.full((len(queries), 1), self.members[-1][0] if len(self.members) - 1 > to else first)
        for layer in range(len(self.layers) - 1, to, -1):
            at = beam_search(self.points, self.layers[layer], queries, at, 1)[0][:, :1]
        return at

    def nearest(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """One batch's nearest points by a beam of that width on layer 0."""
        q = np.ascontiguousarray(queries, np.float32)
        return beam_search(self.points, self.layers[0], q, self._descend(q, 0, self.members[0][0]), width)

    def within(self, queries: np.ndarray, radius2: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs at a squared distance of radius2 or less: a beam of `width` finds the way
        into the ball, then all points of the ball expand until no new one is met."""
        found_q, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        starts, ends = self._both_ways()
        for lo in range(0, len(queries), BATCH):
            q = np.ascontiguousarray(queries[lo : lo + BATCH], np.float32)
            ids, dist = self.nearest(q, width)
            seen = np.zeros((len(q), len(self.points)), bool)
            r, c = np.nonzero(ids != NONE)
            seen[r, ids[r, c]] = True
            ok = dist[r, c] <= radius2
            fq, fp = r[ok], ids[r, c][ok]
            while len(fq):
                found_q.append(fq + lo)
                found_p.append(fp)
                count = starts[fp + 1] - starts[fp]
                at = np.arange(count.sum()) + np.repeat(starts[fp] - (np.cumsum(count) - count), count)
                pair = np.unique(np.repeat(fq, count) * len(self.points) + ends[at])
                nq, npt = pair // len(self.points), pair % len(self.points)
                new = ~seen[nq, npt]
                nq, npt = nq[new], npt[new]
                seen[nq, npt] = True
                keep = []
                for a in range(0, len(nq), 1 << 16):
                    diff = self.points[npt[a : a + (1 << 16)]] - q[nq[a : a + (1 << 16)]]
                    keep.append(np.einsum("ij,ij->i", diff, diff) <= radius2)
                ok = np.concatenate(keep) if keep else np.zeros(0, bool)
                fq, fp = nq[ok], npt[ok]
        return np.concatenate(found_q), np.concatenate(found_p)
