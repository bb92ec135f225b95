"""A navigable small-world graph over unit vectors, searched for many queries at once."""

from __future__ import annotations

import io

import numpy as np

#: Links of a node on each layer (twice that on the lowest), and the beam that builds them.
LINKS, BUILD_BEAM = 12, 48
#: Nodes that are put in at a time; they find one another too.
BATCH = 256
#: Links that lead to a node, at least.
CALLERS = 4
#: Nodes beyond the threshold that a beam must hold.
SPARE = 8
#: Beam nodes that a query expands in a step.
EXPAND = 4
#: Pairs that are measured again at a time.
PAIRS = 1 << 15


class Graph:
    """Layers of neighbour lists over the rows of ``exact`` (unit length, double precision). Searches go by single precision; what they find is measured again."""

    def __init__(self, exact: np.ndarray, layers: list[np.ndarray], level: np.ndarray) -> None:
        self.exact, self.layers, self.level = exact, layers, level
        self.vectors = exact.astype(np.float32)
        self.entry = int(level.argmax()) if len(level) else -1

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1) -> Graph:
        """Put the vectors in, a batch at a time: each searches the graph so far and its own batch, keeps diverse neighbours, and is linked back."""
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n)) / np.log(LINKS)).astype(np.int64), 6) if n else np.zeros(0, np.int64)
        order = np.argsort(-level, kind="stable")  # upper layers first, so every search starts at the top
        layers = [np.full((n, LINKS * (1 + (i == 0))), -1, np.int32) for i in range(int(level.max()) + 1 if n else 1)]
        graph = cls(vectors, layers, level)
        vectors = graph.vectors
        for i in range(0, n, BATCH):
            some = order[i : i + BATCH]
            near = graph._descend(vectors[some], level[some]) if i else None
            for layer in range(int(level[some].max()), -1, -1):
                mine = some[level[some] >= layer]
                ids, sims = graph._beam(vectors[mine], near[level[some] >= layer, None], layer, BUILD_BEAM) if i else (np.zeros((len(mine), 0), np.int64), np.zeros((len(mine), 0)))
                own = vectors[mine] @ vectors[mine].T
                np.fill_diagonal(own, -2)
                ids, sims = np.hstack([ids, np.broadcast_to(mine, own.shape)]), np.hstack([sims, own])
                top = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
                graph._link(mine, np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1), layer)
                if i:
                    near = near.copy()
                    near[level[some] >= layer] = np.take_along_axis(ids, top, 1)[:, 0]
        graph._repair()
        return graph

    def _repair(self) -> None:
        """Give nodes of the lowest layer that fewer than CALLERS others link to further links from their own neighbours, or from those' neighbours: pruning must not lose a node."""
        links = self.layers[0]
        n = len(links)
        callers = np.bincount(links[links >= 0], minlength=n)
        extra = np.full((n, SPARE), -1, np.int32)
        used = np.zeros(n, np.int64)
        for node in np.flatnonzero(callers < CALLERS):
            need, near = CALLERS - callers[node], links[node][links[node] >= 0]
            for other in (*near, *links[near].ravel()):
                if need > 0 and other >= 0 and other != node and used[other] < SPARE and node not in extra[other] and node not in links[other]:
                    extra[other, used[other]] = node
                    used[other] += 1
                    need -= 1
        self.layers[0] = np.hstack([links, extra[:, : int(used.max(initial=0))]])

    def _descend(self, queries: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """From the entry down to each query's own top layer, always to the nearest neighbour."""
        at = np.full(len(queries), self.entry, np.int64)
        sim = queries @ self.vectors[self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            moving = np.flatnonzero(floor < layer)
            while len(moving):
                near = self.layers[layer][at[moving]]
                s = np.einsum("qd,qkd->qk", queries[moving], self.vectors[np.maximum(near, 0)])
                s[near < 0] = -2
                best = s.argmax(axis=1)
                rows = np.arange(len(moving))
                up = s[rows, best] > sim[moving] + 1e-12
                at[moving[up]], sim[moving[up]] = near[rows, best][up], s[rows, best][up]
                moving = moving[up]
        return at

    def _beam(self, queries: np.ndarray, entries: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes found from the entries, best first; -1 where there are fewer. All queries step together."""
        n, q = len(self.vectors), len(queries)
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -2, np.float32)
        width = min(beam, entries.shape[1])
        ids[:, :width] = entries[:, :width]
        sims[:, :width] = np.einsum("qd,qkd->qk", queries, self.vectors[np.maximum(ids[:, :width], 0)])
        sims[ids < 0] = -2.0
        done = ids < 0
        seen = np.zeros((q, n + 1), bool)
        np.put_along_axis(seen, np.where(ids < 0, n, ids), True, 1)
        live = np.arange(q)
        links = self.layers[layer]
        while len(live):
            open_sims = np.where(done[live], -3.0, sims[live])
            pick = np.argpartition(-open_sims, min(EXPAND, beam) - 1, axis=1)[:, :EXPAND] if beam > EXPAND else np.broadcast_to(np.arange(beam), (len(live), beam))
            usable = np.take_along_axis(open_sims, pick, 1) > -2
            going = usable.any(axis=1)
            live, pick, usable = live[going], pick[going], usable[going]
            if not len(live):
                break
            nodes = np.where(usable, np.take_along_axis(ids[live], pick, 1), 0)
            flags = done[live]
            np.put_along_axis(flags, pick, True, 1)
            done[live] = flags
            near = np.where(usable[:, :, None], links[nodes], n).reshape(len(live), -1)
            near[near < 0] = n
            near[seen.ravel()[near + (live * (n + 1))[:, None]]] = n
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            # Of the new nodes only those that get into the beam are put into it, in the places of its worst.
            at = np.flatnonzero(near < n)
            r, new = at // near.shape[1], near.ravel()[at]
            row = live[r]
            seen[row, new] = True
            s = np.einsum("kd,kd->k", queries.take(row, axis=0), self.vectors.take(new, axis=0))
            better = s > sims[live].min(axis=1)[r]
            r, new, s = r[better], new[better], s[better]
            if not len(r):
                continue
            some, first, size = np.unique(r, return_index=True, return_counts=True)
            at = np.repeat(np.arange(len(some)), size)
            column = beam + np.arange(len(r)) - np.repeat(first, size)
            mine = live[some]
            shape = len(some), beam + int(size.max())
            all_ids, all_sims, all_done = np.full(shape, -1, ids.dtype), np.full(shape, -2, np.float32), np.ones(shape, bool)
            all_ids[:, :beam], all_sims[:, :beam], all_done[:, :beam] = ids[mine], sims[mine], done[mine]
            all_ids[at, column], all_sims[at, column], all_done[at, column] = new, s, False
            top = np.argpartition(all_sims, -beam, axis=1)[:, -beam:]
            ids[mine], sims[mine], done[mine] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
        top = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, best first, up to ``most`` that are nearer to the node than to any chosen before; then the best of the others."""
        q, k = ids.shape
        vectors = self.vectors[np.maximum(ids, 0)]
        chosen, nearest = np.zeros((q, k), bool), np.full((q, k), -2, np.float32)
        count = np.zeros(q, np.int64)
        for j in range(k):
            take = (ids[:, j] >= 0) & (sims[:, j] > nearest[:, j]) & (count < most)
            chosen[take, j] = True
            count += take
            if take.any() and j + 1 < k:
                nearest[take, j + 1 :] = np.maximum(nearest[take, j + 1 :], np.einsum("qd,qkd->qk", vectors[take, j], vectors[take, j + 1 :]))
        rank = np.where(ids < 0, 2 * k, np.where(chosen, 0, k)) + np.arange(k)
        top = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, top, 1)
        if out.shape[1] < most:
            out = np.hstack([out, np.full((q, most - out.shape[1]), -1, np.int64)])
        return out

    def _link(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: int) -> None:
        links = self.layers[layer]
        width = links.shape[1]
        ids = np.where(sims > -1.5, ids, -1)
        links[nodes] = self._diverse(ids, sims, LINKS if layer == 0 else width)[:, :width] if width == LINKS else np.hstack([self._diverse(ids, sims, LINKS), np.full((len(nodes), width - LINKS), -1, np.int64)])
        # Links back: to each neighbour its new callers, and the diverse ones of old and new where that is too many.
        kept = links[nodes]
        target, caller = kept.ravel(), np.repeat(nodes, width)
        target, caller = target[target >= 0], caller[kept.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        target, caller = target[order], caller[order]
        heads = np.flatnonzero(np.diff(target, prepend=-1))
        hot = np.diff(np.append(heads, len(target)))
        for low in range(0, int(hot.max()) if len(hot) else 0, width):  # a target's callers in turns of one list's width
            mine = np.flatnonzero(hot > low)
            pad = np.full((len(mine), width), -1, np.int64)
            size = np.minimum(hot[mine] - low, width)
            at = np.repeat(np.arange(len(mine)), size)
            column = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            pad[at, column] = caller[np.repeat(heads[mine] + low, size) + column]
            node = target[heads[mine]]
            both = np.hstack([links[node].astype(np.int64), pad])
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            s = np.einsum("qd,qkd->qk", self.vectors[node], self.vectors[np.maximum(both, 0)])
            s[both < 0] = -2
            top = np.argsort(-s, axis=1, kind="stable")
            links[node] = self._diverse(np.take_along_axis(both, top, 1), np.take_along_axis(s, top, 1), width)

    def within(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of a cosine of at least ``least`` that beams of that width find. A beam that such nodes all but fill is widened until it holds SPARE others."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        todo, n = np.arange(len(queries)), len(self.vectors)
        single, close = queries.astype(np.float32), np.float32(least - 1e-5)
        while len(todo) and n:
            wide = min(beam, n)
            again = [np.zeros(0, np.int64)]
            step = max(16, min(512, (32 << 20) // (n + 1 + 64 * wide)))
            for i in range(0, len(todo), step):
                some = todo[i : i + step]
                start = self._descend(single[some], np.zeros(len(some), np.int64))
                ids, sims = self._beam(single[some], start[:, None], 0, wide)
                full = (sims[:, -min(SPARE, wide)] >= close) & (wide < n)
                again.append(some[full])
                r, c = np.nonzero((sims >= close) & ~full[:, None])
                r, c = some[r], ids[r, c]
                sure = self._sure(queries, r, c, least)
                found.append((r[sure], c[sure]))
            todo = np.concatenate(again)
            beam *= 4
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def exactly(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, node) of a cosine of at least ``least``, by blocks of products."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(16, (32 << 20) // (4 * len(self.vectors) + 4))
        for i in range(0, len(queries), step):
            r, c = np.nonzero(queries[i : i + step].astype(np.float32) @ self.vectors.T >= np.float32(least - 1e-5))
            sure = self._sure(queries, i + r, c, least)
            found.append((i + r[sure], c[sure]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _sure(self, queries: np.ndarray, r: np.ndarray, c: np.ndarray, least: float) -> np.ndarray:
        """Which pairs (query, node) have a cosine of at least ``least`` in double precision; so many at a time that memory does not follow their number."""
        out = np.zeros(len(r), bool)
        for i in range(0, len(r), PAIRS):
            out[i : i + PAIRS] = np.einsum("kd,kd->k", queries[r[i : i + PAIRS]], self.exact[c[i : i + PAIRS]]) >= least
        return out

    def tuned(self, least: float, recall: float, beam: int, widest: int, most: int, seed: int = 4) -> int:
        """The width of beams that find that share of the nodes from made-up queries just within ``least`` of them, each in a random direction; 0 if none up to ``widest`` does.

        So the search is audited where true links are too rare to audit. A beam that such nodes all but fill counts, as ``within`` widens it.
        """
        rng = np.random.default_rng(seed)
        at = rng.permutation(len(self.exact))[:most]
        node, aside = self.exact[at], rng.normal(size=(len(at), self.exact.shape[1]))
        aside -= np.einsum("qd,qd->q", aside, node)[:, None] * node
        size = np.linalg.norm(aside, axis=1, keepdims=True)
        cosine = np.where(size > 1e-9, min(1.0, least + 5e-4), 1.0)
        queries = (cosine * node + np.sqrt(1 - cosine**2) * aside / np.maximum(size, 1e-9)).astype(np.float32)
        while beam <= widest:
            wide, found = min(beam, len(self.exact)), 0
            for i in range(0, len(at), 256):
                some = queries[i : i + 256]
                ids, sims = self._beam(some, self._descend(some, np.zeros(len(some), np.int64))[:, None], 0, wide)
                full = (sims[:, -min(SPARE, wide)] >= np.float32(least - 1e-5)) & (wide < len(self.exact))
                found += int(((ids == at[i : i + 256, None]).any(axis=1) | full).sum())
            if found >= recall * len(at):
                return beam
            beam = beam * 5 // 4
        return 0

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, exact=self.exact, level=self.level, **{f"layer{i}": x for i, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        z = np.load(io.BytesIO(data))
        return cls(z["exact"], [z[f"layer{i}"] for i in range(len(z.files) - 2)], z["level"])
