"""Many small graphs as one table of numbers, solved together by numpy inside a task.

Vertices of all graphs of a batch are numbered through in order of graph and vid, so the least
number of a set of one graph's vertices is its least vid.  Work goes by rounds over all graphs at
once and is in proportion to their edges; no step depends on another batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS = 1 << 16  # rows of a batch that goes back to Spark


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as often as its count says, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def least_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number in the component of each of 0..n-1 over the edges u - v."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


class Flat:
    """The graphs of a batch with columns graph_id, directed, n and e, a list of edges src -> dst."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = batch.column("graph_id")
        self.directed = batch.column("directed").to_numpy(zero_copy_only=False).astype(bool)
        self.n = batch.column("n").to_numpy().astype(np.int64)
        self.graphs = len(self.n)
        self.first = np.cumsum(self.n) - self.n
        self.total = int(self.n.sum())
        self.home = np.repeat(np.arange(self.graphs), self.n)
        self.vid = np.arange(self.total) - self.first[self.home]
        lists = batch.column("e")
        self.m = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        self.at = np.repeat(np.arange(self.graphs), self.m)
        self.edges = lists.flatten()
        src, dst = (self.edges.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        self.src, self.dst = src + self.first[self.at], dst + self.first[self.at]
        self.names = batch.column("names").flatten() if "names" in batch.schema.names else None

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Joined pairs u < v whatever the direction, and the number of their edges."""
        off = self.src != self.dst
        u, v = np.minimum(self.src, self.dst)[off], np.maximum(self.src, self.dst)[off]
        key, count = np.unique(u * max(self.total, 1) + v, return_counts=True)
        return key // max(self.total, 1), key % max(self.total, 1), count

    def per_graph(self, of: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(of, weights, minlength=self.graphs)[: self.graphs].astype(np.int64)

    def most(self, of: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The largest value of each graph, 0 where there is none."""
        out = np.zeros(self.graphs, dtype=np.int64)
        np.maximum.at(out, of, values)
        return out

    def rows(self, of: np.ndarray, **columns):
        """Batches with a row for each entry of ``of``, a graph's place; numpy arrays become columns."""
        whole = {k: x if isinstance(x, pa.Array | pa.ChunkedArray) else pa.array(x) for k, x in columns.items()}
        for at in range(0, len(of), ROWS):
            ids = self.ids.take(pa.array(of[at : at + ROWS]))
            yield pa.RecordBatch.from_arrays([ids, *(c.slice(at, ROWS) for c in whole.values())], ["graph_id", *whole])

    def arcs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct arcs u -> v without loops; those of undirected graphs both ways."""
        return self.counted_arcs()[:2]

    def counted_arcs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same with the number of edges of each arc."""
        off = self.src != self.dst
        turned = off & ~self.directed[self.at]
        u, v = np.concatenate([self.src[off], self.dst[turned]]), np.concatenate([self.dst[off], self.src[turned]])
        key, count = np.unique(u * max(self.total, 1) + v, return_counts=True)
        return key // max(self.total, 1), key % max(self.total, 1), count


def _whole_graphs(batches: Iterator[pa.RecordBatch], least: int = 1 << 17) -> Iterator[pa.Table]:
    """Rows sorted by graph_id in tables of about ``least`` rows or more, no graph in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        rows = pa.Table.from_batches(held)
        ids = rows.column("graph_id")
        last = ids[-1]
        same = pc.equal(ids, last) if last.is_valid else pc.is_null(ids)
        cut = len(ids) - (pc.sum(same).as_py() or 0)
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut).combine_chunks().to_batches()
        least = max(least, 2 * sum(b.num_rows for b in held))
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


VERTEX, EDGE, LOOSE = 0, 1, 2  # what a raw row is; a loose edge has ends and is none itself


def packer(directed: bool, listed: bool, named: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs of raw rows (graph_id, what, skind, skey, dkind, dkey) sorted by graph_id: see operators/packs.py.

    Vertices are numbered by kind and key, nulls first.  They are those of the vertex rows if
    ``listed``, and edges with another end go; else they are the ends of the edges.  Packs that are
    ``named`` have raw rows with src_name and dst_name and a column of the vertices' names.
    """

    def pack(rows: pa.Table) -> pa.RecordBatch:
        ids = rows.column("graph_id").combine_chunks().dictionary_encode(null_encoding="encode")
        of = ids.indices.to_numpy().astype(np.int64)
        what = rows.column("what").to_numpy()
        edge = np.flatnonzero(what != VERTEX)
        kinds = pa.concat_arrays([*rows.column("skind").chunks, rows.column("dkind").combine_chunks().take(pa.array(edge))]).dictionary_encode(null_encoding="encode")
        names = kinds.dictionary.to_pylist()
        turn = np.empty(len(names), dtype=np.int64)
        turn[sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i] or ""))] = np.arange(len(names))
        kind = turn[kinds.indices.to_numpy()]
        number = lambda c: rows.column(c).fill_null(np.iinfo(np.int64).min).to_numpy()
        key = np.concatenate([number("skey"), number("dkey")[edge]])
        graph = np.concatenate([of, of[edge]])
        order = np.lexsort((key, kind, graph))
        sorted_ = [x[order] for x in (graph, kind, key)]
        head = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in sorted_], axis=0)])
        spot = np.empty(len(order), dtype=np.int64)
        spot[order] = np.cumsum(head) - 1
        home = sorted_[0][head]
        real = np.ones(len(home), dtype=bool)
        if listed:
            real[:] = False
            real[spot[: len(of)][what == VERTEX]] = True
        n = np.bincount(home[real], minlength=len(ids.dictionary))
        vid = np.cumsum(real) - 1 - (np.cumsum(n) - n)[home]
        s, t = spot[edge], spot[len(of) :]
        good = (what[edge] == EDGE) & real[s] & real[t]
        ends = [pa.array(vid[x[good]].astype(np.int32)) for x in (s, t)]
        m = np.bincount(of[edge[good]], minlength=len(n))
        offsets = pa.array(np.concatenate([[0], np.cumsum(m)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(ends, ["src", "dst"]))
        out = pa.RecordBatch.from_arrays([ids.dictionary, pa.array(np.full(len(n), directed)), pa.array(n.astype(np.int64)), lists], ["graph_id", "directed", "n", "e"])
        if named:
            told = pa.concat_arrays([*rows.column("src_name").chunks, rows.column("dst_name").combine_chunks().take(pa.array(edge))])
            ends_at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            out = out.append_column("names", pa.ListArray.from_arrays(ends_at, told.take(pa.array(order[head][real]))))
        return out if n.all() else out.filter(pa.array(n > 0))

    return lambda batches: map(pack, _whole_graphs(batches))


class Steps:
    """Neighbours in rising order behind each vertex of 0..n-1, from distinct arcs u -> v."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray):
        order = np.lexsort((v, u))
        self.to = v[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n)[:n])]).astype(np.int64)

    @classmethod
    def both_ways(cls, n: int, u: np.ndarray, v: np.ndarray) -> Steps:
        return cls(n, np.concatenate([u, v]), np.concatenate([v, u]))

    def behind(self, rim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the rim, neighbour) for all steps from the rim, in its order."""
        count = self.start[rim + 1] - self.start[rim]
        return np.repeat(np.arange(len(rim)), count), self.to[ranges(self.start[rim], count)]


def levels_from(n: int, roots: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Depth and parent of every vertex in a breadth-first forest from ``roots``, and its levels."""
    depth, parent = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    depth[roots] = 0
    levels, rim = [], roots
    while len(rim):
        levels.append(rim)
        at, to = steps.behind(rim)
        fresh = depth[to] < 0
        source, to = rim[at[fresh]], to[fresh]
        depth[to] = len(levels)
        parent[to] = source
        rim = to[parent[to] == source]  # of several ways to a vertex one has stayed
    return depth, parent, levels


def blocks_of(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, vertex): members of the blocks of distinct pairs u < v, blocks in order of their two least vertices.

    Tarjan and Vishkin's tree and auxiliary graph, as in operators/blocks.py, level by level.
    """
    if not len(u):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    roots = np.flatnonzero(least_labels(n, u, v) == np.arange(n))
    _, parent, levels = levels_from(n, roots, Steps.both_ways(n, u, v))
    size = np.ones(n, dtype=np.int64)
    for level in reversed(levels[1:]):
        np.add.at(size, parent[level], size[level])
    pre = np.empty(n, dtype=np.int64)
    pre[roots] = np.cumsum(size[roots]) - size[roots]
    for i, level in enumerate(levels[1:], 1):
        levels[i] = level = level[np.argsort(parent[level], kind="stable")]
        before = np.cumsum(size[level]) - size[level]
        head = np.concatenate([[True], parent[level][1:] != parent[level][:-1]])
        own = np.repeat(before[head], np.diff(np.append(np.flatnonzero(head), len(level))))
        pre[level] = pre[parent[level]] + 1 + before - own
    other = (parent[v] != u) & (parent[u] != v)
    a, b = u[other], v[other]
    low, high = pre.copy(), pre.copy()
    for x, y in ((a, b), (b, a)):
        np.minimum.at(low, x, pre[y])
        np.maximum.at(high, x, pre[y])
    for level in reversed(levels[1:]):
        np.minimum.at(low, parent[level], low[level])
        np.maximum.at(high, parent[level], high[level])
    child = np.concatenate([*levels[1:], np.empty(0, dtype=np.int64)])
    up = parent[child]
    along = (parent[up] >= 0) & ((low[child] < pre[up]) | (high[child] >= pre[up] + size[up]))
    across = (pre[b] >= pre[a] + size[a]) | (pre[a] >= pre[b] + size[b])
    label = least_labels(n, np.concatenate([child[along], a[across]]), np.concatenate([up[along], b[across]]))
    key = np.unique(np.concatenate([label[child] * n + child, label[child] * n + up]))
    mark, member = key // n, key % n
    heads = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
    order = np.lexsort((member[heads + 1], member[heads]))
    place = np.empty(len(heads), dtype=np.int64)
    place[order] = np.arange(len(heads))
    lengths = np.diff(np.append(heads, len(mark)))
    return np.repeat(place, lengths), member


def strong_labels(n: int, steps: Steps) -> np.ndarray:
    """The least vertex of each vertex's strong component (Tarjan, without recursion)."""
    start, to = steps.start.tolist(), steps.to.tolist()
    number, low, label = [-1] * n, [0] * n, [-1] * n
    turn, held = 0, []
    for root in range(n):
        if number[root] >= 0:
            continue
        number[root] = low[root] = turn
        turn += 1
        held.append(root)
        way, next_ = [root], [start[root]]
        while way:
            x, i = way[-1], next_[-1]
            if i < start[x + 1]:
                next_[-1] = i + 1
                y = to[i]
                if number[y] < 0:
                    number[y] = low[y] = turn
                    turn += 1
                    held.append(y)
                    way.append(y)
                    next_.append(start[y])
                elif label[y] < 0 and number[y] < low[x]:
                    low[x] = number[y]
                continue
            way.pop()
            next_.pop()
            if way and low[x] < low[way[-1]]:
                low[way[-1]] = low[x]
            if low[x] == number[x]:
                group = [held.pop()]
                while group[-1] != x:
                    group.append(held.pop())
                least = min(group)
                for y in group:
                    label[y] = least
    return np.array(label, dtype=np.int64)


def hops_between(flat: Flat, steps: Steps, most: int = 1 << 20):
    """(sources, lengths, hops): hops from each source to every vertex of its graph, -1 without a way.

    Sources come in runs of at most ``most`` pairs together, or one source.
    """
    reach = flat.n[flat.home]
    ends = np.cumsum(reach)
    a = 0
    while a < flat.total:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        sources, size = np.arange(a, b), reach[a:b]
        base = np.cumsum(size) - size
        hops, owner = np.full(int(size.sum()), -1, dtype=np.int32), np.empty(int(size.sum()), dtype=np.int64)
        which, rim = np.arange(b - a), sources
        hops[base + flat.vid[sources]] = 0
        level = 0
        while len(rim):
            level += 1
            at, to = steps.behind(rim)
            spot = base[which[at]] + flat.vid[to]
            fresh = hops[spot] < 0
            at, to, spot = at[fresh], to[fresh], spot[fresh]
            hops[spot] = level
            owner[spot] = np.arange(len(spot))
            one = owner[spot] == np.arange(len(spot))
            which, rim = which[at[one]], to[one]
        yield sources, size, hops
        a = b


SIGNS = ["", " – ", " ← ", " → ", " ↔ "]


def semipaths(flat: Flat, most: int = 1 << 18):
    """(s, t, text, forth): names along the least shortest path when direction is ignored, with a sign a step.

    Levels of all sources of a run grow together, in order of their ways, so the first way to a
    vertex is the least; ``forth`` says whether every step has an arc forth.
    """
    u, v, _ = flat.pairs()
    steps = Steps.both_ways(flat.total, u, v)
    source = np.repeat(np.arange(flat.total), np.diff(steps.start))
    a, b = flat.arcs()
    arcs = a * max(flat.total, 1) + b
    forth, back = (np.isin(x * max(flat.total, 1) + y, arcs) for x, y in ((source, steps.to), (steps.to, source)))
    sign = np.where(flat.directed[flat.home[source]], np.where(forth, np.where(back, 4, 3), 2), 1)
    signs, names = pa.array(SIGNS), flat.names
    reach = flat.n[flat.home]
    ends = np.cumsum(reach)
    i = 0
    while i < flat.total:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        base = np.cumsum(reach[i:j]) - reach[i:j]
        seen = np.zeros(int(reach[i:j].sum()), dtype=bool)
        which, rim, text, good = np.arange(j - i), np.arange(i, j), pc.fill_null(names.slice(i, j - i), ""), np.ones(j - i, dtype=bool)
        seen[base + flat.vid[rim]] = True
        while len(rim):
            yield i + which, rim, text, good
            count = steps.start[rim + 1] - steps.start[rim]
            at, entry = np.repeat(np.arange(len(rim)), count), ranges(steps.start[rim], count)
            spot = base[which[at]] + flat.vid[steps.to[entry]]
            fresh = np.flatnonzero(~seen[spot])
            first = fresh[np.sort(np.unique(spot[fresh], return_index=True)[1])]
            seen[spot[first]] = True
            at, entry = at[first], entry[first]
            which, rim, good = which[at], steps.to[entry], good[at] & forth[entry]
            text = pc.binary_join_element_wise(text.take(pa.array(at)), signs.take(pa.array(sign[entry])), pc.fill_null(names.take(pa.array(rim)), ""), "")
        i = j


def spanning_ends(n: int, into: np.ndarray, start: int | None) -> np.ndarray:
    """Bits of the vertices in which spanning paths of each graph end, from ``start`` or any vertex.

    ``into``: for each graph and vertex the bits of the vertices with an arc to it.  The table of ends by
    visited set is filled by sizes of the sets, for all graphs of n vertices at once.
    """
    ends = np.zeros((1 << n, len(into)), dtype=np.int32)
    for v in range(n) if start is None else [start]:
        ends[1 << v] = 1 << v
    sets = np.arange(1 << n)
    size = sum((sets >> v) & 1 for v in range(n))
    for k in range(2, n + 1):
        mine = sets[size == k]
        for v in range(n):
            with_v = mine[(mine >> v) & 1 == 1]
            ends[with_v] |= ((ends[with_v ^ (1 << v)] & into[:, v]) != 0).astype(np.int32) << v
    return ends[-1]


def of_one_order(flat: Flat, limit: int, cells: int = 1 << 22):
    """(n, places of graphs, into) for runs of graphs of n <= limit vertices, n >= 1; see spanning_ends."""
    u, v = flat.arcs()
    keep = flat.n[flat.home[u]] <= limit
    bits = np.zeros(flat.total, dtype=np.int64)
    np.bitwise_or.at(bits, v[keep], 1 << flat.vid[u[keep]])
    for n in np.unique(flat.n[(flat.n >= 1) & (flat.n <= limit)]).tolist():
        places = np.flatnonzero(flat.n == n)
        step = max(1, cells >> n)
        for i in range(0, len(places), step):
            mine = places[i : i + step]
            yield n, mine, bits[flat.first[mine][:, None] + np.arange(n)].astype(np.int32)
