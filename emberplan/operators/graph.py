"""Pixel regions, walkable graphs, shortest paths and greedy cover.

What is bound to one page or one small graph (a floor) and sequential by nature runs in one call
for many of them; nothing here joins pixels with pixels, whose number Spark cannot estimate.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EIGHT = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def _runs(page, row, col) -> list:
    """Pixels sorted by page, row and column to runs [page, row, first column, last column]."""
    import numpy as np

    cut = np.ones(len(page), bool)
    cut[1:] = (page[1:] != page[:-1]) | (row[1:] != row[:-1]) | (col[1:] > col[:-1] + 1)  # a repeated pixel stays in its run
    at = np.flatnonzero(cut)
    return [page[at], row[at], col[at], col[np.append(at[1:], len(page)) - 1]]


def _joined(chunks: list) -> list:
    """Chunks of runs as one; a run that goes on over the border of two chunks is one again."""
    import numpy as np

    page, row, c0, c1 = (np.concatenate([x[i] for x in chunks]) for i in range(4))
    more = np.flatnonzero((page[1:] == page[:-1]) & (row[1:] == row[:-1]) & (c0[1:] <= c1[:-1] + 1)) + 1
    keep = np.ones(len(page), bool)
    keep[more] = False
    at = np.flatnonzero(keep)
    return [page[at], row[at], c0[at], c1[np.append(at[1:], len(page)) - 1]]


def _run_roots(page, row, c0, c1):
    """The first run of each run's eight-connected component; runs are sorted."""
    import numpy as np

    first = c0.min()
    a, b, wide = c0 - first + 1, c1 - first + 1, c1.max() - first + 3
    line = np.zeros(len(page), np.int64)  # neighbouring rows of a page differ by 1, others by 2
    same = page[1:] == page[:-1]
    line[1:] = np.cumsum(np.where(same & (row[1:] == row[:-1]), 0, np.where(same & (row[1:] == row[:-1] + 1), 1, 2)))
    lo = np.searchsorted(line * wide + b, (line + 1) * wide + a - 1, "left")
    hi = np.searchsorted(line * wide + a, (line + 1) * wide + b + 1, "right")
    n = np.maximum(hi - lo, 0)
    u = np.repeat(np.arange(len(page)), n)
    v = np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    root = np.arange(len(page))
    while len(u):
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return root


def _regions(batches):
    """(page, label, size, r0, c0, r1, c1) of the components of pixels that come sorted. Of a page
    that isn't over yet only the runs are held."""
    import numpy as np
    import pyarrow as pa

    names = ["page", "label", "size", "r0", "c0", "r1", "c1"]

    def found(runs: list):
        page, row, c0, c1 = runs
        root = _run_roots(page, row, c0, c1)
        order = np.argsort(root, kind="stable")
        at = np.flatnonzero(np.diff(root[order], prepend=-1))
        one = root[order][at]
        size = np.add.reduceat((c1 - c0 + 1)[order], at)
        least = [np.minimum.reduceat(x[order], at) for x in (row, c0)]
        most = [np.maximum.reduceat(x[order], at) for x in (row, c1)]
        cols = [page[one], row[one] * 100_000 + c0[one], size, *least, *most]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)

    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        runs = _runs(*(np.asarray(c).astype(np.int64) for c in b.columns))
        over = int(np.searchsorted(runs[0], runs[0][-1]))  # runs of pages before the last
        if held and (over or held[-1][0][-1] != runs[0][0]):
            yield found(_joined([*held, [x[:over] for x in runs]]))
            held = []
        elif over:
            yield found([x[:over] for x in runs])
        held.append([x[over:] for x in runs])
    if held:
        yield found(_joined(held))


def regions(pixels: DataFrame, width: int, height: int, least: int = 500) -> DataFrame:
    """(page, label, size, r0, c0, r1, c1): eight-connected regions off the border, large enough.

    Pixels are dealt by page and sorted; a task goes over its pages' rows once, by runs of pixels.
    Repeated pixels count once. label: row * 100000 + column of the region's first pixel.
    """
    x = pixels.select(F.col("page").cast("long").alias("page"), "row", "col").where("page is not null and row is not null and col is not null")
    x = x.repartition("page").sortWithinPartitions("page", "row", "col")
    agg = x.mapInArrow(_regions, "page long, label long, size long, r0 long, c0 long, r1 long, c1 long")
    inside = (F.col("r0") > 0) & (F.col("c0") > 0) & (F.col("r1") < height - 1) & (F.col("c1") < width - 1)
    return agg.where(inside & (F.col("size") >= least))


def opened(pixels: DataFrame, radius: int) -> DataFrame:
    """Morphological opening of a page's pixels by a disk: numpy, a page a call."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        disk = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
        m = np.zeros((pdf.row.max() + 2 * radius + 1, pdf.col.max() + 2 * radius + 1), bool)
        m[pdf.row + radius, pdf.col + radius] = True
        shift = lambda x, i, j: np.roll(np.roll(x, i, 0), j, 1)  # noqa: E731  the margin keeps rolls apart
        small = np.logical_and.reduce([shift(m, i, j) for i, j in disk])
        big = np.logical_or.reduce([shift(small, i, j) for i, j in disk])
        r, c = np.nonzero(big)
        return pd.DataFrame({"page": pdf.page.iloc[0] if len(pdf) else 0, "row": r - radius, "col": c - radius})

    return pixels.groupBy("page").applyInPandas(run, "page long, row int, col int")


def thinned(pixels: DataFrame) -> DataFrame:
    """A one-pixel skeleton of a page's pixels by two-pass thinning: numpy, a page a call."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        m = np.zeros((pdf.row.max() + 3, pdf.col.max() + 3), bool)
        m[pdf.row + 1, pdf.col + 1] = True
        around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
        changed = True
        while changed:
            changed = False
            for one, two in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6))):
                p = [np.roll(np.roll(m, -i, 0), -j, 1) for i, j in around]
                n = sum(x.astype(int) for x in p)
                turns = sum((~p[k] & p[(k + 1) % 8]).astype(int) for k in range(8))
                gone = m & (n >= 2) & (n <= 6) & (turns == 1) & ~(p[one[0]] & p[one[1]] & p[one[2]]) & ~(p[two[0]] & p[two[1]] & p[two[2]])
                changed |= bool(gone.any())
                m &= ~gone
        r, c = np.nonzero(m)
        return pd.DataFrame({"page": pdf.page.iloc[0] if len(pdf) else 0, "row": r - 1, "col": c - 1})

    return pixels.groupBy("page").applyInPandas(run, "page long, row int, col int")


def degrees(edges: DataFrame) -> DataFrame:
    """(grp, node, degree) of undirected edges (grp, src, dst)."""
    ends = edges.select("grp", F.col("src").alias("node")).unionByName(edges.select("grp", F.col("dst").alias("node")))
    return ends.groupBy("grp", "node").agg(F.count("*").alias("degree"))


def _per_graph(edges: DataFrame, run, schema: str) -> DataFrame:
    """run(grp, [(src, dst, length), ...]) -> rows, for each graph; a batch holds many graphs."""
    lists = edges.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "length"))).alias("e"))
    names = [x.split()[0] for x in schema.split(", ")]

    def batches(it):
        import pyarrow as pa

        types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        fields = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)])
        for b in it:
            rows = []
            for grp, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += run(grp, [(x["src"], x["dst"], x["length"]) for x in e])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)

    return lists.mapInArrow(batches, schema)


def _adjacency(edges: list[tuple]) -> dict:
    g: dict = {}
    for s, d, w in edges:
        if s != d:
            for a, b in ((s, d), (d, s)):
                g.setdefault(a, {})[b] = min(w, g.get(a, {}).get(b, w))
    return g


def _from(g: dict, start, most: float | None) -> dict:
    dist, heap = {}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if n in dist or most is not None and d > most:
            continue
        dist[n] = d
        for m, w in g[n].items():
            if m not in dist:
                heapq.heappush(heap, (d + w, m))
    return dist


def _prune(g: dict, longest: float) -> bool:
    """Takes out the chains that lead from a leaf to a junction or another leaf and are short
    enough, all judged on the graph as it was; whether any fell."""
    fallen: set = set()
    for leaf in (n for n in g if len(g[n]) == 1):
        chain, total, prev, at = [], 0.0, None, leaf
        while total <= longest and len(ahead := [n for n in g[at] if n != prev]) == 1:
            chain.append(at)
            total += g[at][ahead[0]]
            prev, at = at, ahead[0]
        if total <= longest:
            fallen.update(chain)
    for n in fallen:
        for m in g.pop(n):
            g.get(m, {}).pop(n, None)
    return bool(fallen)


def _contract(g: dict) -> dict:
    """The graph of leaves and junctions: a chain of nodes with two neighbours is an edge, of
    parallel ones the shortest stays, and loops go. Which nodes stay is fixed beforehand."""
    out: dict = {n: {} for n in g if len(g[n]) != 2}
    for start in out:
        for at, length in g[start].items():
            prev = start
            while at not in out:
                ahead = next(n for n in g[at] if n != prev)
                length += g[at][ahead]
                prev, at = at, ahead
            if at != start:
                out[start][at] = out[at][start] = min(length, out[start].get(at, length))
    return out


def _largest_part(g: dict) -> set:
    seen, best = set(), []
    for n in sorted(g):
        if n not in seen:
            part, todo = [], [n]
            seen.add(n)
            while todo:
                x = todo.pop()
                part.append(x)
                for m in g[x]:
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            best = max(best, part, key=len)
    return set(best)


def walkable(edges: DataFrame, prune: float = 40.0, most_rounds: int = 50) -> DataFrame:
    """edges (grp, src, dst, length) of a floor's skeleton to its contracted graph.

    Leaf chains up to `prune` long fall, isolated ones too, for at most most_rounds rounds; then
    chains of nodes with two neighbours become one edge, loops go; the largest component stays (ties: the one with the
    least node). Gives (grp, src, dst, length), src < dst.
    """

    def run(grp, e):
        g = _adjacency(e)
        for _ in range(most_rounds):
            if not _prune(g, prune):
                break
        g = _contract(g)
        keep = _largest_part(g)
        return [(grp, s, d, w) for s in sorted(keep) for d, w in sorted(g[s].items()) if s < d]

    return _per_graph(edges, run, "grp long, src long, dst long, length double")


def shortest_paths(edges: DataFrame, most: float | None = None) -> DataFrame:
    """(grp, src, dst, dist) between all nodes of a small graph, itself included, up to `most`."""

    def run(grp, e):
        g = _adjacency(e)
        return [(grp, s, d, x) for s in sorted(g) for d, x in sorted(_from(g, s, most).items())]

    return _per_graph(edges, run, "grp long, src long, dst long, dist double")


def cover(edges: DataFrame, radius: float) -> DataFrame:
    """(grp, step, node, covers, junction): places so that every node is within radius of one.

    Each step takes the candidate that newly covers most; ties go to junctions (three
    neighbours or more), then to the least node. Candidates are junctions and leaves; where none
    covers anything, the least uncovered node is taken.
    """

    def run(grp, e):
        g = _adjacency(e)
        reach = {n: set(_from(g, n, radius)) for n in g}
        junction = {n for n in g if len(g[n]) >= 3}
        places = sorted(junction | {n for n in g if len(g[n]) == 1})
        left, rows = set(g), []
        while left:
            node = min(places, key=lambda n: (-len(reach[n] & left), n not in junction, n), default=None)
            if node is None or not reach[node] & left:
                node = min(left)
            new = reach[node] & left
            rows.append((grp, len(rows), node, len(new), node in junction))
            left -= new
        return rows

    return _per_graph(edges, run, "grp long, step int, node long, covers long, junction boolean")
