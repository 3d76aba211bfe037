"""A sample that matches target shares of cross-classified categories: min-cost flow on cell counts.

source -> row category -> cell -> column category -> sink. A cell's arcs carry, in this order, its floor, the rest of
what is needed, and (where asked) more than that to make good what other cells of its margins lack; each is bounded
by the availability. A slack arc of high cost takes what cannot be met and so exposes the shortfall. The number of
categories is the target table's, so the network does not grow with the data. Fractional quotas are rounded at random
along cycles of the cell graph, which keeps every expected quota and moves no margin by one or more.
"""

from __future__ import annotations

import heapq
import random

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.llm.mixing import source_key

SCALE = 1000  # flow units of one record
FLOOR, WANTED, EXTRA, SLACK = 0, 1, 40, 1000  # costs
BITS = 14


class Network:
    """Min-cost flow by successive shortest paths with potentials."""

    def __init__(self):
        self.at: dict = {}
        self.to, self.cap, self.cost, self.out = [], [], [], []

    def node(self, name) -> int:
        if name not in self.at:
            self.at[name] = len(self.out)
            self.out.append([])
        return self.at[name]

    def arc(self, a, b, cap: int, cost: int) -> int:
        a, b, k = self.node(a), self.node(b), len(self.to)
        self.to += [b, a]
        self.cap += [cap, 0]
        self.cost += [cost, -cost]
        self.out[a].append(k)
        self.out[b].append(k + 1)
        return k

    def flow(self, k: int) -> int:
        return self.cap[k ^ 1]

    def run(self, source, sink) -> int:
        s, t, total = self.node(source), self.node(sink), 0
        high = [0] * len(self.out)
        while True:
            far, by, queue = [None] * len(self.out), [-1] * len(self.out), [(0, s)]
            far[s] = 0
            while queue:
                d, v = heapq.heappop(queue)
                if d > far[v]:
                    continue
                for k in self.out[v]:
                    w = self.to[k]
                    if self.cap[k] > 0 and (far[w] is None or d + self.cost[k] + high[v] - high[w] < far[w]):
                        far[w], by[w] = d + self.cost[k] + high[v] - high[w], k
                        heapq.heappush(queue, (far[w], w))
            if far[t] is None:
                return total
            high = [h + f if f is not None else h for h, f in zip(high, far)]
            push, v = 1 << 60, t
            while v != s:
                push, v = min(push, self.cap[by[v]]), self.to[by[v] ^ 1]
            v = t
            while v != s:
                self.cap[by[v]] -= push
                self.cap[by[v] ^ 1] += push
                v = self.to[by[v] ^ 1]
            total += push


def needed(share: float, size: int, least: int) -> int:
    return max(int(share * size + 0.5), least)


def _margins(cells: list[tuple], units: list[int], least: int, make_good: bool) -> tuple[Network, list[list[int]], list[int]]:
    """(network after its run, arcs of each cell that draw, slack arc of each cell) over the margins of rows and columns.

    source -> row -> cell -> column -> sink; a row's or column's margin is the sum of its units, and so is what may go
    through a cell. The arcs past a cell that make good what others lack are not bound by the cell's own units.
    """
    net, arcs, slack, rows, columns = Network(), [], [], {}, {}
    for i, (r, c, _, have) in enumerate(cells):
        rows[r] = rows.get(r, 0) + units[i]
        columns[c] = columns.get(c, 0) + units[i]
        net.arc(("row", r), ("cell", i), units[i], 0)
        floor = min(have, least) * SCALE
        own = [net.arc(("cell", i), ("column", c), min(floor, units[i]), FLOOR), net.arc(("cell", i), ("column", c), max(0, min(have * SCALE, units[i]) - floor), WANTED)]
        if make_good and have * SCALE > units[i]:
            own.append(net.arc(("row", r), ("column", c), have * SCALE - units[i], EXTRA))
        slack.append(net.arc(("cell", i), ("column", c), units[i], SLACK))
        arcs.append(own)
    for r, n in rows.items():
        net.arc("source", ("row", r), n, 0)
    for c, n in columns.items():
        net.arc(("column", c), "sink", n, 0)
    net.run("source", "sink")
    return net, arcs, slack


def quotas(cells: list[tuple], size: int, least: int, make_good: bool = True) -> list[tuple]:
    """(row, column, needed, available, quota, shortfall) of (row, column, share, available) cells.

    shortfall is what the cell's slack arc carries when every margin asks for all that its cells need; quota the
    fractional number to draw, which with make_good also makes good what other cells lack while the margins allow.
    """
    if not cells:
        return []
    want = [needed(s, size, least) for _, _, s, _ in cells]
    net, _, slack = _margins(cells, [w * SCALE for w in want], least, False)
    short = [net.flow(k) // SCALE for k in slack]
    units = [round(x * SCALE) for x in _filled([s for _, _, s, _ in cells], size, least)]
    net, arcs, _ = _margins(cells, units, least, make_good)
    drawn = [sum(net.flow(k) for k in own) / SCALE for own in arcs]
    return [(r, c, want[i], have, drawn[i], short[i]) for i, (r, c, _, have) in enumerate(cells)]


def _filled(shares: list[float], size: int, least: int) -> list[float]:
    """share times a common size, at least least each, with the sum size if the floors leave room."""
    low, high = 0.0, float(size)
    for _ in range(80):
        mid = (low + high) / 2
        if sum(max(least, s * mid) for s in shares) > size:
            high = mid
        else:
            low = mid
    return [max(float(least), s * low) for s in shares]


def rounded(cells: list[tuple], seed: int) -> list[int]:
    """Integer quotas of (row, column, quota) cells: each is its quota's floor or ceiling with the quota as expectation.

    Fractional cells are edges between rows and columns; a random step along a cycle, or along a path between margins
    that end in a fraction, makes one of them integral without changing the margins passed through.
    """
    draw = random.Random(seed)
    whole = [int(q + 1e-9) for _, _, q in cells]
    part = [max(0.0, q - w) for (_, _, q), w in zip(cells, whole)]
    while True:
        open_ = [i for i, p in enumerate(part) if 1e-7 < p < 1 - 1e-7]
        if not open_:
            break
        at: dict = {}
        for i in open_:
            for v in (("r", cells[i][0]), ("c", cells[i][1])):
                at.setdefault(v, []).append(i)
        ends = [v for v, e in at.items() if len(e) == 1]
        v = ends[0] if ends else next(iter(at))
        path, seen, last = [], {v: 0}, None
        while True:
            edge = next((i for i in at[v] if i != last), None)
            if edge is None:
                break
            path.append(edge)
            last = edge
            r, c = ("r", cells[edge][0]), ("c", cells[edge][1])
            v = c if v == r else r
            if v in seen:
                path = path[seen[v] :]
                break
            seen[v] = len(path)
        up = min([1 - part[i] if k % 2 == 0 else part[i] for k, i in enumerate(path)])
        down = min([part[i] if k % 2 == 0 else 1 - part[i] for k, i in enumerate(path)])
        step = up if draw.random() < down / (up + down) else -down
        for k, i in enumerate(path):
            part[i] = min(1.0, max(0.0, part[i] + (step if k % 2 == 0 else -step)))
    return [w + round(p) for w, p in zip(whole, part)]


def cell_columns(df: DataFrame, row: str, column: str, id_col: str) -> DataFrame:
    """(row, column, id) of the records with both categories and an id; the row category in its normal spelling."""
    return df.select(source_key(F.col(row)).alias("row"), F.col(column).cast("int").alias("column"), F.col(id_col).alias("id")).where("row is not null and row <> '' and column is not null and id is not null")


def available(cells: DataFrame) -> DataFrame:
    """(row, column, available): distinct ids of each cell."""
    return cells.groupBy("row", "column", "id").agg(F.lit(1).alias("one")).groupBy("row", "column").agg(F.count("*").alias("available"))


def plan(df: DataFrame, target: DataFrame, size: int, least: int, row: str = "temporal_bin", column: str = "section", id_col: str = "sentenceID", share: str = "target_share", seed: int = 7) -> DataFrame:
    """(row_name, row, column, needed, available, quota, shortfall), a row for each target category.

    Targets without row or column are skipped, of repeated ones the largest share holds; a null share, size or least
    counts as 0. A category without records has 0 available.
    """
    spark = df.sparkSession
    t = target.select(F.col(row).alias("row_name"), source_key(F.col(row)).alias("row"), F.col(column).cast("int").alias("column"), F.coalesce(F.col(share).cast("double"), F.lit(0.0)).alias("share"))
    t = t.where("row is not null and column is not null").groupBy("row", "column").agg(F.min("row_name").alias("row_name"), F.max("share").alias("share"))
    joined = t.join(available(cell_columns(df, row, column, id_col)), ["row", "column"], "left").select("row_name", "row", "column", "share", F.coalesce("available", F.lit(0)).alias("available"))
    rows = sorted(tuple(r) for r in joined.toLocalIterator())  # as many as target categories
    size, least = int(size or 0), int(least or 0)
    got = quotas([(r[1], r[2], r[3], r[4]) for r in rows], size, least)
    whole = rounded([(g[0], g[1], g[4]) for g in got], seed)
    out = [(r[0], g[0], g[1], g[2], g[3], w, g[5]) for r, g, w in zip(rows, got, whole)]
    return spark.createDataFrame(out, "row_name string, row string, column int, needed long, available long, quota long, shortfall long")


def draw(df: DataFrame, quota: DataFrame, row: str = "temporal_bin", column: str = "section", id_col: str = "sentenceID", seed: int = 7) -> DataFrame:
    """(row, column, id): quota distinct ids of each cell, those of least seeded hash, ties by id.

    A histogram of the hash's first bits finds the interval in which a cell's quota is reached; only ids of that
    interval, one in 2**BITS of a cell, are ranked, so the largest cell is never sorted.
    """
    wanted = quota.where("quota > 0").select("row", "column", "quota")  # a row for each target category
    cells = cell_columns(df, row, column, id_col).join(F.broadcast(wanted), ["row", "column"])
    ids = cells.groupBy("row", "column", "id").agg(F.first("quota").alias("quota")).withColumn("h", F.xxhash64(F.lit(seed), "id"))
    ids = ids.withColumn("b", F.shiftrightunsigned("h", 64 - BITS))
    steps = ids.groupBy("row", "column", "b").agg(F.count("*").alias("n"))
    run = Window.partitionBy("row", "column").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    ids = ids.join(steps, ["row", "column", "b"]).where("before < quota")
    sure = ids.where("before + n <= quota").select("row", "column", "id")
    edge = ids.where("before + n > quota").withColumn("k", F.row_number().over(Window.partitionBy("row", "column", "b").orderBy("h", "id")))
    return sure.unionByName(edge.where("before + k <= quota").select("row", "column", "id"))
