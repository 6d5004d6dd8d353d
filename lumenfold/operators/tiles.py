"""Nearest points inside tiles of a bounded number of places.

A tile gets its own places and all points within a halo around it, so a place is searched in one task against points that
moved a few times each, and its pairs never leave the task. Inside, places are taken in small boxes that look at the points
around them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import is_whole
from .neighbours import PLACE

TILE = ["tx", "ty", "tz"]
#: Places of a tile, at most and as they are aimed at; of a box; and pairs that are compared at once.
TILE_PLACES, AIM, BOX, PAIRS = 16384, 2048, 64, 1 << 20


def largest(places: DataFrame, tile: dict[str, Column]) -> int:
    """The places of the tile that has most. tile: the number of a place's tile on each axis."""
    return places.where("nth = 1").groupBy(*[tile[c].alias(f"t{c}") for c in "xyz"]).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0


def dealt(places: DataFrame, low: dict[str, Column], own: dict[str, Column], high: dict[str, Column]) -> DataFrame:
    """A row for each point and tile that it is in or near to, with own: whether its place is searched there. low, own, high: the
    numbers of its tiles on each axis."""
    out = places.withColumns({f"own{c}": own[c].cast("long") for c in "xyz"})
    out = out.withColumns({f"{e}{c}": v[c].cast("long") for e, v in (("low", low), ("high", high)) for c in "xyz"})
    for c in "xyz":
        out = out.withColumn(f"t{c}", F.explode(F.sequence(f"low{c}", f"high{c}"))).drop(f"low{c}", f"high{c}")
    mine = F.col("nth") == 1
    for c in "xyz":
        mine = mine & (F.col(f"t{c}") == F.col(f"own{c}"))
    return out.withColumn("own", mine).drop("nth", *[f"own{c}" for c in "xyz"])


def _boxes(at: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """rows in boxes of at most BOX, split at the middle of their longest axis. at: an array per axis."""
    todo = [rows]
    while todo:
        rows = todo.pop()
        if len(rows) <= BOX:
            if len(rows):
                yield rows
            continue
        own = at[:, rows]
        axis = np.argmax(own.max(axis=1).astype(np.float64) - own.min(axis=1))
        order = rows[np.argsort(own[axis], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]


def _least(d: np.ndarray, far, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k + 1 least of each row of d that are under far, ties in the order of the columns: row, column and rank from 1."""
    limit = np.partition(d, k, axis=1)[:, k] if d.shape[1] > k + 1 else np.full(len(d), far, d.dtype)
    row, column = np.nonzero((d <= limit[:, None]) & (d < far))
    order = np.lexsort((column, d[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    keep = rank <= k + 1
    return row[keep], column[keep], rank[keep]


def _distances(p: np.ndarray, rows: np.ndarray, near: np.ndarray) -> np.ndarray:
    """In the types and the order of operations of squared_distance."""
    d = 0
    for v in p:
        step = v[rows][:, None] - v[near]
        d = d + step * step
    return d


def searched(rows: DataFrame, k: int, search: Callable[[dict[str, np.ndarray], np.ndarray], Iterator[tuple]]) -> DataFrame:
    """q_idx, x, y, z and found of the places that `search` lists in their tiles. rows: from dealt; search: from a tile's columns
    and coordinates, in the order of ties, yields the rows of places and what _least gives for them with the columns as rows."""
    whole = is_whole(rows)
    kind, far = (np.int64, np.iinfo(np.int64).max) if whole else (np.float32, np.float32(np.inf))
    spark_kind = "long" if whole else "float"
    entry = pa.struct([("rn", pa.int32()), ("d", pa.int64() if whole else pa.float32()), ("n_idx", pa.int64()), ("n_intensity", pa.int32())])
    schema = f"q_idx long, x {spark_kind}, y {spark_kind}, z {spark_kind}, found array<struct<rn:int,d:{'bigint' if whole else 'float'},n_idx:bigint,n_intensity:int>>"

    def run(table: pa.Table) -> pa.Table:
        col = {n: table.column(n).to_numpy() for n in table.column_names if n not in TILE}
        order = np.lexsort([col[c] for c in ("idx", "z", "y", "x")])
        col = {n: v[order] for n, v in col.items()}
        p = np.stack([col[c].astype(kind) for c in PLACE])
        if whole and np.abs(p).max(initial=0) >= 1 << 30:
            raise OverflowError("squared distances of these coordinates exceed 64 bits")
        at, sizes, parts = [], [], []
        for q, row, found, rank, d in search(col, p):
            at.append(q)
            sizes.append(np.bincount(row, minlength=len(q)))
            parts.append((rank, d, col["idx"][found], col["intensity"][found]))
        q = np.concatenate(at) if at else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if at else [0]
        values = [np.concatenate([x[i] for x in parts]) if parts else np.zeros(0) for i in range(4)]
        struct = pa.StructArray.from_arrays([pa.array(v.astype(f.type.to_pandas_dtype())) for v, f in zip(values, entry, strict=True)], fields=list(entry))
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
        return pa.table({"q_idx": pa.array(col["idx"][q]), **{c: pa.array(p[i][q]) for i, c in enumerate(PLACE)}, "found": found})

    return rows.groupBy(*TILE).applyInArrow(run, schema)


def exact_lists(places: DataFrame, low: dict[str, float], size: float, k: int) -> DataFrame:
    """The lists of the places whose last neighbour is sure to be nearer than the halo, a quarter of the tiles' size."""
    whole, halo = is_whole(places), size / 4
    # as for the reach of cells
    sure = (1 - 1e-6) if whole else (1 - 1e-6) * (1 - 1e-4)
    number = lambda shift: {c: F.floor((F.col(c).cast("double") - low[c] + shift) / size) for c in "xyz"}

    def search(col: dict[str, np.ndarray], p: np.ndarray) -> Iterator[tuple]:
        todo, exact = np.flatnonzero(col["own"]), p.astype(np.float64)
        if not len(todo) or p.shape[1] <= k:
            return
        first = min(halo, 1.7 * size * (3 * (k + 1) / (4 * np.pi * len(todo))) ** (1 / 3))
        for r in dict.fromkeys((first, halo)):
            left = []
            for q in _boxes(p, todo):
                inside = ((exact >= exact[:, q].min(axis=1)[:, None] - r) & (exact <= exact[:, q].max(axis=1)[:, None] + r)).all(axis=0)
                near = np.flatnonzero(inside)
                if len(near) <= k:
                    left.append(q)
                    continue
                for some in np.array_split(q, max(1, -(-len(q) * len(near) // PAIRS))):
                    d = _distances(p, some, near)
                    last = np.partition(d, k, axis=1)[:, k]
                    done = last < (r * r) * sure * sure
                    left.append(some[~done])
                    some, d = some[done], d[done]
                    if len(some):
                        row, found, rank = _least(d, np.iinfo(np.int64).max if whole else np.float32(np.inf), k)
                        yield some, row, near[found], rank, d[row, found]
            todo = np.concatenate(left) if left else todo[:0]

    # a little more than the halo, so that rounding leaves nothing out
    return searched(dealt(places, number(-halo * (1 + 1e-6)), number(0), number(halo * (1 + 1e-6))), k, search)


#: Cells of a tile and around it: places whose search ends within HALO cells are searched in tiles.
WIDTH, HALO = 12, 4


def cell_tile(shift: int = 0) -> dict[str, Column]:
    return {c: F.floor((F.col(f"g{c}") + shift) / WIDTH) for c in "xyz"}


def approx_lists(celled: DataFrame, k: int, least: int) -> DataFrame:
    """The lists of the places whose search ends within HALO cells, if they have candidates. celled: places with gx, gy, gz and
    stop; least: the first ring."""

    def search(col: dict[str, np.ndarray], p: np.ndarray) -> Iterator[tuple]:
        far = np.iinfo(np.int64).max if p.dtype == np.int64 else np.float32(np.inf)
        g, stop = np.stack([col[f"g{c}"] for c in "xyz"]), col["stop"]
        for q in _boxes(g, np.flatnonzero(col["own"] & (stop <= HALO))):
            r = stop[q].max()
            near = np.flatnonzero(((g >= g[:, q].min(axis=1)[:, None] - r) & (g <= g[:, q].max(axis=1)[:, None] + r)).all(axis=0))
            for some in np.array_split(q, max(1, -(-len(q) * len(near) // PAIRS))):
                ring = 0
                for v in g:
                    ring = np.maximum(ring, np.abs(v[some][:, None] - v[near]))
                d = np.where((ring >= least) & (ring <= stop[some][:, None]), _distances(p, some, near), far)
                row, found, rank = _least(d, far, k)
                has = np.bincount(row, minlength=len(some)) > 0
                yield some[has], (np.cumsum(has) - 1)[row], near[found], rank, d[row, found]

    return searched(dealt(celled, cell_tile(-HALO), cell_tile(), cell_tile(HALO)), k, search)
