"""Greedy one-to-one assignment of the items of many report pairs: pairs meet in groups of a block, each with the part of an edge table that it needs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About so many pairs are a group, which is one row; a table of at most so many rows is broadcast.
GROUP, BROADCAST = 1000, 20_000
CHUNK = 48


def shuffled(df: DataFrame) -> DataFrame:
    """df, never broadcast: Spark goes by compressed sizes, and sets of a few MB on disk can be GBs of the driver's memory."""
    return df.hint("merge")


def _members(sets: pa.Array, kinds: np.ndarray) -> np.ndarray:
    """A row a report: which of the sorted kinds it has."""
    sizes = np.nan_to_num(sets.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
    has = np.zeros((len(sets), len(kinds)), bool)
    has[np.repeat(np.arange(len(sets)), sizes), np.searchsorted(kinds, sets.flatten().to_numpy(zero_copy_only=False))] = True
    return has


def _edges(table: pa.Array, *values: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(sorted kinds, their items' ranks, x, y, values): edges between kinds by their places."""
    kinds = table.field("kind").to_numpy()
    place = np.argsort(kinds)
    kinds, items = kinds[place], table.field("item").take(pa.array(place)).to_pylist()
    rank = np.empty(len(items), int)
    rank[sorted(range(len(items)), key=lambda i: "" if items[i] is None else items[i])] = np.arange(len(items))
    lists = table.field("partners")
    at = np.empty(len(place), int)
    at[place] = np.arange(len(place))
    x = np.repeat(at, np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
    flat = lists.flatten()
    ids = flat.field("y").to_numpy(zero_copy_only=False)
    y = np.minimum(np.searchsorted(kinds, ids), len(kinds) - 1)
    here = kinds[y] == ids
    return kinds, rank, x[here], y[here], [flat.field(v).to_numpy(zero_copy_only=False)[here] for v in values]


def _total(x: np.ndarray, y: np.ndarray, worth: np.ndarray, free: np.ndarray) -> float:
    """The greedy sum over edges in order; free: for both sides, all kinds. After each CHUNK, edges of taken ends are dropped at once."""
    total = 0.0
    left, right = free.copy(), free.copy()
    while len(x):
        for i, j, w in zip(x[:CHUNK].tolist(), y[:CHUNK].tolist(), worth[:CHUNK].tolist()):
            if left[i] and right[j]:
                left[i] = right[j] = False
                total += w
        x, y, worth = x[CHUNK:], y[CHUNK:], worth[CHUNK:]
        rest = np.flatnonzero(left[x] & right[y])
        x, y, worth = x[rest], y[rest], worth[rest]
    return total


def _places(pairs: pa.Array, members: pa.Array) -> list[tuple[int, int]]:
    at = {r: i for i, r in enumerate(members.field("report_id").to_pylist())}
    return [(at[a], at[b]) for a, b in zip(pairs.field("a").to_pylist(), pairs.field("b").to_pylist())]


def _rows(batches: Iterator[pa.RecordBatch], fold: Callable) -> Iterator[pa.RecordBatch]:
    """fold(places of pairs, members, table) of every group, after its pairs."""
    for batch in batches:
        for row in range(batch.num_rows):
            pairs, members, table = (batch.column(c)[row].values for c in ("pairs", "members", "table"))
            yield pa.RecordBatch.from_pydict({"a": pairs.field("a"), "b": pairs.field("b")} | fold(_places(pairs, members), members, table))


def _overlaps(places: list[tuple[int, int]], members: pa.Array, table: pa.Array | None) -> dict:
    if table is None:
        return {"total": pa.array([0.0] * len(places)), "n_a": pa.array([0] * len(places), pa.int32()), "n_b": pa.array([0] * len(places), pa.int32())}
    kinds, rank, x, y, (worth, near) = _edges(table, "score", "near")
    order = np.lexsort((rank[y], rank[x], -near, -worth))
    x, y, worth = x[order], y[order], worth[order]
    has, free = _members(members.field("kinds"), kinds), np.ones(len(kinds), bool)
    sizes, total, own = has.sum(1), np.zeros(len(places)), {}
    for n, (i, j) in enumerate(places):
        if i not in own:
            own = {i: np.flatnonzero(has[i][x])}  # pairs come sorted, so that one report's edges suffice
        met = own[i][has[j][y[own[i]]]]
        total[n] = _total(x[met], y[met], worth[met], free)
    sides = (pa.array(sizes[[p[k] for p in places]], pa.int32()) for k in (0, 1))
    return dict(zip(("total", "n_a", "n_b"), (pa.array(total), *sides)))


@lru_cache(1 << 16)
def _alike_axes(p: str, q: str) -> bool:
    """One stands in the other, or Levenshtein's ratio is above .8."""
    if p in q or q in p:
        return True
    longer = max(len(p), len(q))
    if abs(len(p) - len(q)) >= 0.2 * longer:
        return False
    before = list(range(len(q) + 1))
    for i, c in enumerate(p):
        now = [i + 1]
        for j, d in enumerate(q):
            now.append(min(before[j] + (c != d), before[j + 1] + 1, now[j] + 1))
        before = now
    return (longer - before[-1]) / longer > 0.8


def _axes(members: pa.Array, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of a report's sheet in the next two, -1 if it has none; axes of a row's sheet; what is alike one of them; their number)."""
    rows, each = np.full((len(members), len(kinds)), -1), []
    for i, sheets in enumerate(members.field("kinds").to_pylist()):
        for sheet in sheets or ():
            rows[i, np.searchsorted(kinds, sheet["kind"])] = len(each)
            each.append(sheet["axes"] or ())
    words = {w: n for n, w in enumerate(sorted({w for e in each for w in e}))}
    has = np.zeros((len(each), len(words)), bool)
    for n, e in enumerate(each):
        has[n, [words[w] for w in e]] = True
    near = np.array([[_alike_axes(p, q) for q in words] for p in words], bool).reshape(len(words), len(words))
    return rows, has, (has.astype(np.float32) @ near.astype(np.float32)) > 0, has.sum(1)


def _sheets(places: list[tuple[int, int]], members: pa.Array, table: pa.Array | None) -> dict:
    """Of each pair: sheets that match exactly and but for their grain, the best score, how many match exactly one to one. Scores as scoring.axes_score."""
    out = {"exact": np.zeros(len(places), np.int64), "grain": np.zeros(len(places), np.int64), "best": np.zeros(len(places)), "matched": np.zeros(len(places), np.int32)}
    if table is not None:
        kinds, rank, x, y, (near, named, core) = _edges(table, "near", "named", "core")
        order = np.lexsort((rank[y], rank[x], -near))
        x, y, near, named, core = (v[order] for v in (x, y, near, named.astype(bool), core.astype(bool)))
        rows, has, loosely, size = _axes(members, kinds)
        ones, free, own = np.ones(len(x)), np.ones(len(kinds), bool), {}
        for n, (i, j) in enumerate(places):
            if i not in own:
                own = {i: np.flatnonzero(rows[i][x] >= 0)}
            met = own[i][rows[j][y[own[i]]] >= 0]
            v, w = rows[i][x[met]], rows[j][y[met]]
            least = np.minimum(size[v], size[w])
            part = lambda other: np.where(least > 0, (has[v] & other[w]).sum(1) / np.maximum(least, 1), 1.0)  # noqa: B023, E731
            shared = part(has)
            exact = named[met] & ((shared >= 0.7) | (part(loosely) >= 0.7))
            grain = ~exact & core[met] & (shared >= 0.5)
            out["exact"][n], out["grain"][n] = exact.sum(), grain.sum()
            out["best"][n] = max((2 + near[met][exact]).max(initial=0.0), (1 + near[met][grain]).max(initial=0.0))
            out["matched"][n] = _total(x[met][exact], y[met][exact], ones[: exact.sum()], free)
    return {c: pa.array(v) for c, v in out.items()}


def in_groups(pairs: DataFrame) -> DataFrame:
    """(grp, a, b) of pairs(a, b, where): a block's pairs in groups of about GROUP, all pairs of an a in one. Without `where` an a is a group."""
    if "where" not in pairs.columns:
        return pairs.select(F.xxhash64("a").alias("grp"), "a", "b")
    parts = pairs.groupBy("where").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = pairs.join(shuffled(parts), "where")
    return dealt.select(F.xxhash64("where", F.pmod(F.xxhash64("a"), F.col("parts"))).alias("grp"), "a", "b")


def _grouped(pairs: DataFrame, sets: DataFrame, kinds: Callable[[Column], Column], items: DataFrame, edges: DataFrame, fold: Callable, schema: str) -> DataFrame:
    """fold of every group of in_groups' pairs. sets(report_id, kinds); kinds: the numbers in `kinds`; items(kind, item) of all; edges(x, y, values).

    An edge has a row in each group that has its x, not in each pair.
    """
    ends = pairs.select("grp", F.explode(F.array("a", "b")).alias("report_id")).distinct()
    members = ends.join(shuffled(sets), "report_id", "left").groupBy("grp").agg(F.collect_list(F.struct("report_id", "kinds")).alias("members"))
    values = [c for c in edges.columns if c != "x"]
    known = items.join(shuffled(edges.groupBy(F.col("x").alias("kind")).agg(F.collect_list(F.struct(*values)).alias("partners"))), "kind", "left")
    few = all(len(df.select(F.lit(1)).take(BROADCAST + 1)) <= BROADCAST for df in (edges, items))
    held = members.select("grp", F.explode(F.array_distinct(F.flatten(F.filter(F.transform("members", lambda m: kinds(m["kinds"])), lambda k: k.isNotNull())))).alias("kind"))
    tables = held.join(F.broadcast(known) if few else shuffled(known), "kind").groupBy("grp").agg(F.collect_list(F.struct("kind", "item", "partners")).alias("table"))
    dealt = pairs.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("pairs"))
    rows = dealt.join(shuffled(members), "grp").join(shuffled(tables), "grp", "left").select("pairs", "members", "table")
    kind = pairs.schema["a"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _rows(batches, fold), f"a {kind}, b {kind}, {schema}")


def greedy_totals(pairs: DataFrame, sets: DataFrame, items: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, total, n_a, n_b) of in_groups' pairs: sum of scores of a greedy one-to-one assignment, and the sides' sizes.

    sets(report_id, kinds), items(kind, item) of all kinds, edges(x, y, score, near) between kinds. Edges are taken best first, by score, then by
    `near`, then by the items of x and y.
    """
    return _grouped(pairs, sets, lambda k: k, items, edges.select("x", "y", "score", "near"), _overlaps, "total double, n_a int, n_b int")


def sheet_totals(pairs: DataFrame, sheets: DataFrame, names: DataFrame, alike: DataFrame) -> DataFrame:
    """(a, b, exact, grain, best, matched) of in_groups' pairs: see _sheets. sheets(report_id, kind, axes), names(kind, item), alike(x, y, near, named, core)."""
    sets = sheets.groupBy("report_id").agg(F.collect_list(F.struct("kind", "axes")).alias("kinds"))
    return _grouped(pairs, sets, lambda k: k["kind"], names, alike.select("x", "y", "near", "named", "core"), _sheets, "exact long, grain long, best double, matched int")
