"""Quadtree of counts over point clouds, and searches that descend it.

Every cloud gets a tree of square cells, each a 4 x 4 split of the one above. A
node holds how many points it has, their lowest id and their tight bounding box,
so distance bounds are exact doubles of point coordinates. The tree is as deep as the points
need: a cell with more than ``capacity`` points that are not all at one place is
split again, down to the resolution of a double. A base level with a few points
a cell comes from one aggregate; cells above it add those up, and only the
points of crowded cells are read again for the levels below.

A search does not descend once for each query. Queries are grouped by the cells
of the level reached, a group holds the nodes that any of its queries may still
need, and each round opens those nodes one level while the groups fall apart
into smaller ones. Groups and nodes have the same size in a round, so a group
keeps a bounded number of nodes wherever it lies, also beside a cluster many
orders of magnitude denser than itself, and the work of all rounds is about that
of the last. Each round is a written table. A group is done when it has nothing
left to open; only then are its queries looked at one by one.

Rows with a null or NaN position take part in nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.common import materialize, salted_join

#: Bits of a cell coordinate at the finest level: what a double can tell apart.
BITS = 50
#: Levels between a node and its children (4 x 4 of them).
STEP = 2
#: Deepest level that a search may start from: 256 cells a cloud.
START = 4

_NODE = ["_lvl", "_cx", "_cy", "_n", "_least", "_inner", "_x0", "_x1", "_y0", "_y1"]
_KEY = ["_lvl", "_cx", "_cy"]


def _shift(col: str, by: str) -> Column:
    return F.expr(f"shiftright({col}, CAST({by} AS INT))")


def _cells(df: DataFrame, level: Column) -> DataFrame:
    """The cell of each row at a level, from its finest coordinates."""
    return df.withColumn("_lvl", level.cast("int")).withColumn("_cx", _shift("_ix", f"{BITS} - _lvl")).withColumn(
        "_cy", _shift("_iy", f"{BITS} - _lvl"))


def _boxes(lo_x: str = "_x0", hi_x: str = "_x1", lo_y: str = "_y0", hi_y: str = "_y1") -> list[Column]:
    return [F.min(lo_x).alias("_x0"), F.max(hi_x).alias("_x1"), F.min(lo_y).alias("_y0"), F.max(hi_y).alias("_y1")]


@dataclass(frozen=True)
class Quadtree:
    """``stats``: a row for each cloud; ``kids``: the children of every inner
    node (and the nodes to start from, under level -1); ``leaves``: the points,
    each with its cell on every level where it was counted from points; ``levels``:
    rounds that reach every leaf."""

    by: list[str]
    periodic: bool
    stats: DataFrame
    kids: DataFrame
    leaves: DataFrame
    levels: int


def _place(df: DataFrame, stats: DataFrame, by: list[str], x: str, y: str, weight: str | None) -> DataFrame:
    """Finest cell coordinates of each row; a row outside its cloud's box gets
    those of the nearest cell."""
    top = F.lit((1 << BITS) - 1)
    at = lambda c, o: F.least(F.greatest(F.floor((F.col(c) - F.col(o)) / F.col("_ext") * float(1 << BITS)), F.lit(0)), top)
    ok = df.where(~(F.isnan(x) | F.isnan(y)) & F.col(x).isNotNull() & F.col(y).isNotNull())
    j = salted_join(ok, stats, by, [x, y], weight=weight)
    return j.withColumn("_ix", at(x, "_ox")).withColumn("_iy", at(y, "_oy"))


def build(points: DataFrame, by: Sequence[str], pid: str, x: str, y: str, capacity: int, keep: int,
          periodic: bool = False) -> Quadtree:
    """The tree of ``points``. Where more than ``capacity`` points lie at one
    place, that place keeps its ``keep`` lowest ids in ``leaves`` (no search for
    ``keep`` points can return others)."""
    by = list(by)
    pos = points.select(*by, F.col(pid).alias("_nid"), F.col(x).cast("double").alias("_nx"), F.col(y).cast("double").alias("_ny"))
    pos = pos.where(~(F.isnan("_nx") | F.isnan("_ny")) & F.col("_nx").isNotNull() & F.col("_ny").isNotNull())
    s = pos.groupBy(*by).agg(F.min("_nx").alias("_ox"), F.max("_nx").alias("_mx"), F.min("_ny").alias("_oy"), F.max("_ny").alias("_my"),
                             F.count(F.lit(1)).alias("_rows"))
    extent = F.greatest(F.col("_mx") - F.col("_ox"), F.col("_my") - F.col("_oy"))
    # cells of the base level hold between an eighth and half of the capacity on average
    base = F.greatest(F.ceil(F.log2(F.col("_rows") * 2.0 / capacity) / 2), F.lit(0)).cast("int")
    one = F.lit(1.0 if periodic else 0.0)
    stats = materialize(s.select(
        *by, "_rows", base.alias("_base"), (F.lit(0.0) if periodic else F.col("_ox")).alias("_ox"),
        (F.lit(0.0) if periodic else F.col("_oy")).alias("_oy"),
        F.when(one > 0, one).when(extent > 0, extent).otherwise(F.lit(1.0)).alias("_ext")), "quadtree-clouds")
    # the level that searches start from
    stats = stats.withColumn("_first", F.when(F.col("_base") <= START, F.col("_base")).otherwise(START - F.pmod(F.lit(START) - F.col("_base"), F.lit(STEP))))

    placed = _place(pos, stats, by, "_nx", "_ny", "_rows")
    pending = materialize(placed.select(*by, "_nid", "_nx", "_ny", "_ix", "_iy", "_base"), "quadtree-points")
    counted, leaves, depth = [], [], 0
    while True:
        here = _cells(pending, F.col("_base") + STEP * depth)
        cells = here.groupBy(*by, *_KEY).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_nid").alias("_least"), *_boxes("_nx", "_nx", "_ny", "_ny"))
        spread = (F.col("_x0") < F.col("_x1")) | (F.col("_y0") < F.col("_y1"))
        crowded = F.col("_n") > capacity
        inner = crowded & spread & (F.col("_lvl") + STEP <= BITS)
        cells = materialize(cells.withColumn("_inner", inner).withColumn("_pile", crowded & ~inner), "quadtree-cells")
        seen = cells.agg(F.max("_inner").alias("inner"), F.max("_pile").alias("pile")).first()
        if seen["pile"]:
            here = _thin_piles(here, cells.where("_pile").select(*by, *_KEY), by, keep)
        leaves.append(here.select(*by, *_KEY, "_nid", "_nx", "_ny"))
        counted.append(cells)
        if not seen["inner"]:
            break
        pending = materialize(here.join(cells.where("_inner").select(*by, *_KEY), [*by, *_KEY], "left_semi").select(
            *by, "_nid", "_nx", "_ny", "_ix", "_iy", "_base"), "quadtree-points")
        depth += 1
    nodes = counted[0].select(*by, *_NODE)
    for c in counted[1:]:
        nodes = nodes.unionByName(c.select(*by, *_NODE))
    nodes = nodes.unionByName(_above(counted[0], stats, by))
    first = stats.select(*by, "_first")
    kids = nodes.join(first, by).where(F.col("_lvl") >= F.col("_first"))
    start = F.col("_lvl") == F.col("_first")
    kids = kids.groupBy(
        *by, F.when(start, -1).otherwise(F.col("_lvl") - STEP).alias("_lvl"),
        F.when(start, 0).otherwise(F.shiftright("_cx", STEP)).alias("_cx"),
        F.when(start, 0).otherwise(F.shiftright("_cy", STEP)).alias("_cy")).agg(
        F.collect_list(F.struct(*[F.col(c).alias(c[1:]) for c in _NODE])).alias("_kids"))
    kids = materialize(kids, "quadtree-kids")
    top = stats.agg(F.max(F.col("_base") - F.col("_first")).alias("d")).first()["d"] or 0
    all_leaves = leaves[0]
    for part in leaves[1:]:
        all_leaves = all_leaves.unionByName(part)
    return Quadtree(by, periodic, stats, kids, all_leaves, top // STEP + depth + 1)


def _thin_piles(here: DataFrame, piles: DataFrame, by: list[str], keep: int) -> DataFrame:
    from tidewater.operators.neighbours import lowest_ids
    key = [*by, *_KEY]
    thin = lowest_ids(here.join(piles, key, "left_semi"), keep, [*key, "_nx", "_ny"], "_nid")
    return here.join(piles, key, "left_anti").unionByName(thin)


def _above(cells: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """The nodes above the base level, each from the cells under it."""
    up = cells.join(stats.select(*by, "_base", "_first"), by).where("_base > _first")
    up = up.withColumn("_up", F.explode(F.expr(f"sequence({STEP}, _base - _first, {STEP})")))
    up = up.select(*by, (F.col("_lvl") - F.col("_up")).cast("int").alias("_lvl"), _shift("_cx", "_up").alias("_cx"),
                   _shift("_cy", "_up").alias("_cy"), "_n", "_least", "_x0", "_x1", "_y0", "_y1")
    return up.groupBy(*by, *_KEY).agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"), *_boxes()).withColumn("_inner", F.lit(True)).select(*by, *_NODE)


# ---- distances between boxes


def _axis(a0: Column, a1: Column, b0: Column, b1: Column, periodic: bool) -> tuple[Column, Column]:
    """The least and a greatest distance of two intervals on one axis."""
    def between(shift: float) -> tuple[Column, Column]:
        c0, c1 = b0 + F.lit(shift), b1 + F.lit(shift)
        return F.greatest(c0 - a1, a0 - c1, F.lit(0.0)), F.greatest(c1 - a0, a1 - c0)
    if not periodic:
        return F.greatest(b0 - a1, a0 - b1, F.lit(0.0)), F.greatest(b1 - a0, a1 - b0)
    pairs = [between(s) for s in (-1.0, 0.0, 1.0)]
    return F.least(*[p[0] for p in pairs]), F.least(F.lit(0.5), *[p[1] for p in pairs])


#: Box of a group and of one query, as columns x0, x1, y0, y1.
GROUP = ("_bx0", "_bx1", "_by0", "_by1")
POINT = ("_qx", "_qx", "_qy", "_qy")


def with_distances(nodes: Column, box: Sequence[str], periodic: bool) -> Column:
    """The nodes of an array, each with ``lo`` and ``hi``: squared distances
    between which every point of it lies from every point of the box."""
    x0, x1, y0, y1 = (F.col(c) for c in box)

    def one(n: Column) -> Column:
        lx, hx = _axis(x0, x1, n["x0"], n["x1"], periodic)
        ly, hy = _axis(y0, y1, n["y0"], n["y1"], periodic)
        return n.withField("lo", lx * lx + ly * ly).withField("hi", hx * hx + hy * hy)
    return F.transform(nodes, one)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, also where ``then`` uses
    it for every element of an array."""
    return F.element_at(F.transform(F.array(value), then), 1)


Prune = Callable[[DataFrame, Sequence[str]], DataFrame]


def descend(tree: Quadtree, queries: DataFrame, prune: Prune, name: str) -> DataFrame:
    """Every query with the nodes it needs: by..., the queries' columns and
    ``_cand``, an array of nodes with ``open`` false.

    ``queries`` has by..., ``_qid``, ``_qx`` and ``_qy``. ``prune(df, box)``
    replaces the array ``_cand`` of nodes by those that a query in the box may
    need, each with ``open``: whether its children must be looked at."""
    by = tree.by
    q = _place(queries, tree.stats, by, "_qx", "_qy", "_rows")
    q = materialize(q.select(*queries.columns, "_ix", "_iy", "_first"), f"{name}-queries")
    kids = tree.kids
    cell = [*by, "_gx", "_gy"]

    def groups(level: int) -> DataFrame:
        at = _cells(q, F.col("_first") + STEP * level)
        return at.groupBy(*by, F.col("_cx").alias("_gx"), F.col("_cy").alias("_gy")).agg(
            F.min("_qx").alias("_bx0"), F.max("_qx").alias("_bx1"), F.min("_qy").alias("_by0"), F.max("_qy").alias("_by1"))

    state = groups(0).join(kids.where("_lvl = -1").select(*by, F.col("_kids").alias("_cand")), by)
    done = []
    for level in range(tree.levels):
        last = level + 1 == tree.levels
        state = prune(state, GROUP).select(*cell, "_cand")
        more = F.exists("_cand", lambda n: n["open"])
        if not last:
            state = materialize(state, f"{name}-groups")
        at = _cells(q, F.col("_first") + STEP * level).withColumnsRenamed({"_cx": "_gx", "_cy": "_gy"})
        done.append(at.join(state if last else state.where(~more), cell).select(*queries.columns, "_cand"))
        if last:
            break
        opened = state.where(more).select(*cell, F.explode("_cand").alias("_c")).select(
            *cell, "_c", F.when(F.col("_c.open"), F.col("_c.lvl")).alias("_lvl"), F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
        opened = opened.join(kids, [*by, *_KEY], "left")
        plain = F.struct(*[F.col(f"_c.{c[1:]}").alias(c[1:]) for c in _NODE])
        nodes = opened.select(*cell, F.coalesce("_kids", F.array(plain)).alias("_nodes")).groupBy(*cell).agg(
            F.flatten(F.collect_list("_nodes")).alias("_cand"))
        nodes = nodes.select(*by, F.col("_gx").alias("_px"), F.col("_gy").alias("_py"), "_cand")
        below = groups(level + 1).withColumn("_px", F.shiftright("_gx", STEP)).withColumn("_py", F.shiftright("_gy", STEP))
        state = below.join(nodes, [*by, "_px", "_py"])
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def within_kth(need: int, periodic: bool) -> Prune:
    """Keeps the nodes that can hold one of the ``need`` nearest points. The
    counts of the nearest nodes bound that distance: it is the least ``hi`` up to
    which whole nodes hold ``need`` points."""
    def bound(nodes: Column) -> Column:
        by_hi = F.array_sort(F.transform(nodes, lambda n: F.struct(n["hi"].alias("hi"), n["n"].alias("n"))))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(float("inf")).alias("hi"))
        return F.aggregate(by_hi, start, lambda s, v: F.when(s["n"] >= need, s).otherwise(
            F.struct((s["n"] + v["n"]).alias("n"), F.when(s["n"] + v["n"] >= need, v["hi"]).otherwise(F.lit(float("inf"))).alias("hi"))))

    def prune(df: DataFrame, box: Sequence[str]) -> DataFrame:
        kept = _let(with_distances(F.col("_cand"), box, periodic), lambda c: _let(
            bound(c)["hi"] * (1 + 1e-12), lambda hi: F.filter(c, lambda n: n["lo"] <= hi)))
        return df.withColumn("_cand", F.transform(kept, lambda n: n.dropFields("lo", "hi").withField("open", n["inner"])))
    return prune


def lowest_in_balls(scales: Sequence[tuple[float, int]]) -> Prune:
    """Keeps the nodes that can hold one of the lowest ids inside a ball of one
    of the (radius, number of ids) scales. Every node that lies inside for sure
    puts its lowest id forward; a node whose own lowest id is above the wanted
    number of those has nothing to add, wherever it lies."""
    def prune(df: DataFrame, box: Sequence[str]) -> DataFrame:
        def of_scale(radius: float, n: int) -> Callable[[Column], Column]:
            r2 = float(radius) ** 2

            def kept(c: Column) -> Column:
                sure = F.array_sort(F.transform(F.filter(c, lambda v: v["hi"] <= r2), lambda v: v["least"]))
                return _let(F.struct(F.get(sure, F.lit(n - 1)).alias("id")), lambda b: F.filter(
                    c, lambda v: (v["lo"] <= r2) & (b["id"].isNull() | (v["least"] <= b["id"]))))
            return kept

        near = with_distances(F.col("_cand"), box, False)
        kept = _let(near, lambda c: F.array_distinct(F.concat(*[of_scale(r, n)(c) for r, n in scales])))
        return df.withColumn("_cand", F.transform(kept, lambda n: n.dropFields("lo", "hi").withField("open", n["inner"])))
    return prune


def candidates(tree: Quadtree, queries: DataFrame, prune: Prune, name: str) -> DataFrame:
    """(by..., queries' columns, _nid, _nx, _ny): for every query the points of
    the leaves that ``prune`` leaves it."""
    found = prune(descend(tree, queries, prune, name), POINT)
    cells = found.select(*queries.columns, F.explode("_cand").alias("_c")).select(
        *queries.columns, F.col("_c.lvl").alias("_lvl"), F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
    return cells.join(tree.leaves, [*tree.by, *_KEY]).drop(*_KEY)
