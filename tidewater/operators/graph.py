"""Graph message passing over edge-list DataFrames.

Nodes are ``(by..., id, cols...)``, edges ``(by..., src, dst)``. A round
joins every edge with its two end nodes, computes message columns from the
receiving node ``i`` and the sending node ``j``, aggregates them per
receiving node with a partial + final hash aggregate (so a hub node is never
one task), and joins the aggregate back for the update. Callers supply the
message and update as column expressions (no learned weights).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.common import salted_join
from tidewater.operators.ordinal import ordinal, running_sum

# exp of one softmax step stays far from the range of a double
SOFTMAX_STEP = 32.0

AGGS = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}

MessageFn = Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]]
UpdateFn = Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]]


def _ends(nodes: DataFrame, edges: DataFrame, by: list[str], id_col: str, at: str) -> DataFrame:
    other = "src" if at == "dst" else "dst"
    cols = [c for c in nodes.columns if c not in by]
    ni = nodes.select(*by, *[F.col(c).alias(f"i_{c}") for c in cols])
    nj = nodes.select(*by, *[F.col(c).alias(f"j_{c}") for c in cols])
    i, j = f"i_{id_col}", f"j_{id_col}"
    e = edges.select(*by, F.col(at).alias(i), F.col(other).alias(j))
    # a hub's edges are dealt at both ends
    got = salted_join(e, ni, [*by, i], [j])
    return salted_join(got, nj, [*by, j], [i], counted=e)


def propagate(nodes: DataFrame, edges: DataFrame, message: MessageFn, aggr: str, update: UpdateFn,
              by: Sequence[str] = ("cloud",), id_col: str = "point_id", at: str = "dst") -> DataFrame:
    """GR1 / GR2 / GR3: one round. ``message(i, j)`` gets accessors for the
    receiving and the sending node's columns and returns named message
    columns; they are reduced with ``aggr`` at node ``at`` (``dst`` =
    source-to-target flow, ``src`` = target-to-source); ``update(node, agg)``
    returns the new node columns. Nodes without incoming messages see NULL
    aggregates."""
    if aggr not in AGGS:
        raise ValueError(f"aggr must be one of {sorted(AGGS)}")
    by = list(by)
    j = _ends(nodes, edges, by, id_col, at)
    msgs = message(lambda c: F.col(f"i_{c}"), lambda c: F.col(f"j_{c}"))
    m = j.select(*by, F.col(f"i_{id_col}").alias(id_col), *[v.alias(f"m_{k}") for k, v in msgs.items()])
    agg = m.groupBy(*by, id_col).agg(*[AGGS[aggr](f"m_{k}").alias(f"agg_{k}") for k in msgs])
    full = nodes.join(agg, [*by, id_col], "left")
    new = update(lambda c: F.col(c), lambda c: F.col(f"agg_{c}"))
    keep = [c for c in nodes.columns if c not in new]
    return full.select(*keep, *[v.alias(k) for k, v in new.items()])


def hstack_pos(feat: Column | str, pos: Sequence[str] = ("x", "y")) -> Column:
    """GR6: append the position to the feature vector."""
    feat = F.col(feat) if isinstance(feat, str) else feat
    return F.concat(feat, F.array(*[F.col(p).cast("double") for p in pos]))


def gcn_smooth(nodes: DataFrame, edges: DataFrame, value: str, by: Sequence[str] = ("cloud",),
               id_col: str = "point_id", out: str = "smooth") -> DataFrame:
    """GR4: symmetric degree-normalised neighbour sum with self loops:
    out_i = sum_{j in N(i) + i} v_j / sqrt(deg_i deg_j), deg counted on the
    receiving side (edges into i plus the loop)."""
    by = list(by)
    loops = nodes.select(*by, F.col(id_col).alias("src"), F.col(id_col).alias("dst"))
    e = edges.select(*by, "src", "dst").unionByName(loops)
    deg = e.groupBy(*by, "dst").agg(F.count(F.lit(1)).alias("_deg"))
    di = deg.select(*by, F.col("dst"), F.col("_deg").alias("_di"))
    dj = deg.select(*by, F.col("dst").alias("src"), F.col("_deg").alias("_dj"))
    v = nodes.select(*by, F.col(id_col).alias("src"), F.col(value).alias("_v"))
    w = salted_join(e, di, [*by, "dst"], ["src"], weight="_di")
    w = salted_join(w, dj.join(v, [*by, "src"]), [*by, "src"], ["dst"], counted=e)
    s = w.groupBy(*by, "dst").agg(F.sum(F.col("_v") / F.sqrt(F.col("_di") * F.col("_dj"))).alias(out))
    return nodes.join(s.withColumnRenamed("dst", id_col), [*by, id_col], "left")


def attend(nodes: DataFrame, edges: DataFrame, score: MessageFn, value: str, by: Sequence[str] = ("cloud",),
           id_col: str = "point_id", out: str = "att", scale: float = 1.0) -> DataFrame:
    """GR5: softmax over the incoming edges of each node of ``score(i, j) *
    scale``, weighted mean of the sender's ``value``.

    One mergeable aggregate: a score is an integer number of steps and a rest
    below one step, and for each node and number of steps the sums of exp(rest)
    and exp(rest) * value add up in any order, so a hub's edges are summed where
    they lie. The few steps of a node are then weighed against its highest one.
    No edge is joined back to its node's maximum."""
    by = list(by)
    j = _ends(nodes, edges, by, id_col, "dst")
    s = score(lambda c: F.col(f"i_{c}"), lambda c: F.col(f"j_{c}"))["score"] * F.lit(float(scale))
    sc = j.select(*by, F.col(f"i_{id_col}").alias(id_col), s.alias("_s"), F.col(f"j_{value}").alias("_v"))
    sc = sc.withColumn("_step", F.floor(F.col("_s") / SOFTMAX_STEP)).withColumn("_e", F.exp(F.col("_s") - F.col("_step") * SOFTMAX_STEP))
    steps = sc.groupBy(*by, id_col, "_step").agg(F.sum("_e").alias("_z"), F.sum(F.col("_e") * F.col("_v")).alias("_zv"))
    per_node = steps.groupBy(*by, id_col).agg(F.max("_step").alias("_top"), F.collect_list(F.struct("_step", "_z", "_zv")).alias("_parts"))
    total = lambda what: F.aggregate("_parts", F.lit(0.0), lambda t, p: t + p[what] * F.exp(
        (p["_step"] - F.col("_top")) * SOFTMAX_STEP))
    agg = per_node.select(*by, id_col, (total("_zv") / total("_z")).alias(out))
    return nodes.join(agg, [*by, id_col], "left")


def batch_graphs(nodes: DataFrame, edges: DataFrame, graph: str = "cloud", id_col: str = "point_id"):
    """SET7: disjoint union of many graphs: local id = position of the node in
    its graph (by id), global id = local + node offset of the graph (running
    sum of node counts in graph order). Returns (nodes with local_id and
    global_id, edges with global src/dst)."""
    local = ordinal(nodes.select(graph, id_col), [graph], [id_col], out="local_id") \
        .withColumn("local_id", F.col("local_id") - 1)
    counts = nodes.groupBy(graph).agg(F.count(F.lit(1)).cast("bigint").alias("_n"))
    # offset = node count of all earlier graphs: a distributed running sum over
    # the per-graph table (one row per graph), never a single-partition window
    offset = running_sum(counts, [], [graph], "_n", out="_end")
    offset = offset.select(graph, (F.col("_end") - F.col("_n")).cast("bigint").alias("_off"))
    n = local.join(offset, graph).withColumn("global_id", (F.col("_off") + F.col("local_id")).cast("bigint"))
    n = n.drop("_off")
    gid = n.select(graph, id_col, "global_id")
    e = (edges.join(gid.withColumnRenamed(id_col, "src").withColumnRenamed("global_id", "src_global"), [graph, "src"])
              .join(gid.withColumnRenamed(id_col, "dst").withColumnRenamed("global_id", "dst_global"), [graph, "dst"]))
    return n, e


def split_graphs(global_edges: DataFrame, global_nodes: DataFrame, graph: str = "cloud") -> DataFrame:
    """SET7 inverse: local ids back from global ids via the node table."""
    m = global_nodes.select(graph, "global_id", "local_id")
    e = (global_edges.join(m.withColumnRenamed("global_id", "src_global").withColumnRenamed("local_id", "src_local"),
                           [graph, "src_global"])
                     .join(m.withColumnRenamed("global_id", "dst_global").withColumnRenamed("local_id", "dst_local"),
                           [graph, "dst_global"]))
    return e


def normalised_adjacency(edges: DataFrame, by: Sequence[str] = ("cloud",)) -> DataFrame:
    """SET8: undirected closure (edges plus reversed, distinct) with weights
    1 / degree of the row node, so each row sums to 1. Degree comes from a
    grouped count joined back."""
    by = list(by)
    und = edges.select(*by, "src", "dst").unionByName(
        edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    deg = und.groupBy(*by, "src").agg(F.count(F.lit(1)).alias("_deg"))
    return salted_join(und, deg, [*by, "src"], ["dst"], weight="_deg").withColumn("w", F.lit(1.0) / F.col("_deg")).drop("_deg")


def graph_rollout(nodes: DataFrame, edges: DataFrame, message: MessageFn, aggr: str, update: UpdateFn,
                  steps: int, by: Sequence[str] = ("cloud",), id_col: str = "point_id", at: str = "dst",
                  checkpoint_every: int = 1) -> DataFrame:
    """FC4: ``steps`` rounds of :func:`propagate` with fixed positions and
    edges. Node state is checkpointed (reliable, shared folder) every
    ``checkpoint_every`` rounds so the plan stays linear and a lost executor
    recomputes from the last checkpoint only."""
    cur = nodes
    for i in range(1, steps + 1):
        cur = propagate(cur, edges, message, aggr, update, by, id_col, at)
        if checkpoint_every and i % checkpoint_every == 0 and i < steps:
            cur = cur.checkpoint(eager=True)
    return cur
