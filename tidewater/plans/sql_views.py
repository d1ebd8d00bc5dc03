"""SQL text of the derived views, for the DuckDB oracle queries.

DuckDB indexes lists from 1, so ``embedding[1]`` here is ``embedding[0]`` in
Spark. Integer results are cast to BIGINT on both sides.
"""

from __future__ import annotations

V_RUNS = """
SELECT p_brand AS model, CASE WHEN l_linestatus = 'F' THEN 'grid' ELSE 'cloud' END AS domain,
       p_type AS equation, l_returnflag AS resolution,
       CAST(SUM(CAST(l_discount AS DECIMAL(15,2))) AS DOUBLE) * 40 / COUNT(*) AS loss1,
       CAST(SUM(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) / COUNT(*) / 12 AS loss16,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS test_time,
       CAST(COUNT(*) AS BIGINT) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2, 3, 4
"""

# Cells whose value the wide-log query blanks, by key alone.
GAP = "model LIKE '%5' AND equation = 'PROMO' AND domain = 'cloud'"

V_FRAMES = """
SELECT user_id AS traj, event_type AS kind, value, event_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS step
FROM events
"""

V_POINTS = """
SELECT label AS cloud, vec_id AS point_id,
       (CAST(embedding[1] AS DOUBLE) + 1) / 2 AS x, (CAST(embedding[2] AS DOUBLE) + 1) / 2 AS y,
       CAST(embedding[3] AS DOUBLE) AS f1, CAST(embedding[4] AS DOUBLE) AS f2
FROM embeddings
"""

V_GRID = """
SELECT l_returnflag AS sample_id, CAST(l_partkey % 15 AS INT) AS gx, CAST(l_suppkey % 15 AS INT) AS gy,
       CAST(SUM(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) / COUNT(*) AS value
FROM lineitem GROUP BY 1, 2, 3
"""

V_LOG = """
SELECT CAST(o_custkey % 50 AS INT) AS run, YEAR(o_orderdate) - 1994 AS epoch, o_orderkey AS seq,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS val_loss,
       o_totalprice / 1000 AS train_step_ms
FROM orders
"""

VIEWS = {"v_runs": V_RUNS, "v_frames": V_FRAMES, "v_points": V_POINTS,
         "v_grid": V_GRID, "v_log": V_LOG}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with a WITH clause defining the named views (in order)
    and any extra CTEs given as name -> SQL (in insertion order)."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
