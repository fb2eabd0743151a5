"""The fixtures of ``sources/fixtures.py`` written independently in DuckDB SQL.

Each entry is one CTE body. ``with_ctes(names, select)`` prepends the CTEs a
query needs (dependencies first). These strings are the oracle side of the
correctness check; the Spark side never uses them.
"""
from __future__ import annotations

from ..sources.fixtures import PATTERN_NAMES

H = "CAST(('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8)) AS BIGINT)"


def h(expr: str) -> str:
    return H.format(expr)


def h60(expr: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 15)) AS BIGINT)"


CTE: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def _add(name: str, body: str, deps: list[str] | None = None) -> None:
    CTE[name] = body
    DEPS[name] = deps or []


# F1 -------------------------------------------------------------------------
_add("f1_bad", """
  SELECT DISTINCT l_suppkey AS wafer_id, CAST(l_partkey % 24 AS INTEGER) AS r,
         CAST(l_orderkey % 24 AS INTEGER) AS c
  FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45""")
_add("cells", """
  SELECT CAST(s.wafer_id AS BIGINT) AS wafer_id, g.r, g.c,
         CAST(CASE WHEN (g.r - 11.5) * (g.r - 11.5) + (g.c - 11.5) * (g.c - 11.5) <= 144
                   THEN CASE WHEN b.wafer_id IS NULL THEN 1 ELSE 2 END ELSE 0 END AS INTEGER) AS cell
  FROM (SELECT DISTINCT l_suppkey AS wafer_id FROM lineitem) s
  CROSS JOIN (SELECT CAST(a.range AS INTEGER) AS r, CAST(b.range AS INTEGER) AS c
              FROM range(24) a, range(24) b) g
  LEFT JOIN f1_bad b ON b.wafer_id = s.wafer_id AND b.r = g.r AND b.c = g.c""", ["f1_bad"])
_add("wafers", """
  SELECT wafer_id, 'lot' || CAST(wafer_id % 10 AS VARCHAR) AS lot_name,
         CAST(wafer_id // 10 AS INTEGER) AS wafer_index, 24 AS rows, 24 AS cols,
         count(*) FILTER (WHERE cell <> 0) AS n_die, count(*) FILTER (WHERE cell = 2) AS n_bad
  FROM cells GROUP BY wafer_id""", ["cells"])
_add("rcells", """
  SELECT wafer_id, r, c, cell FROM cells
  WHERE r < 20 + wafer_id % 5 AND c < 20 + wafer_id % 3""", ["cells"])
_add("rwafers", """
  SELECT wafer_id, CAST(20 + wafer_id % 5 AS INTEGER) AS rows, CAST(20 + wafer_id % 3 AS INTEGER) AS cols,
         count(*) FILTER (WHERE cell <> 0) AS n_die, count(*) FILTER (WHERE cell = 2) AS n_bad
  FROM rcells GROUP BY wafer_id""", ["rcells"])

# F2 -------------------------------------------------------------------------
_add("slong", f"""
  SELECT e.vec_id AS unit_id, CAST(e.label = 0 AS INTEGER) AS y,
         TIMESTAMP '2024-01-01 00:00:00' + e.vec_id * INTERVAL 1 HOUR AS ts,
         CAST(t.i AS INTEGER) AS i,
         CASE WHEN {h("CAST(e.vec_id AS VARCHAR) || ':' || CAST(t.i AS VARCHAR)")} % 100
                   < (CASE WHEN t.i % 16 = 7 THEN 60 WHEN t.i % 8 = 3 THEN 20 ELSE 4 END) THEN NULL
              WHEN t.i % 32 = 31 THEN CAST(1.0 AS DOUBLE)
              ELSE CAST(e.embedding[t.i + 1] AS DOUBLE) END AS v
  FROM embeddings e CROSS JOIN range(64) AS t(i)""")
_add("units", "SELECT DISTINCT unit_id, y, ts FROM slong", ["slong"])

_add("dense", """
  SELECT vec_id AS unit_id, CAST(label = 0 AS INTEGER) AS y,
         list_transform(embedding[1:64], lambda v: CAST(v AS DOUBLE)) AS x
  FROM embeddings""")

# F3 -------------------------------------------------------------------------
_add("scored", f"""
  SELECT event_id AS id, CAST(event_type = 'error' AS INTEGER) AS y,
         CAST({h("event_id")} % 71 + 29 * CAST(event_type = 'error' AS INTEGER) AS DOUBLE) / 100.0 AS score
  FROM events""")

# F4 -------------------------------------------------------------------------
_add("mc_long", """
  SELECT e.vec_id AS id, CAST(e.label AS INTEGER) AS y, CAST(t.k AS INTEGER) AS k,
         list_sum(list_transform(range(t.k + 1, len(e.embedding) + 1, 10), lambda j: CAST(e.embedding[j] AS DOUBLE))) + CASE WHEN t.k = e.label THEN 0.15 ELSE 0.0 END AS z
  FROM embeddings e CROSS JOIN range(10) AS t(k)""")
_add("mc_prob", """
  SELECT id, y, k, z, ez / sum(ez) OVER (PARTITION BY id) AS p
  FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY id)) AS ez FROM mc_long)""", ["mc_long"])
_add("mc_pred", """
  SELECT id, y, min(k) FILTER (WHERE z = mz) AS pred, max(p) AS conf
  FROM (SELECT *, max(z) OVER (PARTITION BY id) AS mz FROM mc_prob) GROUP BY id, y""", ["mc_prob"])

# F5 -------------------------------------------------------------------------
_add("timeline", "SELECT ts, CAST(event_type = 'error' AS INTEGER) AS fail, value FROM events")
_add("timeline_b", "SELECT * FROM timeline WHERE dayofmonth(ts) % 7 <> 3", ["timeline"])

# F6 -------------------------------------------------------------------------
_add("labels6", f"""
  SELECT c_custkey AS wafer_id,
         CASE WHEN c_custkey % 11 = 0 THEN 'Unlabeled'
              WHEN c_custkey % 11 = 1 THEN 'Unlabeled'
              WHEN c_custkey % 11 = 2 THEN 'Unlabeled'
              ELSE CASE WHEN {h("c_custkey")} % 12 < 8
                        THEN ({PATTERN_NAMES})
                             [CAST({h("c_custkey")} % 12 AS INTEGER) + 1]
                        ELSE 'none' END END AS label
  FROM customer""")

# F7 -------------------------------------------------------------------------
_add("areas", """
  SELECT p_partkey AS part_id, CAST(p_size AS DOUBLE) AS area,
         0.5 + CAST(p_partkey % 50 AS DOUBLE) / 100.0 AS target
  FROM part""")

# F8 -------------------------------------------------------------------------
_add("requests", """
  SELECT event_id AS request_id,
    CASE WHEN k % 7 = 0 THEN '{}'
         WHEN k % 6 = 0 THEN '{"area":' || CAST(k AS VARCHAR) || '}'
         WHEN k % 6 = 1 THEN '{"target_yield":0.9}'
         WHEN k % 6 = 2 THEN '{"wafer_map":[[0,1],[1,2]]}'
         WHEN k % 6 = 3 AND k >= 50 THEN '{"features":[' || repeat('1,', 119) || '1]}'
         WHEN k % 6 = 3 THEN '{"features":[1,2,3]}'
         WHEN k % 6 = 4 THEN '{"domain":"yield_curve","area":4}'
         ELSE '{"wafer_map":[0,1],"target_yield":0.8}' END AS payload
  FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in out:
            out.append(n)
    for n in names:
        visit(n)
    return out


def with_ctes(names: list[str], select: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <fixture CTEs>, <extra CTEs> <select>``."""
    parts = [f"{n} AS ({CTE[n]})" for n in _order(names)]
    parts += [f"{n} AS ({body})" for n, body in (extra or [])]
    return ("WITH " + ",\n".join(parts) + "\n" + select) if parts else select


def neighbour_mi_sql(src: str, row: str, k: int = 3) -> list[tuple[str, str]]:
    """CTEs up to ``mi`` (i, mutual_info) by comparing all pairs of rows of ``src`` (i, y, v; key ``row``), with
    psi from harmonic sums: an independent form of ``operators.mutual_info``."""
    return [
        ("psi", """SELECT range AS n, -0.5772156649015329 + sum(CASE WHEN range > 1 THEN 1.0 / (range - 1) ELSE 0.0 END)
                   OVER (ORDER BY range) AS p FROM range(1, (SELECT count(*) + 2 FROM units))"""),
        ("mi_rows", f"""SELECT * FROM (SELECT i, y, v, {row} AS r, count(*) OVER (PARTITION BY i, y) AS n_c FROM {src})
                        WHERE n_c > 1"""),
        ("mi_kth", f"""SELECT i, r, v, n_c, least({k}, n_c - 1) AS k_c, list_sort(nearest)[least({k}, n_c - 1)] AS near
                       FROM (SELECT a.i, a.y, a.r, a.v, a.n_c, min({{'d': abs(b.v - a.v), 'x': b.v}}, {k}) AS nearest
                             FROM mi_rows a JOIN mi_rows b ON a.i = b.i AND a.y = b.y AND a.r <> b.r
                             GROUP BY a.i, a.y, a.r, a.v, a.n_c)"""),
        ("mi_m", """SELECT a.i, a.r, a.n_c, a.k_c, count(*) AS m FROM mi_kth a JOIN mi_rows b ON a.i = b.i
                    AND CASE WHEN a.near.d = 0 THEN b.v = a.v
                             ELSE b.v < CASE WHEN a.near.x >= a.v THEN a.near.x ELSE a.v + a.near.d END
                              AND b.v > CASE WHEN a.near.x <= a.v THEN a.near.x ELSE a.v - a.near.d END END
                    GROUP BY a.i, a.r, a.n_c, a.k_c"""),
        ("mi", """SELECT i, greatest(0.0, any_value(pn.p) + avg(pk.p) - avg(pc.p) - avg(pm.p)) AS mutual_info
                  FROM (SELECT *, count(*) OVER (PARTITION BY i) AS n FROM mi_m) a
                  JOIN psi pn ON pn.n = a.n JOIN psi pk ON pk.n = a.k_c JOIN psi pc ON pc.n = a.n_c JOIN psi pm ON pm.n = a.m
                  GROUP BY i""")]
