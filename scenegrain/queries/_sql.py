"""Common table expressions by which another engine checks the queries, and the registry of both."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from scenegrain.types import Thresholds

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one module, each with the SQL that gives the same rows, where there is one."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return put


OBJECTS = """objects AS (
SELECT image_id, image_id % 9 AS grp, idx, label, x1, y1, x1 + w AS x2, y1 + h AS y2, x1 + w / 2 AS cx, y1 + h / 2 AS cy, depth
 FROM (SELECT l_orderkey AS image_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INT) AS idx, CASE l_partkey % 6 WHEN 0 THEN 'book' WHEN 1 THEN 'bottle' WHEN 2 THEN 'box' WHEN 3 THEN 'cube' WHEN 4 THEN 'human' ELSE 'remote' END AS label, (l_partkey % 80) / CAST(100 AS DOUBLE) AS x1, (c % 70) / CAST(100 AS DOUBLE) AS y1, (5 + l_partkey % 16) / CAST(100 AS DOUBLE) AS w, (5 + (c % 7919) % 26) / CAST(100 AS DOUBLE) AS h, ((c % 6007) % 101) / CAST(100 AS DOUBLE) AS depth
 FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem) l) o)"""
CONTACT = """contact AS (
SELECT a.image_id, a.idx AS i, b.idx AS j, greatest(0::DOUBLE, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / (a.x2 - a.x1) AS frac
 FROM objects a JOIN objects b ON a.image_id = b.image_id AND a.idx <> b.idx
 WHERE b.y1 <= a.y2 + 0.01::DOUBLE AND a.y2 < b.y2 AND greatest(0::DOUBLE, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / (a.x2 - a.x1) >= 0.05::DOUBLE)"""
GOLD = """gold AS (
SELECT a.image_id, a.grp, a.idx AS subj, b.idx AS obj, CASE (a.image_id + a.idx + b.idx) % 3 WHEN 0 THEN CASE WHEN a.cx < b.cx THEN 'to the left of' ELSE 'to the right of' END WHEN 1 THEN CASE WHEN (a.depth < b.depth) = (a.grp NOT IN (6, 8)) THEN 'in front of' ELSE 'behind' END ELSE CASE WHEN a.cy < b.cy AND abs(a.depth - b.depth) < 0.2::DOUBLE THEN 'on' ELSE 'near' END END AS predicate
 FROM objects a JOIN objects b ON a.image_id = b.image_id AND a.idx <> b.idx
 WHERE (a.image_id * 31 + a.idx * 7 + b.idx * 13) % 10 = 0)"""
FRAMES = """frames AS (
SELECT user_id AS clip, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS ord, ts, event_type AS label, (event_id * 37 % 80) / 100::DOUBLE AS x1, value FROM events)"""
PAIRS = """pairs AS (
SELECT a.image_id, a.grp, a.idx AS subj, b.idx AS obj, a.label AS la, b.label AS lb, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, a.cx AS acx, a.cy AS acy, a.depth AS az, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, b.cx AS bcx, b.cy AS bcy, b.depth AS bz
 FROM objects a JOIN objects b ON a.image_id = b.image_id AND a.idx <> b.idx)"""

OVERLAP = "(greatest(0::DOUBLE, least(ax2, bx2) - greatest(ax1, bx1)) / greatest(1e-9::DOUBLE, least(ax2 - ax1, bx2 - bx1)))"
GX, GY = "greatest(0::DOUBLE, greatest(ax1, bx1) - least(ax2, bx2))", "greatest(0::DOUBLE, greatest(ay1, by1) - least(ay2, by2))"
GAP_REL = f"(sqrt({GX} * {GX} + {GY} * {GY}) / ((sqrt(greatest(1e-9::DOUBLE, (ax2 - ax1) * (ay2 - ay1))) + sqrt(greatest(1e-9::DOUBLE, (bx2 - bx1) * (by2 - by1)))) / 2))"
DIST = "sqrt((acx - bcx) * (acx - bcx) + (acy - bcy) * (acy - bcy) + (az - bz) * (az - bz))"
INTER = f"(greatest(0::DOUBLE, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0::DOUBLE, least(ay2, by2) - greatest(ay1, by1)))"


def d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def scene(*, contact: bool = True, correct: bool = True, t: Thresholds | None = None, objects: str = "objects", contact_table: str = "contact", name: str = "res") -> str:
    """CTEs from objects (and contact) to `name`: every ordered pair with pred and flags as lists."""
    t = t or Thresholds()
    n = name
    if contact:
        elevated = f"""{n}_elev AS (SELECT image_id, i AS idx FROM {contact_table} GROUP BY image_id, i HAVING max(frac) >= {d(t.on_contact_min)}),
{n}_p AS (SELECT p.*, coalesce(c.frac, 0::DOUBLE) AS cab, coalesce(r.frac, 0::DOUBLE) AS cba, ea.idx IS NOT NULL AS ea, eb.idx IS NOT NULL AS eb FROM {n}_pairs p
 LEFT JOIN {contact_table} c ON c.image_id = p.image_id AND c.i = subj AND c.j = obj LEFT JOIN {contact_table} r ON r.image_id = p.image_id AND r.i = obj AND r.j = subj
 LEFT JOIN {n}_elev ea ON ea.image_id = p.image_id AND ea.idx = subj LEFT JOIN {n}_elev eb ON eb.image_id = p.image_id AND eb.idx = obj)"""
        on = f"acy < bcy AND abs(az - bz) <= {d(t.on_depth_eps)} AND cab >= {d(t.on_contact_min)}"
        under = f"bcy < acy AND abs(bz - az) <= {d(t.on_depth_eps)} AND cba >= {d(t.on_contact_min)}"
        ground = "NOT ea AND NOT eb"
    else:
        elevated = f"{n}_p AS (SELECT *, NULL::DOUBLE AS cab, NULL::DOUBLE AS cba FROM {n}_pairs)"
        g, h, e = d(t.on_vertical_gap), d(t.on_horizontal_overlap), d(t.on_depth_eps)
        on = f"acy < bcy AND by1 - ay2 >= -{g} AND by1 - ay2 <= {g} AND {OVERLAP} >= {h} AND abs(az - bz) <= {e}"
        under = f"bcy < acy AND ay1 - by2 >= -{g} AND ay1 - by2 <= {g} AND {OVERLAP} >= {h} AND abs(bz - az) <= {e}"
        ground = "FALSE"
    blocked = "(" + " OR ".join(f"la = '{c}' OR lb = '{c}'" for c in t.no_support_classes) + ")" if correct and t.no_support_classes else "FALSE"
    pairs = PAIRS.replace("pairs AS", f"{n}_pairs AS", 1).replace("objects", objects)
    return f"""{pairs},
{elevated},
{n}_1 AS (SELECT *, {GAP_REL} AS gap_rel, {DIST} AS dist3d, NOT {blocked} AND ({on}) AS on0, NOT {blocked} AND ({under}) AS un0 FROM {n}_p),
{n}_2 AS (SELECT *, on0 AND un0 AND {correct} AS cf, on0 AND NOT (un0 AND {correct}) AS on1, un0 AND NOT (on0 AND {correct}) AS un1,
 CASE WHEN bcx - acx > {d(t.lateral_center_eps)} THEN 'to the left of' WHEN acx - bcx > {d(t.lateral_center_eps)} THEN 'to the right of' END AS lat,
 CASE WHEN bz - az > {d(t.depth_eps)} THEN 'in front of' WHEN az - bz > {d(t.depth_eps)} THEN 'behind' WHEN {ground} AND ay2 - by2 > {d(t.plane_band)} THEN 'in front of' WHEN {ground} AND ay2 - by2 < -{d(t.plane_band)} THEN 'behind' END AS dep FROM {n}_1),
{n}_3 AS (SELECT *, (NOT {correct} OR NOT (on1 OR un1)) AS fr FROM {n}_2),
{n} AS (SELECT *, list_filter([CASE WHEN on1 THEN 'on' END, CASE WHEN un1 THEN 'under' END, lat, dep, CASE WHEN fr AND gap_rel <= {d(t.near_T)} THEN 'near' END], lambda x: x IS NOT NULL) AS pred,
 list_filter([CASE WHEN cf THEN 'on_under_conflict' END, CASE WHEN lat IS NULL THEN 'lateral_ambiguous' END, CASE WHEN dep IS NULL THEN 'depth_ambiguous' END, CASE WHEN fr AND abs(gap_rel - {d(t.near_T)}) <= {d(t.flag_near_band)} THEN 'near_threshold_edge' END], lambda x: x IS NOT NULL) AS flags FROM {n}_3)"""


def fact(name: str = "fact", res: str = "res", gold: str = "gold") -> str:
    """CTE `name`: pairs with gold of either direction, as sorted lists."""
    return f"""{name}_g AS (SELECT image_id, subj, obj, list_sort(list_distinct(list(predicate))) AS gold FROM {gold} GROUP BY image_id, subj, obj),
{name} AS (SELECT r.image_id, r.grp, r.subj, r.obj, r.gap_rel, r.dist3d, r.pred, r.flags, coalesce(g.gold, []::VARCHAR[]) AS gold, coalesce(v.gold, []::VARCHAR[]) AS gold_rev
 FROM {res} r LEFT JOIN {name}_g g ON g.image_id = r.image_id AND g.subj = r.subj AND g.obj = r.obj LEFT JOIN {name}_g v ON v.image_id = r.image_id AND v.subj = r.obj AND v.obj = r.subj)"""


@lru_cache
def with_(*parts: str) -> str:
    """WITH clause of the named parts: objects, contact, gold, frames, pairs, res (masks), box (no masks), fact."""
    known = {"objects": OBJECTS, "contact": CONTACT, "gold": GOLD, "frames": FRAMES, "pairs": PAIRS, "res": scene(), "box": scene(contact=False, name="box"), "fact": fact()}
    return "WITH " + ",\n".join(known.get(p, p) for p in parts) + "\n"


FACT = ("objects", "contact", "gold", "res", "fact")
