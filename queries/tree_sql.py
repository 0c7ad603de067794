"""Boosted trees as SQL: a recursion over the levels of all rounds, with all models side by side."""

from __future__ import annotations

from dataclasses import dataclass

from gridcast.functions.features import TREE_FEATURES
from gridcast.plans.trees import COLUMN_DRAWS, LEAST_GAIN, SHARES, UNIT, Growth

#: The thirteen features of a row that holds the forecast's measures, lead and valid time.
FEATURES_SQL = """[gfs_temperature_c, gfs_dewpoint_c, gfs_wind_speed_ms, gfs_cloud_cover_pct, gfs_precipitation_mm,
  sin(radians(gfs_wind_direction_deg)), cos(radians(gfs_wind_direction_deg)), lead_hours, interpolated::INT,
  sin(2 * pi() * hour(valid_time_utc) / 24.0::DOUBLE), cos(2 * pi() * hour(valid_time_utc) / 24.0::DOUBLE),
  sin(2 * pi() * dayofyear(valid_time_utc) / 365.25::DOUBLE), cos(2 * pi() * dayofyear(valid_time_utc) / 365.25::DOUBLE)]::DOUBLE[]"""


def cells_sql(matrix: str, learned: str, bins: int) -> str:
    """``values`` (row, f, v), ``edges`` (f, v) from the rows of ``learned``, and ``cells`` (row, f, b)."""
    return f"""numbers AS MATERIALIZED (SELECT row, unnest(range({len(TREE_FEATURES)})) AS f, unnest(x) AS v0 FROM {matrix}),
vals AS MATERIALIZED (SELECT row, f, round_even(v0 * 1e9, 0) / 1e9 AS v FROM numbers),
ordered AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS rn, count(*) OVER (PARTITION BY f) AS n FROM vals WHERE v IS NOT NULL AND row IN (SELECT row FROM {learned})),
edges AS MATERIALIZED (SELECT DISTINCT f, v FROM ordered JOIN range(1, {bins}) g(i) ON rn = ceil(i * n / {bins}.0::DOUBLE)),
tops AS (SELECT f, list(v ORDER BY v) AS vs FROM edges GROUP BY f),
cells AS MATERIALIZED (SELECT row, f, CASE WHEN v IS NULL THEN 0 ELSE 1 + coalesce(len([e FOR e IN vs IF e < v]), 0) END AS b FROM vals LEFT JOIN tops USING (f))"""


def draws_sql(growth: Growth, rows: str) -> str:
    """``draws`` (slot, r, d): the counter hash of every row and column in every round."""
    mask = 2147483647
    return f"""slots AS (SELECT DISTINCT row AS slot FROM {rows} UNION SELECT {COLUMN_DRAWS} + f FROM range({len(TREE_FEATURES)}) t(f)),
d0 AS (SELECT slot, r, ((((r * 40503 + {growth.seed}) & {mask}) * 1103515245 + slot * 2654435 + 12345) & {mask}) AS x FROM slots, range({growth.rounds}) t(r)),
d1 AS (SELECT slot, r, ((xor(x, x >> 15) * 1103515245 + 12345) & {mask}) AS x FROM d0),
d2 AS (SELECT slot, r, ((xor(x, x >> 15) * 22695477 + 1) & {mask}) AS x FROM d1),
d3 AS (SELECT slot, r, ((xor(x, x >> 15) * 1664525 + 1013904223) & {mask}) AS x FROM d2),
draws AS MATERIALIZED (SELECT slot, r, (xor(x, x >> 13) * {SHARES}) >> 31 AS d FROM d3)"""


@dataclass
class GrownSql:
    """Names of the tables a growth leaves behind."""

    parts: list[str]
    importances: str
    losses: str
    predictions: str


def grow_sql(name: str, rows: str, allowed: str, growth: Growth) -> GrownSql:
    """All models' boosters over ``rows`` (model, row, kind, y), kind 'learn', 'held' or 'ask'; ``allowed`` holds (model, f).

    One recursion whose step is a level: rows move on by one node, splits are
    added as rows of their own (with a gain), and after a round's last level the leaf
    is added to the prediction. Leaves (model, f, importance), (model, r, loss)
    and, after each round r, (model, row, r, pred) of rows asked for.
    """
    depth = growth.depth

    def leaf(g: str, n: str) -> str:
        return f"(-(({g})::DOUBLE / {UNIT}) / (({n})::DOUBLE + {growth.l2}) * {growth.rate})"

    def share(g: str, n: str) -> str:
        return f"(({g})::DOUBLE * ({g})::DOUBLE / (({n})::DOUBLE + {growth.l2}))"

    def side(right: bool) -> str:
        gl, nl = ("g_low", "n_low") if right else ("g_low + g_null", "n_low + n_null")
        gr, nr = f"g_all - ({gl})", f"n_all - ({nl})"
        gain = f"{share(gl, nl)} + {share(gr, nr)} - {share('g_all', 'n_all')}"
        return f"""SELECT step, model, node, f, b, {str(right).lower()} AS goes_right, {gl} AS gl, {nl} AS nl, g_all AS g, n_all AS n,
      CASE WHEN b > 0 AND {nl} >= {growth.least} AND {nr} >= {growth.least} THEN {gain} ELSE -1.0::DOUBLE END AS gain FROM sums"""

    right = "CASE WHEN c.b = 0 THEN goes_right ELSE c.b > s.b END"
    node = f"CASE WHEN ok THEN 2 * t.node + 1 + ({right})::INT ELSE t.node END"
    value = f"""CASE WHEN s.gain IS NULL THEN t.val WHEN NOT ok THEN CASE WHEN t.node = 0 THEN {leaf('s.g', 's.n')} ELSE t.val END
      WHEN {right} THEN {leaf('s.g - s.gl', 's.n - s.nl')} ELSE {leaf('s.gl', 's.nl')} END"""
    parts = [
        f"""{name}_open AS MATERIALIZED (SELECT model, r, f FROM {allowed} JOIN draws ON slot = {COLUMN_DRAWS} + f
  QUALIFY row_number() OVER (PARTITION BY model, r ORDER BY d, f) <= greatest(1, floor({growth.columns} * count(*) OVER (PARTITION BY model, r))))""",
        f"{name}_base AS (SELECT model, sum(floor(y * {UNIT} + 0.5)::BIGINT)::DOUBLE / count(*) / {UNIT} AS base FROM {rows} WHERE kind = 'learn' GROUP BY model)",
        f"""{name}_steps AS (
  SELECT 0 AS step, model::BIGINT AS model, row::BIGINT AS row, kind, y, base AS pred, 0 AS node, true AS live, 0.0::DOUBLE AS val, NULL::DOUBLE AS gain FROM {rows} JOIN {name}_base USING (model)
  UNION ALL (
    WITH here AS (SELECT * FROM {name}_steps WHERE gain IS NULL AND step < {growth.rounds * depth}),
    used AS (SELECT step, model, row, node, floor((pred - y) * {UNIT} + 0.5)::BIGINT AS g FROM here JOIN draws ON slot = row AND r = step // {depth}
      WHERE kind = 'learn' AND live AND d < {int(growth.rows * SHARES)}),
    hist AS (SELECT step, t.model, node, c.f, c.b, sum(g)::BIGINT AS g, count(*) AS n
      FROM used t JOIN {name}_open o ON o.model = t.model AND o.r = step // {depth} JOIN cells c ON c.row = t.row AND c.f = o.f GROUP BY ALL),
    sums AS (SELECT step, model, node, f, b, sum(g) OVER part AS g_all, sum(n) OVER part AS n_all,
      sum(CASE WHEN b > 0 THEN g ELSE 0 END) OVER upto AS g_low, sum(CASE WHEN b > 0 THEN n ELSE 0 END) OVER upto AS n_low,
      sum(CASE WHEN b > 0 THEN 0 ELSE g END) OVER part AS g_null, sum(CASE WHEN b > 0 THEN 0 ELSE n END) OVER part AS n_null
      FROM hist WINDOW part AS (PARTITION BY model, node, f), upto AS (PARTITION BY model, node, f ORDER BY b)),
    sides AS ({side(True)} UNION ALL {side(False)}),
    best AS MATERIALIZED (SELECT *, gain > {LEAST_GAIN * UNIT * UNIT!r} AS ok FROM sides QUALIFY row_number() OVER (PARTITION BY model, node ORDER BY gain DESC, f, b, goes_right DESC) = 1),
    moved AS (SELECT t.step + 1 AS step, t.model, t.row, kind, y, pred, {node} AS node, coalesce(ok, false) AS live, {value} AS val
      FROM here t LEFT JOIN best s ON s.model = t.model AND s.node = t.node AND t.live LEFT JOIN cells c ON c.row = t.row AND c.f = s.f)
    SELECT step, model, row, kind, y, CASE WHEN step % {depth} = 0 THEN pred + val ELSE pred END, CASE WHEN step % {depth} = 0 THEN 0 ELSE node END,
      live OR step % {depth} = 0, CASE WHEN step % {depth} = 0 THEN 0.0::DOUBLE ELSE val END, NULL::DOUBLE FROM moved
    UNION ALL SELECT step + 1, model, f, 'split', 0.0::DOUBLE, 0.0::DOUBLE, node, false, 0.0::DOUBLE, gain / {UNIT} / {UNIT} FROM best WHERE ok))""",
        f"{name}_means AS (SELECT model, row AS f, avg(gain) AS gain FROM {name}_steps WHERE gain IS NOT NULL GROUP BY ALL)",
        f"{name}_shares AS MATERIALIZED (SELECT model, f, gain / sum(gain) OVER (PARTITION BY model) AS importance FROM {name}_means)",
        f"{name}_rounds AS (SELECT step // {depth} - 1 AS r, model, row, kind, y, pred FROM {name}_steps WHERE gain IS NULL AND step > 0 AND step % {depth} = 0)",
        f"{name}_losses AS (SELECT model, r, sum(floor(abs(pred - y) * {UNIT} + 0.5)::BIGINT)::DOUBLE / count(*) / {UNIT} AS loss FROM {name}_rounds WHERE kind = 'held' GROUP BY ALL)",
        f"{name}_asked AS (SELECT model, row, r, pred FROM {name}_rounds WHERE kind = 'ask')",
    ]
    return GrownSql(parts, f"{name}_shares", f"{name}_losses", f"{name}_asked")


def every_column_sql(rows: str) -> str:
    return f"every AS (SELECT model, f FROM (SELECT DISTINCT model FROM {rows}), range({len(TREE_FEATURES)}) t(f))"


def kept_sql(shares: str, most: int) -> str:
    """``kept`` (model, f): the best features with a positive share, the first one if there is none."""
    return f"""ranked AS (SELECT model, f, coalesce(importance, 0) AS importance, row_number() OVER (PARTITION BY model ORDER BY coalesce(importance, 0) DESC, f) AS k
  FROM every LEFT JOIN {shares} USING (model, f)),
kept AS MATERIALIZED (SELECT model, f FROM ranked WHERE (importance > 0 AND k <= {most}) OR k = 1)"""


def best_sql(losses: str, patience: int | None) -> list[str]:
    """``best`` (model, r): the repeat of every trial and the round of its lowest loss, giving up ``patience`` rounds after the last improvement."""
    if patience is None:
        return [f"best AS (SELECT model + 1 AS model, r FROM {losses} QUALIFY row_number() OVER (PARTITION BY model ORDER BY loss, r) = 1)"]
    return [
        f"improved AS (SELECT model, r, coalesce(loss < min(loss) OVER (PARTITION BY model ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM {losses})",
        "standing AS (SELECT model, r, max(CASE WHEN better THEN r END) OVER (PARTITION BY model ORDER BY r) AS lowest FROM improved)",
        f"best AS (SELECT model + 1 AS model, coalesce(min(lowest) FILTER (WHERE r - lowest >= {patience}), max(lowest)) AS r FROM standing GROUP BY model)",
    ]


def recipe_sql(rows: str, growth: Growth, most: int, patience: int | None = None) -> list[str]:
    """Two growths as the recipe has them, and ``answers`` (model, row, pred) of the repeats, cut where their trial was best."""
    first = grow_sql("sel", "learning", "every", growth)
    second = grow_sql("fit", rows, "kept", growth)
    return [
        f"learning AS MATERIALIZED (SELECT * FROM {rows} WHERE kind = 'learn')",
        every_column_sql(rows),
        draws_sql(growth, rows),
        *first.parts,
        kept_sql(first.importances, most),
        *second.parts,
        *best_sql(second.losses, patience),
        f"answers AS (SELECT a.model, a.row, a.pred FROM {second.predictions} a JOIN best USING (model, r))",
    ]
