"""Least squares as SQL: normal equations by fold, solved by a recursive elimination over their cells."""

from __future__ import annotations

from gridcast.plans.least_squares import EXPLAINED

FOLD = "station_id, folds, cutoff"


def fits_sql(name: str, rows: str, count: int, minimum: int) -> str:
    """``{name}`` (fold, n, intercept, b, rss) from ``rows`` (fold, z) with z = [1, features, label].

    Folds with fewer than ``minimum`` rows have a count and nothing else.
    """
    size, m, k = count + 2, count + 1, count
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = ", ".join(f"sum(z[{i + 1}] * z[{j + 1}]) AS s{i}_{j}" for i, j in pairs)
    full = "[" + ", ".join(f"s{min(i, j)}_{max(i, j)}" for i in range(size) for j in range(size)) + "]"
    fold = ", ".join(f"x.{c}" for c in FOLD.split(", "))

    def same(*others: str) -> str:
        return " AND ".join(f"{o}.fid = e.fid" for o in others)

    return f"""{name}_sums AS MATERIALIZED (SELECT {FOLD}, row_number() OVER (ORDER BY {FOLD}) AS fid, {full} AS a FROM (SELECT {FOLD}, {sums} FROM {rows} GROUP BY ALL)),
{name}_cells AS (SELECT fid, a[1] AS n, (c // {m})::INT AS i, (c % {m})::INT AS j, a, a[(c // {m} + 1) * {size} + c % {m} + 2] - a[c // {m} + 2] * a[c % {m} + 2] / a[1] AS v
  FROM {name}_sums, range({m * m}) g(c)),
{name}_scale AS MATERIALIZED (SELECT fid, i, sqrt(greatest(v, 0)) AS spread, CASE WHEN i = {k} THEN CASE WHEN v > 0 THEN sqrt(v) ELSE 1 END
    WHEN sqrt(greatest(v, 0)) > 1e-9 * sqrt(greatest(a[(i + 1) * {size} + i + 2], 1e-300)) THEN sqrt(v) ELSE 0 END AS d FROM {name}_cells WHERE i = j),
{name}_steps AS (
  SELECT 0 AS p, c.fid, c.i, c.j, CASE WHEN r.d = 0 OR q.d = 0 THEN 0 ELSE v / (r.d * q.d) END::DOUBLE AS v
  FROM {name}_cells c JOIN {name}_scale r ON r.fid = c.fid AND r.i = c.i JOIN {name}_scale q ON q.fid = c.fid AND q.i = c.j
  UNION ALL (
    SELECT e.p + 1, e.fid, e.i, e.j, CASE WHEN d.v <= {EXPLAINED!r} THEN CASE WHEN e.i = e.p OR e.j = e.p THEN 0 ELSE e.v END
      WHEN e.i = e.p THEN r.v / d.v ELSE e.v - c.v * r.v / d.v END
    FROM {name}_steps e JOIN {name}_steps d ON {same('d')} AND d.i = e.p AND d.j = e.p JOIN {name}_steps r ON {same('r')} AND r.i = e.p AND r.j = e.j
      JOIN {name}_steps c ON {same('c')} AND c.i = e.i AND c.j = e.p WHERE e.p < {k})),
{name}_b AS (SELECT e.fid, list(CASE WHEN s.d = 0 THEN 0 ELSE e.v * y.d / s.d END ORDER BY e.i) AS b
  FROM {name}_steps e JOIN {name}_scale s ON s.fid = e.fid AND s.i = e.i JOIN {name}_scale y ON y.fid = e.fid AND y.i = {k} WHERE e.p = {k} AND e.j = {k} AND e.i < {k} GROUP BY e.fid),
{name} AS MATERIALIZED (SELECT {fold}, x.a[1]::BIGINT AS n, CASE WHEN x.a[1] >= {minimum} THEN b END AS b,
    CASE WHEN x.a[1] >= {minimum} THEN x.a[{size}] / x.a[1] - list_dot_product(b, x.a[2:{k + 1}]) / x.a[1] END AS intercept,
    CASE WHEN x.a[1] >= {minimum} THEN greatest(e.v, 0) * y.d * y.d END AS rss
  FROM {name}_sums x JOIN {name}_b USING (fid) JOIN {name}_steps e ON e.fid = x.fid AND e.p = {k} AND e.i = {k} AND e.j = {k} JOIN {name}_scale y ON y.fid = x.fid AND y.i = {k})"""


def calendar_z(ts: str, origin: str, daily: int = 3, annual: int = 3) -> str:
    """The calendar regression's features of a day as list items: trend, waves and first-order products."""
    hour, day = f"hour({ts})", f"(dayofyear({ts}) - 1 + hour({ts}) / 24.0::DOUBLE)"
    out = [f"epoch({ts} - {origin}) / 31557600.0::DOUBLE"]
    out += [f"{w}(2 * pi() * {q} * {hour} / 24.0::DOUBLE)" for q in range(1, daily + 1) for w in ("sin", "cos")]
    out += [f"{w}(2 * pi() * {q} * {day} / 365.25::DOUBLE)" for q in range(1, annual + 1) for w in ("sin", "cos")]
    out += [f"{d}(2 * pi() * {hour} / 24.0::DOUBLE) * {a}(2 * pi() * {day} / 365.25::DOUBLE)" for d in ("sin", "cos") for a in ("sin", "cos")]
    return ", ".join(out)


def correction_z(valid: str, lead: str, forecast: str, daily: int = 2) -> str:
    """The forecast correction's features: forecast, lead in days, their product, two daily waves and one annual."""
    out = [forecast, f"{lead} / 24.0::DOUBLE", f"{forecast} * ({lead} / 24.0::DOUBLE)"]
    out += [f"{w}(2 * pi() * {q} * hour({valid}) / 24.0::DOUBLE)" for q in range(1, daily + 1) for w in ("sin", "cos")]
    out += [f"{w}(2 * pi() * (dayofyear({valid}) - 1) / 365.25::DOUBLE)" for w in ("sin", "cos")]
    return ", ".join(out)


ORIGIN_SQL = "org AS MATERIALIZED (SELECT station_id, min(ds) AS origin FROM target WHERE y IS NOT NULL GROUP BY 1)"


def calendar_sql(name: str = "calendar") -> str:
    """``{name}`` (fold, ds, yhat, spread): the calendar regression with the recent residual fading in two days."""
    return f"""{ORIGIN_SQL},
cal_days AS MATERIALIZED (SELECT station_id, ds, y, [1.0::DOUBLE, {calendar_z('ds', 'origin')}]::DOUBLE[] AS x FROM target JOIN org USING (station_id) WHERE y IS NOT NULL),
cal_rows AS (SELECT f.station_id, f.folds, f.cutoff, list_append(x, y) AS z FROM folds f JOIN cal_days d ON d.station_id = f.station_id AND d.ds < f.cutoff),
{fits_sql('cal_fits', 'cal_rows', 17, 1)},
cal_last AS (SELECT f.station_id, f.folds, f.cutoff, max(ds) AS last_ds FROM folds f JOIN cal_days d ON d.station_id = f.station_id AND d.ds < f.cutoff GROUP BY ALL),
cal_anomaly AS (SELECT l.station_id, l.folds, l.cutoff, last_ds, avg(d.y - intercept - list_dot_product(b, x[2:])) AS anomaly
  FROM cal_last l JOIN cal_fits USING ({FOLD}) JOIN cal_days d ON d.station_id = l.station_id AND d.ds <= last_ds AND d.ds > last_ds - INTERVAL 72 HOUR GROUP BY ALL),
{name} AS (SELECT u.station_id, u.folds, u.cutoff, u.ds, intercept + list_dot_product(b, [{calendar_z('u.ds', 'origin')}]::DOUBLE[]) + anomaly * exp(-(epoch(u.ds - last_ds) / 86400.0::DOUBLE) / 2.0::DOUBLE) AS yhat,
    CASE WHEN n > 18 THEN 1.96 * sqrt(rss / (n - 18)) END AS spread
  FROM future u JOIN org USING (station_id) JOIN cal_fits USING ({FOLD}) JOIN cal_anomaly USING ({FOLD}))"""


def correction_sql(name: str = "corrected") -> str:
    """``cor_fits`` and ``{name}`` (fold, ds, yhat, spread): the forecast correction at every fold and day."""
    return f"""cor_pairs AS MATERIALIZED (SELECT p.station_id, greatest(init_time_utc, valid_time_utc) AS known,
    [1.0::DOUBLE, {correction_z('valid_time_utc', 'lead_hours', 'temperature_c')}, t.y]::DOUBLE[] AS z
  FROM panel p JOIN target t ON t.station_id = p.station_id AND t.ds = p.valid_time_utc AND t.y IS NOT NULL WHERE temperature_c IS NOT NULL),
cor_rows AS (SELECT f.station_id, f.folds, f.cutoff, z FROM folds f JOIN cor_pairs d ON d.station_id = f.station_id AND d.known < f.cutoff),
{fits_sql('cor_fits', 'cor_rows', 9, 50)},
{name} AS (SELECT u.station_id, u.folds, u.cutoff, u.ds, intercept + list_dot_product(b, [{correction_z('w.valid_time_utc', 'w.lead_hours', 'w.gfs_temperature_c')}]::DOUBLE[]) AS yhat,
    CASE WHEN n > 10 THEN 1.96 * sqrt(rss / (n - 10)) END AS spread
  FROM future u LEFT JOIN fwindow w ON w.station_id = u.station_id AND w.folds = u.folds AND w.cutoff = u.cutoff AND w.valid_time_utc = u.ds LEFT JOIN cor_fits c ON c.station_id = u.station_id AND c.folds = u.folds AND c.cutoff = u.cutoff AND w.gfs_temperature_c IS NOT NULL)"""


def all_regressors_sql(names: tuple[str, ...], name: str = "covariate_all") -> str:
    """``{name}`` (fold, ds, yhat, spread): the correction on all measures at every fold and day."""
    listed = ", ".join(names)
    present = " AND ".join(f"{n} IS NOT NULL" for n in names)
    return f"""all_days AS MATERIALIZED (SELECT station_id, ds, [1.0::DOUBLE, {listed}, y]::DOUBLE[] AS z FROM attached WHERE y IS NOT NULL AND {present}),
all_rows AS (SELECT f.station_id, f.folds, f.cutoff, z FROM folds f JOIN all_days d ON d.station_id = f.station_id AND d.ds < f.cutoff),
{fits_sql('all_fits', 'all_rows', len(names), 2)},
all_window AS (SELECT station_id, folds, cutoff, valid_time_utc AS ds, [{listed}]::DOUBLE[] AS x FROM fwindow WHERE {present}),
{name} AS (SELECT u.station_id, u.folds, u.cutoff, u.ds, intercept + list_dot_product(b, x) AS yhat, CASE WHEN x IS NOT NULL THEN 1.2815515655446004 * sqrt(rss / n) END AS spread
  FROM future u LEFT JOIN all_window USING (station_id, folds, cutoff, ds) LEFT JOIN all_fits USING ({FOLD}))"""
