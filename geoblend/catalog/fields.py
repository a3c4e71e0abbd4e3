"""Queries of state recursions, the field model, day-by-day fusion and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import hash_unit
from ..operators import calibrate, covariates, daily, field, metrics, mixing_field, scan, spatial, state
from ..sources import roles as R
from ..sources.tables import Source, dealt, shared_folder, written
from .etl import daily_sparse
from .geometry import STATIONS, station_points
from .registry import ORACLES, query, roles, rounded

SOURCES = [Source("station", "station", 0.3), Source("satellite", "satellite", 0.8, 0.9, 0.1)]


def day_rows(spark, sf_dir: str) -> DataFrame:
    """grid_id, day, value (station), prior: the stations' days."""
    day = F.datediff("date", F.lit("2024-01-01").cast("date"))
    df = daily_sparse(spark, sf_dir).filter("station is not null or satellite is not null")
    return df.join(R.priors(spark, sf_dir).select("grid_id", F.col("lur").alias("prior")), "grid_id").select("grid_id", day.alias("day"), F.col("station").alias("value"), "prior")


_DAYS = """d AS (SELECT grid_id, date_diff('day', DATE '2024-01-01', date) AS day, station AS value, lur AS prior FROM daily JOIN priors USING (grid_id) WHERE station IS NOT NULL OR satellite IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY day) AS i FROM d)"""


@query(roles("daily", "priors").replace("WITH ", "WITH RECURSIVE ") + f""", {_DAYS},
    f AS (SELECT grid_id, day, i, prior AS mean, 2e0 AS var FROM o WHERE i = 1 UNION ALL
          SELECT o.grid_id, o.day, o.i, CASE WHEN value IS NULL THEN f.mean ELSE f.mean + (f.var + 0.5e0) / (f.var + 2.5e0) * (value - f.mean) END, CASE WHEN value IS NULL THEN f.var + 0.5e0 ELSE (1 - (f.var + 0.5e0) / (f.var + 2.5e0)) * (f.var + 0.5e0) END
          FROM f JOIN o ON o.grid_id = f.grid_id AND o.i = f.i + 1)
    SELECT grid_id, day::INT AS day, round(mean, 6) AS mean, round(var, 6) AS var FROM f""")
def cell_filter(spark, sf_dir: str) -> DataFrame:
    """Random-walk Kalman filter of every station cell."""
    return rounded(state.random_walk_filter(day_rows(spark, sf_dir)))


@query(roles("daily", "priors").replace("WITH ", "WITH RECURSIVE ") + """, s AS (SELECT grid_id, date_diff('day', DATE '2024-01-01', date) AS day, station / 100e0 AS m, 0.5e0 AS v FROM daily WHERE station IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY day) AS i, count(*) OVER (PARTITION BY grid_id) AS n FROM s),
    f AS (SELECT grid_id, day, i, n, m AS mean, v AS var, m AS pm, v AS pv, 0e0 AS a FROM o WHERE i = 1 UNION ALL
          SELECT grid_id, day, i, n, pm + pv / (pv + v) * (m - pm), greatest((1 - pv / (pv + v)) * pv, 1e-12), pm, pv, a FROM (
            SELECT o.grid_id, o.day, o.i, o.n, o.m, o.v, exp(-(o.day - f.day) / 5e0) AS a, exp(-(o.day - f.day) / 5e0) * f.mean AS pm,
                   exp(-(o.day - f.day) / 5e0) ** 2 * f.var + (1 - exp(-(o.day - f.day) / 5e0) ** 2) AS pv FROM f JOIN o ON o.grid_id = f.grid_id AND o.i = f.i + 1)),
    b AS (SELECT grid_id, day, i, mean, var, mean AS sm, var AS sv, pm, pv, a FROM f WHERE i = n UNION ALL
          SELECT f.grid_id, f.day, f.i, f.mean, f.var, f.mean + f.var * b.a / b.pv * (b.sm - b.pm), greatest(f.var + (f.var * b.a / b.pv) ** 2 * (b.sv - b.pv), 1e-12), f.pm, f.pv, f.a
          FROM b JOIN f ON f.grid_id = b.grid_id AND f.i = b.i - 1)
    SELECT grid_id, day::INT AS day, round(mean, 6) AS mean, round(var, 6) AS var, round(sm, 6) AS smooth_mean, round(sv, 6) AS smooth_var FROM b""")
def cell_smoother(spark, sf_dir: str) -> DataFrame:
    """Decaying filter and backward smoother of every station cell."""
    day = F.datediff("date", F.lit("2024-01-01").cast("date"))
    df = daily_sparse(spark, sf_dir).filter("station is not null").select("grid_id", day.alias("day"), (F.col("station") / 100.0).alias("mean"), F.lit(0.5).alias("var"))
    return rounded(state.decay_smoother(df))


def long_cell_filter(spark, sf_dir: str) -> DataFrame:
    """The filter of every station cell by blocks of 16 days, folded apart and joined by their ends."""
    return rounded(scan.long_random_walk_filter(day_rows(spark, sf_dir), block=16))


query(ORACLES["cell_filter"])(long_cell_filter)


def long_cell_smoother(spark, sf_dir: str) -> DataFrame:
    """Filter and smoother of every station cell by blocks of 16 days."""
    day = F.datediff("date", F.lit("2024-01-01").cast("date"))
    df = daily_sparse(spark, sf_dir).filter("station is not null").select("grid_id", day.alias("day"), (F.col("station") / 100.0).alias("mean"), F.lit(0.5).alias("var"))
    return rounded(scan.long_decay_smoother(df, block=16))


query(ORACLES["cell_smoother"])(long_cell_smoother)


@query(roles("daily") + """, d AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', date) AS day FROM daily), t AS (SELECT day, day - lag(day) OVER (ORDER BY day) AS dt FROM d)
    SELECT day::INT AS day, dt::DOUBLE AS dt, round(coalesce(exp(-dt / 5e0), 0), 6) AS a, round(1 - coalesce(exp(-dt / 5e0), 0) ** 2, 6) AS q FROM t""")
def day_transitions(spark, sf_dir: str) -> DataFrame:
    df = daily_sparse(spark, sf_dir).withColumn("day", F.datediff("date", F.lit("2024-01-01").cast("date")))
    return rounded(state.transitions(df).withColumn("dt", F.col("dt").cast("double")))


def scaled_cells(spark, sf_dir: str) -> DataFrame:
    """grid_id, x, y, prior: the cells, about unit scale."""
    cells = R.cells(spark, sf_dir)
    s = cells.agg(F.min("latitude").alias("a"), F.max("latitude").alias("b"), F.min("longitude").alias("c"), F.max("longitude").alias("d")).first()
    size = max(s["b"] - s["a"], s["d"] - s["c"]) or 1.0
    place = [((F.col("latitude") - s["a"]) / size).alias("x"), ((F.col("longitude") - s["c"]) / size).alias("y")]
    return cells.join(R.priors(spark, sf_dir), "grid_id").select("grid_id", *place, ((F.col("lur") - 45.0) / 100.0).alias("prior"))


def map_cells(spark, sf_dir: str) -> DataFrame:
    """grid_id, x, y, prior of every cell that has a place, with readings or without, written: maps cover them all."""
    return written(scaled_cells(spark, sf_dir).filter("x is not null and y is not null").distinct(), "field-cells")


def scaled_long(spark, sf_dir: str) -> DataFrame:
    """grid_id, day, x, y, t, source, value, prior, slope, intercept, noise: training rows of the field, about unit scale.
    Written once, as the field's steps read them several times. Only cells with readings have rows."""
    day = F.datediff("date", F.lit("2024-01-01").cast("date"))
    df = daily_sparse(spark, sf_dir).join(scaled_cells(spark, sf_dir), "grid_id").withColumn("day", day)
    df = df.select("grid_id", "day", "x", "y", (F.col("day") / 30.0).alias("t"), "prior", ((F.col("station") - 50.0) / 100.0).alias("station"), ((F.col("satellite") - 50.0) / 100.0).alias("satellite"))
    long = written(df, "field-wide").unpivot(["grid_id", "day", "x", "y", "t", "prior"], ["station", "satellite"], "source", "value").filter("value is not null")
    return field_rows(field.with_source(long, SOURCES))


def field_rows(rows: DataFrame) -> DataFrame:
    """rows written in even files, the days of a cell side by side (the field's steps share the kernel of equal places)."""
    return written(dealt(rows, "grid_id").sortWithinPartitions("grid_id", "day"), "field-rows")


COVARIATES = ("traffic_wind", "wind_speed")


def upwind_cells(spark, sf_dir: str) -> DataFrame:
    """grid_id, upwind_0..7 of every cell that has a place, from the mean traffic of the cells around."""
    traffic = daily_sparse(spark, sf_dir).groupBy("grid_id").agg(F.avg("traffic").alias("traffic"))
    return covariates.upwind_on_grid(R.cells(spark, sf_dir).filter("r is not null"), traffic, R.STEP)


def covariate_columns() -> list[Column]:
    """The covariates from the sectors' sums: log traffic weighted by wind and distance, and wind speed."""
    total = lambda name: sum((F.col(f"{name}_{k}") for k in range(covariates.SECTORS)), F.lit(0.0))
    return [F.log1p(total("traffic_wind")).alias("traffic_wind"), total("speed_freq").alias("wind_speed")]


def covariate_days(spark, sf_dir: str, upwind: DataFrame | None = None) -> DataFrame:
    """grid_id, day and the covariates of the days with readings, written."""
    w = covariates.wind_weighted(R.wind(daily_sparse(spark, sf_dir)), upwind_cells(spark, sf_dir) if upwind is None else upwind)
    day = F.datediff("date", F.lit("2024-01-01").cast("date"))
    return written(w.select("grid_id", day.alias("day"), *covariate_columns()), "field-covariates")


def standardised(df: DataFrame, days: DataFrame) -> DataFrame:
    """df with its covariates in units of their mean and spread over the days with readings."""
    s = days.agg(*[F.avg(c).alias(f"m_{c}") for c in COVARIATES], *[F.stddev_pop(c).alias(f"s_{c}") for c in COVARIATES]).first()
    return df.withColumns({c: (F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] or 1.0) for c in COVARIATES})


def with_covariates(rows: DataFrame, days: DataFrame) -> DataFrame:
    """rows with the covariates of their cell and day, standardised; those without are filled with the mean of all days."""
    return daily.fill_covariates(rows, standardised(days, days), ["grid_id", "day"], list(COVARIATES))


def map_frame(cells: DataFrame, times: DataFrame, upwind: DataFrame, days: DataFrame) -> DataFrame:
    """Every cell at every time(day, t, ...) with its covariates, standardised. What a cell has of its own comes before its
    times, so no row of the frame is shuffled."""
    known = dealt(cells.join(upwind.dropDuplicates(["grid_id"]), "grid_id", "left"), "grid_id")
    frame = spatial.space_time_frame(known, times).withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")))
    sums = frame.select("*", *R.wind_columns()).withColumns(covariates.wind_weights())
    return standardised(sums.select(*cells.columns, *times.columns, *covariate_columns()), days)


def covariate_field(rows: DataFrame) -> field.Field:
    """Inducing points are cluster centres of the training rows' places, times and covariates."""
    lengths = (0.3, 0.3, 0.3, 2.0, 2.0)
    return field.Field(field.kmeans_points(rows, 120, columns=(*field.COORDS, *COVARIATES), lengths=lengths), covariates=COVARIATES, lengths=lengths[3:])


@query()
def field_covariates(spark, sf_dir: str) -> DataFrame:
    """Leave-one-station-out scores of the field of place and time, and of that with wind and traffic in its kernel."""
    rows = field_rows(with_covariates(scaled_long(spark, sf_dir), covariate_days(spark, sf_dir)))
    stations, out = rows.filter("source = 'station'"), None
    with_both = covariate_field(rows)
    plain = field.Field(field.kmeans_points(rows, 120, columns=field.COORDS, lengths=(0.3, 0.3, 0.3)))
    sums = field.information_sums(rows, {"plain": plain, "covariates": with_both})
    for case, f in (("plain", plain), ("covariates", with_both)):
        scores = metrics.evaluate(field.leave_key_out(stations, sums[case], f, "grid_id", noise=0.3), "value").withColumn("case", F.lit(case))
        out = scores if out is None else out.unionByName(scores)
    return rounded(out.select("case", "n", "rmse", "mae", "bias", "crps", "coverage_90"), 4)


@query()
def field_relevance(spark, sf_dir: str) -> DataFrame:
    """Length scales of coordinates and covariates by round of the search on evidence: a long one means little relevance."""
    rows = field_rows(with_covariates(scaled_long(spark, sf_dir), covariate_days(spark, sf_dir)))
    _, history = field.tuned_field(rows, covariate_field(rows), rounds=4)
    table = [(i, n, float(v), float(h["evidence"])) for i, h in enumerate(history, 1) for n, v in h.items() if n != "evidence"]
    return rounded(spark.createDataFrame(table, "round int, parameter string, value double, evidence double"), 4)


@query()
def covariate_maps(spark, sf_dir: str) -> DataFrame:
    """Maps of every day with data from the field with covariates: every cell, with readings or without, by its own wind and
    traffic, moved by the stations' residual biases, with bounds and the day's numbers of observations by source."""
    upwind = written(upwind_cells(spark, sf_dir), "field-upwind")
    days = covariate_days(spark, sf_dir, upwind)
    rows = field_rows(with_covariates(scaled_long(spark, sf_dir), days))
    f = covariate_field(rows)
    post = field.fit(field.information_sums(rows, f)[""], f)
    stations = rows.filter("source = 'station'")
    anchors = calibrate.residual_bias(field.predict(stations, post), "value", by=["grid_id", "x", "y"])
    anchors = anchors.select(F.col("grid_id").alias("ord"), F.col("x").alias("latitude"), F.col("y").alias("longitude"), F.col("bias").alias("value"))
    anchors = written(anchors, "field-anchors")  # read by several steps, which would predict the stations' rows each
    places = map_cells(spark, sf_dir).withColumnsRenamed({"x": "latitude", "y": "longitude"})
    cells = spatial.idw(places, anchors, "grid_id", default=0.0).withColumnsRenamed({"latitude": "x", "longitude": "y", "value": "bias"})
    counts = rows.filter("day is not null").groupBy("day", "t").agg(*[F.count_if(F.col("source") == k).alias(f"n_{k}") for k in ("station", "satellite")])
    grid = map_frame(cells, written(counts, "field-days"), upwind, days)
    maps = calibrate.shifted(field.exported(field.predict(grid, post)), "bias")
    own = {c: 50.0 + 100.0 * F.col(c) for c in ("mean", "lower_95", "upper_95")} | {"std": 100.0 * F.col("std")}
    return rounded(maps.withColumns(own).select("grid_id", "day", "mean", "std", "lower_95", "upper_95", F.col("n_station").alias("n_obs"), "n_station", "n_satellite"), 4)


def inducing(rows: DataFrame) -> field.Field:
    return field.Field(field.even_points(rows, 24, 5))


@query()
def field_prediction(spark, sf_dir: str) -> DataFrame:
    """Fused field at every training row: fit from information sums, predict with uncertainty."""
    rows = scaled_long(spark, sf_dir)
    f = inducing(rows)
    post = field.fit(field.information_sums(rows, f)[""], f)
    return rounded(field.predict(rows, post, noise=0.3).select("grid_id", "day", "source", "value", "mean", "std"), 4)


@query()
def field_evidence(spark, sf_dir: str) -> DataFrame:
    """Evidence of candidate parameters from one pass, the best flagged."""
    rows = scaled_long(spark, sf_dir)
    base = inducing(rows)
    from dataclasses import replace

    candidates = {f"space{s}_var{v}": replace(base, space=s, variance=v) for s in (0.1, 0.3, 1.0) for v in (0.3, 1.0)}
    best, scores = field.select_field(rows, candidates)
    return spark.createDataFrame([(n, float(round(v, 3)), n == best) for n, v in scores.items()], "candidate string, evidence double, best boolean")


@query()
def domain_draws(spark, sf_dir: str) -> DataFrame:
    """Mean of the field over all cells by day with its spread, from joint draws, in which neighbouring cells err together."""
    rows = scaled_long(spark, sf_dir)
    f = inducing(rows)
    post = field.fit(field.information_sums(rows, f)[""], f)
    grid = spatial.space_time_frame(rows.select("grid_id", "x", "y", "prior").distinct(), rows.select("day", "t").distinct())
    return rounded(field.mean_of_draws(field.joint_samples(grid, post, 32), ["day"]), 4)


@query()
def field_sources(spark, sf_dir: str) -> DataFrame:
    """Slope, intercept and noise of the sources learned with the field, by round, from sums of one pass."""
    rows = scaled_long(spark, sf_dir).drop("slope", "intercept", "noise")
    start = [Source("station", "station", 0.3), Source("satellite", "satellite", 0.8)]
    _, history = field.learned_sources(rows, inducing(rows), start, "station", rounds=20)
    names = ["round", "source", "slope", "intercept", "noise", "evidence"]
    return rounded(spark.createDataFrame([tuple(h[n] for n in names) for h in history], "round int, source string, slope double, intercept double, noise double, evidence double"), 4)


_PAIRS = (("station", "station"), ("station", "satellite"), ("station", "traffic"), ("satellite", "satellite"), ("satellite", "traffic"), ("traffic", "traffic"))


@query(roles("daily", "priors") + """, r AS (SELECT station - lur AS station, satellite - lur AS satellite, traffic - lur AS traffic FROM daily JOIN priors USING (grid_id))
    """ + " UNION ALL ".join(f"""SELECT '{a}' AS source_a, '{b}' AS source_b, count({a} + {b}) AS n, round(covar_pop({a}, {b}), 4) AS covariance,
        round(corr({a}, {b}), 6) AS correlation FROM r""" for a, b in _PAIRS))
def source_pairs(spark, sf_dir: str) -> DataFrame:
    """Covariance and correlation of the residuals of each pair of sources over the cells and days that have both."""
    df = daily_sparse(spark, sf_dir).join(R.priors(spark, sf_dir).select("grid_id", F.col("lur").alias("prior")), "grid_id")
    names = ["station", "satellite", "traffic"]
    long = df.unpivot(["grid_id", "date", "prior"], names, "source", "value")
    return rounded(mixing_field.residual_moments(long, ["grid_id", "date"], names), 6, covariance=4)


@query()
def field_mixed(spark, sf_dir: str) -> DataFrame:
    """Scores of the stations left out by fifths: from the other stations alone, and with the satellite's field as a second,
    correlated output whose mixing matrix is learned. One pass gives the sums of all folds."""
    rows = scaled_long(spark, sf_dir).drop("slope", "intercept", "noise").withColumn("fold", F.floor(5 * hash_unit("mixed", "grid_id")).cast("int"))
    f, sources = inducing(rows), [Source(s.name, s.column, s.noise) for s in SOURCES]
    names = [s.name for s in sources]
    by_fold = field.source_sums(rows.withColumn("source", F.concat_ws("|", "source", "fold")), f)
    total = {n: tuple(map(sum, zip(*(p for k, p in by_fold.items() if k.startswith(f"{n}|"))))) for n in names}
    total = {n: p for n, p in total.items() if p}
    moments = [(r["source_a"], r["source_b"], r["covariance"]) for r in mixing_field.residual_moments(rows, ["grid_id", "day"], names).collect()]  # one row a pair
    outputs = {}
    for k in range(5):
        held = by_fold.get(f"station|{k}")
        rest = mixing_field.without(total, {"station": held} if held else {})
        for case, used in (("station", names[:1]), ("mixed", names)):
            own = {n: p for n, p in rest.items() if n in used}
            start = mixing_field.start_mixture(f, [s for s in sources if s.name in used], moments)
            found, _ = mixing_field.learned_mixture(own, start, rounds=30)
            outputs[f"{case}|{k}"] = (mixing_field.latent_posterior(own, found), "station")
    asked = rows.filter("source = 'station'").withColumn("case", F.explode(F.array(F.lit("station"), F.lit("mixed")))).withColumn("key", F.concat_ws("|", "case", "fold"))
    scored = metrics.evaluate(mixing_field.predict_outputs(asked, outputs, "key"), "value", by=["case"])
    return rounded(scored.select("case", "n", "rmse", "mae", "bias", "crps", "coverage_90"), 4)


@query()
def field_by_source(spark, sf_dir: str) -> DataFrame:
    """A field for each source, scored on its own rows."""
    rows = scaled_long(spark, sf_dir)
    f = inducing(rows)
    posts = {k: field.fit(s, f) for k, s in field.information_sums(rows, f, key="source").items()}
    return rounded(metrics.evaluate(field.predict(rows, posts, key="source", noise=0.3), "value", by=["source"]).select("source", "n", "rmse", "mae", "crps", "coverage_90"), 4)


@query()
def field_loso(spark, sf_dir: str) -> DataFrame:
    """Leave-one-station-out of the field: every fold's sums are the total less the station's."""
    rows = scaled_long(spark, sf_dir)
    f = inducing(rows)
    total = field.information_sums(rows, f)[""]
    scored = field.leave_key_out(rows.filter("source = 'station'"), total, f, "grid_id", noise=0.3)
    return rounded(metrics.evaluate(scored, "value", by=["grid_id"]).select("grid_id", "n", "rmse", "mae", "bias", "crps"), 4)


@query()
def field_cases(spark, sf_dir: str) -> DataFrame:
    """Experiment cases (stations, prior alone, prior with satellite, both) scored at the stations."""
    rows = scaled_long(spark, sf_dir)
    f = inducing(rows)
    own = field.information_sums(rows, f, key="source")
    none = field.Sums(0 * own["station"].a, 0 * own["station"].b)
    sums = {"station": own["station"], "prior": none, "prior_satellite": own["satellite"], "both": own["station"] + own["satellite"]}
    stations = rows.filter("source = 'station'").withColumn("case", F.explode(F.array(*[F.lit(c) for c in sums])))
    out = field.predict(stations, {c: field.fit(s, f) for c, s in sums.items()}, key="case", noise=0.3)
    return rounded(metrics.evaluate(out, "value", by=["case"]).select("case", "n", "rmse", "mae", "crps", "coverage_90"), 4)


@query()
def field_export(spark, sf_dir: str) -> DataFrame:
    """The fitted field on every cell and day in the target's units, with bounds and the observations there."""
    rows = scaled_long(spark, sf_dir)
    f = inducing(rows)
    post = field.fit(field.information_sums(rows, f)[""], f)
    days = rows.select("day", "t").filter("day is not null").distinct()
    grid = spatial.space_time_frame(dealt(map_cells(spark, sf_dir), "grid_id"), days)
    out = field.exported(field.predict(grid, post), 50.0, 100.0).select("grid_id", "day", "mean", "std", "lower_95", "upper_95")
    seen = rows.groupBy("grid_id", "day").agg(*[F.first(F.when(F.col("source") == k, 50.0 + 100.0 * F.col("value")), True).alias(k) for k in ("station", "satellite")])
    return rounded(daily.attach_observations(out, seen, ["station", "satellite"], ("grid_id", "day")), 4)


def _day_states(rows: DataFrame) -> field.DayStates:
    f = field.Field(field.even_points(rows, 24, 1))
    return field.sequential_filter(rows, f, sorted(r[0] for r in rows.select("day").distinct().collect()))


def _day_grid(long: DataFrame, days: DataFrame) -> DataFrame:
    return long.select("grid_id", "x", "y", "prior").distinct().crossJoin(F.broadcast(days))


@query()
def day_maps(spark, sf_dir: str) -> DataFrame:
    """Day-by-day fusion: filtered and smoothed mean and std of every cell on every day with data."""
    long = scaled_long(spark, sf_dir)
    rows = long.filter("source = 'station'")
    states = _day_states(rows)
    out = field.predict_states(_day_grid(long, rows.select("day").distinct()), states, smoothed=field.smooth_states(states))
    return rounded(out.select("grid_id", "day", "mean", "std", "n_obs", "smooth_mean", "smooth_std"), 4)


@query()
def kept_day_maps(spark, sf_dir: str) -> DataFrame:
    """The day maps from states kept in a table, to which the days come in three parts, each between the others' days."""
    long = scaled_long(spark, sf_dir)
    rows = long.filter("source = 'station'")
    f, path = field.Field(field.even_points(rows, 24, 1)), f"{shared_folder(spark)}/kept-days-{uuid.uuid4().hex}"
    for part in (2, 0, 1):
        states = field.add_days(rows.filter(F.pmod("day", F.lit(3)) == part), path, f)
    out = field.predict_states(_day_grid(long, rows.select("day").distinct()), states)
    return rounded(out.select("grid_id", "day", "mean", "std", "n_obs"), 4)


@query()
def day_likelihood(spark, sf_dir: str) -> DataFrame:
    """Log-likelihood of the stations' days under the day states, for several decay lengths."""
    rows = scaled_long(spark, sf_dir).filter("source = 'station'")
    f = field.Field(field.even_points(rows, 24, 1))
    days = sorted(r[0] for r in rows.select("day").distinct().collect())
    table = []
    for length in (1.0, 5.0, 20.0):
        states = field.sequential_filter(rows, f, days, length)
        table.append((length, len(days), int(sum(states.counts)), float(states.log_likelihood)))
    return rounded(spark.createDataFrame(table, "length double, days int, n int, log_likelihood double"), 3)


@query()
def shifted_day_maps(spark, sf_dir: str) -> DataFrame:
    """Maps of the first ten days, moved by the stations' residual biases spread over the cells, bounds included."""
    long = scaled_long(spark, sf_dir)
    rows = long.filter("source = 'station'")
    states = _day_states(rows)
    anchors = calibrate.residual_bias(field.predict_states(rows, states), "value", by=["grid_id", "x", "y"])
    anchors = anchors.select(F.col("grid_id").alias("ord"), F.col("x").alias("latitude"), F.col("y").alias("longitude"), F.col("bias").alias("value"))
    anchors = written(anchors, "field-anchors")
    cells = long.select("grid_id", F.col("x").alias("latitude"), F.col("y").alias("longitude")).distinct()
    shift = spatial.idw(cells, anchors, "grid_id", default=0.0).select("grid_id", F.col("value").alias("bias"))
    days = rows.select("day").distinct().orderBy("day").limit(10)
    maps = field.exported(field.predict_states(_day_grid(long, days), states), 0.0, 1.0)
    out = calibrate.shifted(maps.join(shift, "grid_id"), "bias")
    return rounded(field.exported(out, 50.0, 100.0, ()).select("grid_id", "day", "mean", "std", (50.0 + 100.0 * F.col("lower_95")).alias("lower_95"), (50.0 + 100.0 * F.col("upper_95")).alias("upper_95")), 4)


@query(roles("predictions") + """, b AS (SELECT station, avg(y - mean) AS bias FROM predictions GROUP BY station)
    SELECT id, round(mean + bias, 6) AS mean, round(mean - 1.959963984540054e0 * std + bias, 6) AS lower_95, round(mean + 1.959963984540054e0 * std + bias, 6) AS upper_95 FROM predictions JOIN b USING (station)""")
def shifted_bounds(spark, sf_dir: str) -> DataFrame:
    """Predictions and bounds moved by their station's mean residual."""
    df = R.predictions(spark, sf_dir)
    bias = calibrate.residual_bias(df, by=["station"]).select("station", "bias")
    out = calibrate.shifted(field.exported(df.select("id", "station", "mean", "std")).join(bias, "station"), "bias")
    return rounded(out.select("id", "mean", "lower_95", "upper_95"))


@query(roles("daily", "priors") + """, d AS (SELECT grid_id, date, station, lur FROM daily JOIN priors USING (grid_id)), f AS (SELECT regr_slope(station, lur) AS a, regr_intercept(station, lur) AS b FROM d)
    SELECT grid_id, date, round(a * lur + b, 4) AS prior_scaled FROM d, f""", date="date")
def scaled_prior(spark, sf_dir: str) -> DataFrame:
    df = daily_sparse(spark, sf_dir).join(R.priors(spark, sf_dir), "grid_id")
    return rounded(calibrate.scaled_prior(df, "station", "lur").select("grid_id", "date", "prior_scaled"), 4)


@query()
def kriged_day(spark, sf_dir: str) -> DataFrame:
    """Regression-kriging of the day with most stations over all cells, with readings or without."""
    rows = scaled_long(spark, sf_dir).filter("source = 'station'").withColumn("baseline", F.col("prior"))
    day = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("day", F.struct(F.col("n"), -F.col("day")))).first()[0]
    grid = map_cells(spark, sf_dir).withColumnRenamed("prior", "baseline")
    f = field.Field(field.regular_points(2, 1), space=0.2)
    return rounded(field.regression_kriging(rows.filter(F.col("day") == day), grid, f, noise=0.3), 4)


def _unit(tag: str) -> str:
    """The draws' uniform numbers: md5 of id, tagged index and seed."""
    return f"(('0x' || substr(md5(id || '|{tag}' || i || '|1'), 1, 8))::UBIGINT / 4294967296e0 + 1.1641532182693481e-10)"


@query(roles("predictions") + f""", k AS (SELECT *, row_number() OVER () AS k FROM predictions), d AS (SELECT k, source, y, i, mean + std * sqrt(-2 * ln({_unit('a')})) * cos(2 * pi() * {_unit('b')}) AS x FROM k, range(1, 17) t(i)),
    a AS (SELECT k, source, avg(abs(x - y)) AS near FROM d GROUP BY k, source), h AS (SELECT p.k, avg(abs(p.x - q.x)) AS apart FROM d p JOIN d q ON p.k = q.k AND q.i = p.i + 8 WHERE p.i <= 8 GROUP BY p.k)
    SELECT source, round(avg(near - 0.5e0 * apart), 4) AS energy FROM a JOIN h USING (k) GROUP BY source""")
def sampled_energy(spark, sf_dir: str) -> DataFrame:
    """Energy score of marginal draws of every prediction, by source."""
    df = field.samples(R.predictions(spark, sf_dir).select("id", "source", "y", "mean", "std"), ["id"], 16)
    return rounded(df.groupBy("source").agg(F.avg(metrics.energy_score("samples", F.col("y"))).alias("energy")), 4)


def _solve2(p: str, q: str, r: str, u: str, v: str) -> tuple[str, str]:
    """The solution of the symmetric system p x + q y = u, q x + r y = v as SQL."""
    det = f"({p} * {r} - {q} * {q})"
    return f"(({u} * {r} - {v} * {q}) / {det})", f"(({v} * {p} - {u} * {q}) / {det})"


# The ridge's three equations, the intercept eliminated first: its row is (n + 1, s1, s2 | t).
_RIDGE = """, j AS (SELECT *, station - lur AS res FROM daily JOIN priors USING (grid_id)),
    m AS (SELECT avg(satellite) AS m1, stddev_pop(satellite) AS d1, avg(traffic) AS m2, stddev_pop(traffic) AS d2 FROM j),
    z AS (SELECT grid_id, date, lur, res, coalesce((satellite - m1) / d1, 0) AS z1, coalesce((traffic - m2) / d2, 0) AS z2 FROM j, m),
    s AS (SELECT count(*) + 1e0 AS n, sum(z1) AS s1, sum(z2) AS s2, sum(z1 * z1) + 1 AS q11, sum(z1 * z2) AS q12, sum(z2 * z2) + 1 AS q22, sum(res) AS t, sum(res * z1) AS t1, sum(res * z2) AS t2 FROM z WHERE res IS NOT NULL),
    e AS (SELECT *, q11 - s1 * s1 / n AS p, q12 - s1 * s2 / n AS q, q22 - s2 * s2 / n AS r, t1 - s1 * t / n AS u, t2 - s2 * t / n AS v FROM s),
    w AS (SELECT n, t, s1, s2, {} AS w1, {} AS w2 FROM e), c AS (SELECT w1, w2, (t - s1 * w1 - s2 * w2) / n AS w0 FROM w)""".format(*_solve2("p", "q", "r", "u", "v"))


@query(roles("daily", "priors") + _RIDGE + " SELECT grid_id, date, round(lur + w0 + w1 * least(greatest(z1, -5e0), 5e0) + w2 * least(greatest(z2, -5e0), 5e0), 4) AS corrected FROM z, c", date="date")
def daily_correction(spark, sf_dir: str) -> DataFrame:
    """Prior corrected by a ridge of residuals on standardised covariates."""
    df = daily_sparse(spark, sf_dir).join(R.priors(spark, sf_dir), "grid_id").withColumn("residual", F.col("station") - F.col("lur"))
    coef, scale = calibrate.standardized_ridge(df, df, ["satellite", "traffic"], "residual")
    return rounded(df.select("grid_id", "date", (F.col("lur") + calibrate.apply_ridge(coef, scale)).alias("corrected")), 4)


@query(roles("cells", "hourly", "daily", "priors") + _RIDGE + f""", {STATIONS}, g AS (SELECT DISTINCT grid_id, latitude, longitude FROM z JOIN cells USING (grid_id)),
    k AS (SELECT s.station, arg_min(g.grid_id, (sqrt((g.latitude - s.latitude) ** 2 + (g.longitude - s.longitude) ** 2), g.grid_id)) AS near_id FROM stations s, g GROUP BY s.station),
    days AS (SELECT DISTINCT date FROM z), f AS (SELECT station, near_id, DATE '2023-12-25' + 7 * (i::INT) AS date FROM k, range(6) t(i)),
    nd AS (SELECT f.date, arg_min(days.date, (abs(date_diff('day', f.date, days.date)), days.date)) AS nearest_day FROM (SELECT DISTINCT date FROM f) f, days GROUP BY f.date)
    SELECT station, f.date, near_id, nearest_day::VARCHAR AS nearest_day, round(CASE WHEN z1 IS NULL THEN 0 ELSE w0 + w1 * least(greatest(z1, -5e0), 5e0) + w2 * least(greatest(z2, -5e0), 5e0) END, 4) AS correction
    FROM f JOIN nd USING (date) CROSS JOIN c LEFT JOIN z ON z.grid_id = near_id AND z.date = nearest_day""", date="date")
def correction_at_stations(spark, sf_dir: str) -> DataFrame:
    """The correction at places off the grid on weekly days, some outside the data: nearest cell, nearest day."""
    df = daily_sparse(spark, sf_dir).join(R.priors(spark, sf_dir), "grid_id").join(R.cells(spark, sf_dir), "grid_id").withColumn("residual", F.col("station") - F.col("lur"))
    df = written(df, "correction-days")
    coef, scale = calibrate.standardized_ridge(df, df, ["satellite", "traffic"], "residual")
    weeks = F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.date_add(F.lit("2023-12-25").cast("date"), 7 * i)))
    places = station_points(spark, sf_dir).select("station", "latitude", "longitude", weeks.alias("date"))
    out = calibrate.correction_at(places, df, coef, scale, "station", (0.001, 0.0015))
    return rounded(out.select("station", "date", "near_id", F.col("nearest_day").cast("string").alias("nearest_day"), "correction"), 4)


@query(roles("daily", "priors") + """, d AS (SELECT grid_id, date, station, lur, satellite FROM daily JOIN priors USING (grid_id)), m AS (SELECT avg(satellite) AS m FROM d WHERE station IS NOT NULL),
    x AS (SELECT d.*, coalesce(satellite, m) AS s FROM d, m), f AS (SELECT covar_pop(lur, lur) AS p, covar_pop(lur, s) AS q, covar_pop(s, s) AS r, covar_pop(lur, station) AS u, covar_pop(s, station) AS v, avg(lur) AS ml, avg(s) AS ms, avg(station) AS my FROM x WHERE station IS NOT NULL),
    w AS (SELECT """ + "{} AS w1, {} AS w2".format(*_solve2("p", "q", "r", "u", "v")) + """, ml, ms, my FROM f)
    SELECT grid_id, date, round(my + w1 * (lur - ml) + w2 * (s - ms), 4) AS predicted FROM x, w""", date="date")
def regression_on_sources(spark, sf_dir: str) -> DataFrame:
    """Least-squares prediction of the stations by prior and satellite."""
    df = daily_sparse(spark, sf_dir).join(R.priors(spark, sf_dir), "grid_id")
    means = df.filter("station is not null").agg(F.avg("satellite").alias("m"))
    w = calibrate.fit_linear(df, ["lur", "satellite"], "station")
    pred = float(w[0]) + float(w[1]) * F.col("lur") + float(w[2]) * F.coalesce("satellite", "m")
    return rounded(df.crossJoin(F.broadcast(means)).select("grid_id", "date", pred.alias("predicted")), 4)


@query(date="date")
def regression_features(spark, sf_dir: str) -> DataFrame:
    """Least-squares prediction of the stations by coordinates, prior and satellite."""
    df = daily_sparse(spark, sf_dir).join(R.cells(spark, sf_dir), "grid_id").join(R.priors(spark, sf_dir), "grid_id")
    df = df.withColumn("u", F.col("latitude") - 53.25).withColumn("v", F.col("longitude") + 6.45)
    means = df.filter("station is not null").agg(F.avg("satellite").alias("m"))
    w = calibrate.fit_linear(df, ["u", "v", "lur", "satellite"], "station")
    out = df.crossJoin(F.broadcast(means))
    pred = sum((float(a) * c for a, c in zip(w[1:], [F.col("u"), F.col("v"), F.col("lur"), F.coalesce("satellite", "m")])), F.lit(float(w[0])))
    return rounded(out.select("grid_id", "date", pred.alias("predicted")), 4)


@query(roles("hourly") + " SELECT grid_id, ts::DATE AS date, kind AS source, round(avg(value), 6) AS value, count(*) AS n FROM hourly WHERE kind IS NOT NULL GROUP BY ALL", date="date")
def streamed_daily_mean(spark, sf_dir: str) -> DataFrame:
    """The readings of all sources replayed as a stream: daily means equal to the batch ones."""
    from ..streaming.daily import replayed, streaming_daily_mean

    r, c = R._row_col(F.col("user_id") * 10)
    kind = F.create_map(*[F.lit(x) for k, v in R.KINDS.items() for x in (v, k)])
    schema = R.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).filter(F.col("event_type").isin(list(R.KINDS.values())))
    stream = stream.select(R.grid_id(r, c).alias("grid_id"), "ts", kind[F.col("event_type")].alias("source"), "value")
    return rounded(replayed(streaming_daily_mean(stream), ["grid_id", "date", "source"], "daily-means"))


def streamed_cell_filter(spark, sf_dir: str) -> DataFrame:
    """The daily rows replayed as a stream, in no order, through the filter with kept state: equal to the batch filter."""
    from ..streaming.daily import close_stream, replayed, streaming_filter

    rows = written(day_rows(spark, sf_dir).repartition("day"), "stream-days")
    folder = rows.inputFiles()[0].rsplit("/", 1)[0]
    close_stream(rows, folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    return rounded(replayed(streaming_filter(stream), ["grid_id", "day"], "cell-filter", mode="append"))


query(ORACLES["cell_filter"])(streamed_cell_filter)
