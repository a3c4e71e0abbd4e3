"""Queries of sources, cleaning, the daily table and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibrate, clean, covariates, daily, report, scaling
from ..operators.metrics import point_metrics
from ..sources import roles as R
from ..sources import tables
from .registry import hash_sql, query, roles, rounded

KINDS = ("station", "satellite", "traffic")


def daily_sources(spark, sf_dir: str) -> dict[str, DataFrame]:
    return {k: daily.daily_mean(R.hourly(spark, sf_dir, k), k) for k in KINDS}


def daily_sparse(spark, sf_dir: str) -> DataFrame:
    """grid_id, date, station, satellite, traffic: one pass over the readings."""
    kind = F.create_map(*[F.lit(x) for k, v in R.KINDS.items() for x in (v, k)])
    r, c = R._row_col(F.col("user_id") * 10)
    rows = R.table(spark, sf_dir, "events").filter(F.col("event_type").isin(list(R.KINDS.values())))
    rows = rows.select(R.grid_id(r, c).alias("grid_id"), F.to_date("ts").alias("date"), "value", kind[F.col("event_type")].alias("kind"))
    return rows.groupBy("grid_id", "date").agg(*[F.avg(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in KINDS])


@query(roles("hourly") + """, m AS (SELECT grid_id, ts::DATE AS date, kind, avg(value) AS v FROM hourly WHERE hour(ts) BETWEEN 11 AND 14 GROUP BY ALL),
    j AS (SELECT a.grid_id, a.date, a.v AS station, b.v AS satellite, p.lur AS prior FROM m a
          LEFT JOIN m b ON a.grid_id = b.grid_id AND a.date = b.date AND b.kind = 'satellite'
          LEFT JOIN (""" + """SELECT concat_ws('_', c_custkey // 120, c_custkey % 120) AS grid_id, c_acctbal / 100e0 AS lur FROM customer) p ON a.grid_id = p.grid_id
          WHERE a.kind = 'station'),
    c AS (SELECT count(*) AS n, regr_slope(station, satellite) AS a, regr_intercept(station, satellite) AS b FROM j WHERE satellite IS NOT NULL),
    l AS (SELECT station AS y, prior AS p, 'prior' AS model FROM j UNION ALL
          SELECT station, CASE WHEN n < 10 OR a IS NULL THEN satellite ELSE a * satellite + b END, 'satellite' FROM j, c)
    SELECT model, count(*) AS n, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(avg(p - y), 6) + 0e0 AS bias
    FROM l WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY model""")
def source_match(spark, sf_dir: str) -> DataFrame:
    """How well the static prior and the calibrated satellite match the stations."""
    means = {k: daily.daily_mean(clean.in_hours(R.hourly(spark, sf_dir, k), 11, 14), k) for k in ("station", "satellite")}
    rows = means["station"].join(means["satellite"], ["grid_id", "date"], "left").join(R.priors(spark, sf_dir).select("grid_id", F.col("lur").alias("prior")), "grid_id", "left")
    rows = calibrate.apply_calibration(rows, calibrate.linear_calibration(rows, "satellite", "station"), "satellite", "calibrated")
    long = rows.select("station", "prior", F.col("calibrated").alias("satellite")).unpivot("station", ["prior", "satellite"], "model", "p").filter("station is not null and p is not null")
    return rounded(long.groupBy("model").agg(*point_metrics(F.col("station"), F.col("p"))).select("model", "n", "rmse", "mae", "bias"))


@query(roles("cells", "daily") + """ SELECT source, n_valid, n_rows, n_cells, n_times, round(100e0 * n_valid / n_rows, 6) AS pct_valid FROM
    (SELECT count(*) AS n_rows, count(DISTINCT grid_id) AS n_cells, count(DISTINCT date) AS n_times, count(station) AS station, count(satellite) AS satellite, count(traffic) AS traffic FROM daily)
    UNPIVOT (n_valid FOR source IN (station, satellite, traffic))""")
def dataset_summary(spark, sf_dir: str) -> DataFrame:
    df = daily_sparse(spark, sf_dir).withColumn("ts", F.col("date"))
    return rounded(tables.summary(df, list(KINDS)).select("source", "n_valid", "n_rows", "n_cells", "n_times", "pct_valid"))


@query(roles("cells") + """, v AS (SELECT latitude, longitude, c_acctbal FROM cells JOIN customer ON grid_id = concat_ws('_', c_custkey // 120, c_custkey % 120))
    SELECT round(min(latitude), 6) AS min_lat, round(max(latitude), 6) AS max_lat, round(min(longitude), 6) AS min_lon, round(max(longitude), 6) AS max_lon, count(c_acctbal) AS n_valid,
           min(latitude) >= -90 AND max(latitude) <= 90 AND min(longitude) >= -180 AND max(longitude) <= 180 AND count(c_acctbal) > 0 AS ok FROM v""")
def validation(spark, sf_dir: str) -> DataFrame:
    raw = R.cells(spark, sf_dir).join(R.priors(spark, sf_dir), "grid_id").withColumn("timestamp", F.lit("2024-01-01"))
    mapped = tables.map_source(raw, tables.Mapping(sources={"prior": "lur", "other": "absent"}))
    return rounded(tables.validation_report(tables.drop_invalid_keys(mapped), ["prior", "other"]))


@query("SELECT trim(concat(' ', user_id, ' ')) AS grid_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value > 1 AND ts IS NOT NULL GROUP BY user_id")
def clean_readings(spark, sf_dir: str) -> DataFrame:
    """Trimmed ids, text values coerced, rows without keys or with values not above 0 dropped."""
    raw = R.table(spark, sf_dir, "events").select(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")).alias("grid_id"), "ts", F.when(F.col("value") > 1, F.col("value").cast("string")).otherwise("n/a").alias("value"))
    return rounded(clean.clean_readings(raw, positive=True).groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


@query(roles("hourly") + """, w AS (SELECT greatest(trunc(quantile_cont(hour(ts), 0.01))::INT - 1, 0) AS a, least(trunc(quantile_cont(hour(ts), 0.99))::INT + 1, 23) AS b FROM hourly WHERE kind = 'satellite')
    SELECT a AS start_hour, b AS end_hour, count(*) AS n_station, round(avg(value), 6) AS mean_value FROM hourly, w WHERE kind = 'station' AND hour(ts) BETWEEN a AND b GROUP BY a, b""")
def overpass(spark, sf_dir: str) -> DataFrame:
    window = clean.overpass_window(R.hourly(spark, sf_dir, "satellite"))
    kept = clean.in_hours(R.hourly(spark, sf_dir, "station"), window=window)
    return rounded(kept.agg(F.count(F.lit(1)).alias("n_station"), F.avg("value").alias("mean_value")).crossJoin(F.broadcast(window)).select("start_hour", "end_hour", "n_station", "mean_value"))


@query(roles("hourly") + """, s AS (SELECT count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.5) AS med FROM hourly WHERE kind = 'station'),
    d AS (SELECT quantile_cont(abs(value - med), 0.5) AS mad FROM hourly, s WHERE kind = 'station'),
    f AS (SELECT grid_id, value, n >= 20 AND q3 > q1 AND (value < q1 - 0.2e0 * (q3 - q1) OR value > q3 + 0.2e0 * (q3 - q1)) AS iqr,
                 n >= 20 AND mad > 0 AND (value < med - 1.2e0 * mad / 0.6745e0 OR value > med + 1.2e0 * mad / 0.6745e0) AS rob,
                 least(greatest(value, q1 - 0.2e0 * (q3 - q1)), q3 + 0.2e0 * (q3 - q1)) AS clipped FROM hourly, s, d WHERE kind = 'station')
    SELECT grid_id, count(*) AS n, count(*) FILTER (iqr) AS n_iqr, count(*) FILTER (rob) AS n_robust, round(avg(clipped), 6) AS clipped_mean, round(avg(CASE WHEN NOT iqr THEN value END), 6) AS blanked_mean FROM f GROUP BY grid_id""")
def outliers(spark, sf_dir: str) -> DataFrame:
    """IQR and robust flags, clipping and blanking; narrow bounds, so that the test data has outliers."""
    df = R.hourly(spark, sf_dir, "station")
    iqr, robust = clean.outlier_bounds(df, "value", "iqr", k=0.2), clean.outlier_bounds(df, "value", "robust", threshold=1.2)
    out = clean.treat_outliers(df, "value", iqr, "flag").withColumnRenamed("is_outlier", "iqr")
    out = clean.treat_outliers(out, "value", robust, "flag").withColumn("clipped", F.col("value")).withColumn("blanked", F.col("value"))
    out = clean.treat_outliers(clean.treat_outliers(out, "clipped", iqr, "clip"), "blanked", iqr, "nan")
    return rounded(out.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("iqr").alias("n_iqr"), F.count_if("is_outlier").alias("n_robust"), F.avg("clipped").alias("clipped_mean"), F.avg("blanked").alias("blanked_mean")))


@query(roles("hourly") + " SELECT grid_id, count(*) AS n, count(CASE WHEN value BETWEEN 0 AND 100 THEN value END) AS n_valid, round(avg(CASE WHEN value BETWEEN 0 AND 100 THEN value END), 6) AS mean_valid FROM hourly WHERE kind = 'station' GROUP BY grid_id")
def physical_range(spark, sf_dir: str) -> DataFrame:
    df = R.hourly(spark, sf_dir, "station").withColumn("v", clean.within(F.col("value"), 0, 100))
    return rounded(df.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"), F.avg("v").alias("mean_valid")))


@query(roles("daily") + " SELECT grid_id, date, round(station, 6) AS station, round(satellite, 6) AS satellite, round(traffic, 6) AS traffic FROM daily", date="date")
def daily_means(spark, sf_dir: str) -> DataFrame:
    return rounded(daily.sparse_merge(daily_sources(spark, sf_dir)))


@query(roles("cells", "daily", "priors") + """, frame AS (SELECT grid_id, date FROM cells, (SELECT DISTINCT date FROM daily) d)
    SELECT f.grid_id, count(*) AS n_days, count(station) AS n_station, count(satellite) AS n_satellite, round(sum(coalesce(traffic, 0)), 6) AS traffic,
           round(any_value(coalesce(atmo, lur)), 6) AS prior, any_value(CASE WHEN atmo IS NOT NULL THEN 'atmo' WHEN lur IS NOT NULL THEN 'lur' END) AS prior_source
    FROM frame f LEFT JOIN daily d ON f.grid_id = d.grid_id AND f.date = d.date LEFT JOIN priors p ON f.grid_id = p.grid_id GROUP BY f.grid_id""")
def dense_frame(spark, sf_dir: str) -> DataFrame:
    """All cells on all dates, sources and priors joined, summed up by cell."""
    sources = daily_sources(spark, sf_dir)
    cells = daily.choose_prior(R.cells(spark, sf_dir), R.priors(spark, sf_dir))
    frame = daily.cell_frame(cells, daily.date_union(list(sources.values())))
    merged = daily.merge_daily(frame, {k: sources[k] for k in ("satellite", "traffic", "station")})
    return rounded(merged.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n_days"), F.count("station").alias("n_station"), F.count("satellite").alias("n_satellite"), F.sum("traffic").alias("traffic"), F.first("prior").alias("prior"), F.first("prior_source").alias("prior_source")))


@query(roles("hourly") + " SELECT grid_id, ts::DATE AS date, round(avg(value), 6) AS value, strftime(min(ts), '%H:%M:%S') AS first_seen FROM hourly WHERE kind = 'traffic' GROUP BY ALL", date="date")
def hourly_first(spark, sf_dir: str) -> DataFrame:
    df = R.hourly(spark, sf_dir, "traffic").withColumn("first_seen", F.date_format("ts", "HH:mm:ss"))
    return rounded(daily.hourly_to_daily(df, ["value"], ["first_seen"]))


@query(roles("daily") + """, l AS (SELECT grid_id, date, 'satellite' AS source, satellite AS x, station AS y FROM daily UNION ALL SELECT grid_id, date, 'traffic', traffic, station FROM daily),
    s AS (SELECT source, count(*) AS n, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, regr_r2(y, x) AS r, avg(x) AS mean_x, avg(y) AS mean_y FROM l WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY source)
    SELECT source, n, round(CASE WHEN n < 10 OR a IS NULL THEN 1 ELSE a END, 6) AS slope, round(CASE WHEN n < 10 OR a IS NULL THEN 0 ELSE b END, 6) AS intercept,
           round(CASE WHEN n >= 10 THEN r END, 6) AS r2, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y FROM s""")
def calibration(spark, sf_dir: str) -> DataFrame:
    long = daily_sparse(spark, sf_dir).unpivot(["grid_id", "date", "station"], ["satellite", "traffic"], "source", "x")
    return rounded(calibrate.linear_calibration(long, "x", "station", by=["source"]))


@query(roles("hourly", "priors") + """, t AS (SELECT * EXCLUDE (c), row_number() OVER (PARTITION BY date, v ORDER BY grid_id, ts, value) AS k FROM
        (SELECT grid_id, ts, value, ts::DATE AS date, round_even(value, 0) AS v, 1 AS c FROM hourly WHERE kind = 'satellite'))
    SELECT date, count(*) AS n_before, count(*) FILTER (k <= 1) AS n_one, count(*) FILTER (k <= 2) AS n_two, round(sum(CASE WHEN k <= 1 THEN value END), 6) AS sum_one FROM t GROUP BY date""", date="date")
def thin_repeats(spark, sf_dir: str) -> DataFrame:
    df = R.hourly(spark, sf_dir, "satellite").withColumn("date", F.to_date("ts"))
    order = ("grid_id", "ts", "value")
    one = calibrate.thin_repeats(df, "value", keep=1, digits=0, order=order).groupBy("date").agg(F.count(F.lit(1)).alias("n_one"), F.sum("value").alias("sum_one"))
    two = calibrate.thin_repeats(df, "value", keep=2, digits=0, order=order).groupBy("date").agg(F.count(F.lit(1)).alias("n_two"))
    return rounded(df.groupBy("date").agg(F.count(F.lit(1)).alias("n_before")).join(one, "date").join(two, "date").select("date", "n_before", "n_one", "n_two", "sum_one"))


@query(roles("daily") + """, z AS (SELECT grid_id, date, ln(1 + traffic) AS v FROM daily WHERE traffic IS NOT NULL)
    SELECT grid_id, date, round((v - avg(v) OVER w) / coalesce(nullif(stddev_samp(v) OVER w, 0), 1), 6) AS anomaly FROM z WINDOW w AS (PARTITION BY grid_id)""", date="date")
def traffic_anomaly(spark, sf_dir: str) -> DataFrame:
    df = daily_sparse(spark, sf_dir).filter("traffic is not null")
    return rounded(calibrate.location_anomaly(df, "traffic").select("grid_id", "date", "anomaly"))


@query(roles("hourly") + f""", h AS (SELECT *, {hash_sql(7, "grid_id", "ts", "value")} AS h FROM hourly WHERE kind = 'satellite'),
    k AS (SELECT *, row_number() OVER (ORDER BY h, grid_id, ts, value) AS i, count(*) OVER () AS n FROM h)
    SELECT grid_id, count(*) FILTER (i <= greatest(1, trunc(n * 0.3e0))) AS n_exact, count(*) FILTER (h < 0.3e0) AS n_rate FROM k GROUP BY grid_id""")
def source_sample(spark, sf_dir: str) -> DataFrame:
    df, keys = R.hourly(spark, sf_dir, "satellite"), ["grid_id", "ts", "value"]
    exact = calibrate.exact_sample(df, keys, 7, fraction=0.3).groupBy("grid_id").agg(F.count(F.lit(1)).alias("n_exact"))
    rate = calibrate.rate_sample(df, keys, 7, 0.3).groupBy("grid_id").agg(F.count(F.lit(1)).alias("n_rate"))
    out = df.select("grid_id").distinct().join(exact, "grid_id", "left").join(rate, "grid_id", "left")
    return out.select("grid_id", F.coalesce("n_exact", F.lit(0)).alias("n_exact"), F.coalesce("n_rate", F.lit(0)).alias("n_rate"))


@query(roles("cells", "daily") + """, j AS (SELECT latitude, longitude, date_diff('day', DATE '2024-01-01', date)::DOUBLE AS day, station, satellite FROM daily JOIN cells USING (grid_id))
    SELECT round(min(latitude), 6) AS lat_min, round(min(longitude), 6) AS lon_min, round(min(day), 6) AS day_min, round(greatest(max(latitude) - min(latitude), max(longitude) - min(longitude)), 6) AS scale,
           round(max(day) - min(day), 6) AS day_range, round(avg(station), 6) AS station_mean, round(stddev_pop(station), 6) AS station_std, round(avg(satellite), 6) AS satellite_mean, round(stddev_pop(satellite), 6) AS satellite_std FROM j""")
def fitted_scalers(spark, sf_dir: str) -> DataFrame:
    df = daily_sparse(spark, sf_dir).join(R.cells(spark, sf_dir), "grid_id").withColumn("day", F.datediff("date", F.lit("2024-01-01").cast("date")).cast("double"))
    return rounded(scaling.scaler_table(df, ["station", "satellite"]))


@query(roles("cells", "daily") + """, j AS (SELECT grid_id, date, latitude, longitude, station FROM daily JOIN cells USING (grid_id) WHERE station IS NOT NULL),
    s AS (SELECT min(latitude) AS a, min(longitude) AS b, greatest(max(latitude) - min(latitude), max(longitude) - min(longitude)) AS w, avg(station) AS m, stddev_pop(station) AS sd FROM j)
    SELECT grid_id, date, round((latitude - a) / w, 6) AS x, round((longitude - b) / w, 6) AS y, round((station - m) / sd, 6) AS z, round(station, 6) AS back FROM j, s""", date="date")
def scaled_rows(spark, sf_dir: str) -> DataFrame:
    df = daily_sparse(spark, sf_dir).filter("station is not null").join(R.cells(spark, sf_dir), "grid_id").withColumn("day", F.datediff("date", F.lit("2024-01-01").cast("date")).cast("double"))
    s = scaling.fit_scalers(df, ["station"])
    x, y = s.coords()
    return rounded(df.select("grid_id", "date", x.alias("x"), y.alias("y"), s.target("station").alias("z"), s.untarget(s.target("station"), "station").alias("back")))


@query(roles("priors") + """, s AS (SELECT min(lur) AS a, max(lur) AS b, min(atmo) AS c, max(atmo) AS d FROM priors)
    SELECT grid_id, round((lur - a) / (b - a), 6) AS lur, round(1 - (atmo - c) / (d - c), 6) AS atmo, CASE WHEN lur IS NOT NULL THEN 0e0 END AS constant FROM priors, s""")
def min_max_scaled(spark, sf_dir: str) -> DataFrame:
    df = R.priors(spark, sf_dir).withColumn("constant", F.lit(4.0))
    return rounded(scaling.min_max(df, ["lur", "atmo", "constant"], ("atmo",)))


@query(roles("daily", "priors") + """, j AS (SELECT grid_id, date, station, satellite, lur FROM daily LEFT JOIN priors USING (grid_id)),
    l AS (SELECT grid_id, date, lur, 'station' AS source, station AS value FROM j UNION ALL SELECT grid_id, date, lur, 'satellite', satellite FROM j UNION ALL SELECT grid_id, date, lur, 'lur', lur FROM j)
    SELECT grid_id, date, source, round(lur, 6) AS lur, round(value, 6) AS value FROM l WHERE value IS NOT NULL""", date="date")
def long_export(spark, sf_dir: str) -> DataFrame:
    df = daily_sparse(spark, sf_dir).join(R.priors(spark, sf_dir), "grid_id", "left")
    return rounded(daily.long_export(df, ["station", "satellite"], ["grid_id", "date"], "lur"))


@query(roles("daily") + f""", c AS (SELECT DISTINCT grid_id FROM daily WHERE station IS NOT NULL), k AS (SELECT grid_id, row_number() OVER (ORDER BY {hash_sql(3, "grid_id")}, grid_id) - 1 AS p, count(*) OVER () AS n FROM c),
    h AS (SELECT grid_id FROM k WHERE p < least(greatest(floor(n * 0.2e0), 1), n - 1))
    SELECT grid_id, date, round(CASE WHEN h.grid_id IS NULL THEN station END, 6) AS station, round(satellite, 6) AS satellite FROM daily LEFT JOIN h USING (grid_id) WHERE station IS NOT NULL OR satellite IS NOT NULL""", date="date")
def masked_training(spark, sf_dir: str) -> DataFrame:
    """Rows with a station or satellite value, stations blanked at held-out cells."""
    from ..operators.splits import holdout_cells

    df = clean.keep_sources(daily_sparse(spark, sf_dir), ["station", "satellite"], ["traffic"])
    return rounded(clean.blank_held_out(df, "station", holdout_cells(df, "station", seed=3), ["grid_id"]).select("grid_id", "date", "station", "satellite"))


@query(roles("daily") + """, d AS (SELECT DISTINCT date FROM daily), p AS (SELECT date FROM d ORDER BY abs(date_diff('day', DATE '2024-01-11', date)), date LIMIT 1)
    SELECT grid_id, date, round(station, 6) AS station FROM daily WHERE station IS NOT NULL AND date IN (SELECT date FROM p)""", date="date")
def closest_day(spark, sf_dir: str) -> DataFrame:
    df = daily_sparse(spark, sf_dir).withColumn("day", F.datediff("date", F.lit("2024-01-01").cast("date")))
    return rounded(clean.closest_day(df, "day", 10).filter("station is not null").select("grid_id", "date", "station"))


@query(roles("predictions") + """, q AS (SELECT quantile_cont(mean, 0.02) AS mean_p2, quantile_cont(mean, 0.5) AS mean_p50, quantile_cont(mean, 0.98) AS mean_p98, quantile_cont(std, 0.5) AS std_p50, quantile_cont(std, 0.98) AS std_p98 FROM predictions)
    SELECT round(mean_p2, 6) AS mean_p2, round(mean_p50, 6) AS mean_p50, round(mean_p98, 6) AS mean_p98, round(std_p50, 6) AS std_p50, round(std_p98, 6) AS std_p98,
           mean_p2 >= -20 AND mean_p50 BETWEEN 0 AND 50 AND mean_p98 <= 200 AND std_p98 <= 100 AS plausible FROM q""")
def plausibility(spark, sf_dir: str) -> DataFrame:
    return rounded(clean.plausibility(R.predictions(spark, sf_dir)))


@query(roles("daily", "priors") + """, j AS (SELECT grid_id, date, satellite, lur FROM daily LEFT JOIN priors USING (grid_id)), d AS (SELECT DISTINCT date FROM j ORDER BY date LIMIT 10),
    m AS (SELECT grid_id, avg(lur) AS p, avg(satellite) AS s FROM j WHERE date IN (SELECT date FROM d) GROUP BY grid_id),
    f AS (SELECT regr_slope(p, s) AS a, regr_intercept(p, s) AS b FROM m WHERE p IS NOT NULL AND s IS NOT NULL)
    SELECT grid_id, round(p + coalesce(a * s + b - p, 0), 6) AS prior_corrected, round(coalesce(a * s + b - p, 0), 6) AS shift FROM m, f""")
def pattern_prior(spark, sf_dir: str) -> DataFrame:
    df = daily_sparse(spark, sf_dir).join(R.priors(spark, sf_dir), "grid_id", "left")
    return rounded(calibrate.pattern_prior(df, "lur", "satellite"))


@query(roles("daily") + """ SELECT date, count(station) AS n_station, count(satellite) AS n_satellite, count(traffic) AS n_traffic FROM daily GROUP BY date""", date="date")
def day_counts(spark, sf_dir: str) -> DataFrame:
    return report.day_counts(daily_sparse(spark, sf_dir), list(KINDS))


@query(roles("hourly") + """, s AS (SELECT grid_id, ts::DATE AS date, count(*) AS k FROM hourly WHERE kind = 'station' GROUP BY ALL)
    SELECT count(DISTINCT grid_id) AS n_cells, count(DISTINCT date) AS n_times, count(*) AS n_slots, round(avg(k), 6) AS repeat_mean, round(stddev_pop(k), 6) AS repeat_std, min(k) AS repeat_min, max(k) AS repeat_max,
           round(count(*) / (count(DISTINCT grid_id) * count(DISTINCT date))::DOUBLE, 6) AS coverage, count(*) / (count(DISTINCT grid_id) * count(DISTINCT date))::DOUBLE > 0.5 AS gridded FROM s""")
def grid_profile(spark, sf_dir: str) -> DataFrame:
    return rounded(report.grid_profile(R.hourly(spark, sf_dir, "station").withColumn("date", F.to_date("ts"))))


@query(roles("daily") + """, l AS (SELECT station AS ref, satellite AS value, 'satellite' AS source FROM daily UNION ALL SELECT station, traffic, 'traffic' FROM daily)
    SELECT source, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value - ref), 6) AS mean_difference FROM l WHERE value IS NOT NULL GROUP BY source""")
def source_statistics(spark, sf_dir: str) -> DataFrame:
    return rounded(report.source_statistics(daily_sparse(spark, sf_dir), ["satellite", "traffic"], "station"))


@query(roles("daily") + " SELECT grid_id, count(*) AS n FROM daily WHERE station IS NOT NULL GROUP BY grid_id ORDER BY n DESC, grid_id LIMIT 5")
def top_sites(spark, sf_dir: str) -> DataFrame:
    return report.top_sites(daily_sparse(spark, sf_dir), "station")


@query(roles("hourly") + """, f AS (SELECT grid_id, min(value) FILTER (v = 1) AS value FROM (SELECT grid_id, value, row_number() OVER (PARTITION BY grid_id ORDER BY ts, value) AS v FROM hourly WHERE kind = 'station') GROUP BY grid_id)
    SELECT grid_id, round(value, 6) AS value FROM f""")
def first_reading(spark, sf_dir: str) -> DataFrame:
    return rounded(daily.first_per_key(R.hourly(spark, sf_dir, "station"), ["grid_id"], ["ts", "value"]).select("grid_id", "value"))


def big_daily(spark, sf_dir: str) -> DataFrame:
    li = R.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("grid_id"), F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("source")).agg(F.avg("l_quantity").alias("value"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey AS grid_id, l_shipdate::DATE AS date, l_returnflag AS source, round(avg(l_quantity), 6) AS value, count(*) AS n FROM lineitem GROUP BY ALL", date="date")
def big_daily_mean(spark, sf_dir: str) -> DataFrame:
    """Daily means of the large source."""
    return rounded(big_daily(spark, sf_dir))


@query(roles("daily") + """, d AS (SELECT DISTINCT date FROM daily), w AS (SELECT grid_id, date FROM daily),
    m AS (SELECT avg(satellite) AS m FROM daily) SELECT grid_id, date, round(coalesce(satellite, m), 6) AS satellite FROM daily, m""", date="date")
def filled_covariate(spark, sf_dir: str) -> DataFrame:
    df = daily_sparse(spark, sf_dir)
    return rounded(daily.fill_covariates(df.select("grid_id", "date"), df, ["grid_id", "date"], ["satellite"]).select("grid_id", "date", "satellite"))


def _wind_sql() -> str:
    parts = ", ".join(f"{hash_sql(f'f{k}', 'grid_id', 'date')} AS freq_{k}, 10e0 * {hash_sql(f's{k}', 'grid_id', 'date')} AS speed_{k}" for k in range(8))
    return f"wind AS (SELECT grid_id, date, {parts} FROM daily)"


def _upwind_sql(km: str = "3e0") -> str:
    """Every pair of cells: the plain form of the stencils and of the binned radius join."""
    off = lambda k: f"abs(((ang - {k * 45}e0 + 180e0 + 720e0) % 360e0) - 180e0) <= 22.5e0"
    sums = ", ".join(f"coalesce(sum(CASE WHEN {off(k)} THEN t / (km * km) END), 0) AS upwind_{k}" for k in range(8))
    return f"""t AS (SELECT grid_id, avg(traffic) AS traffic FROM daily GROUP BY grid_id),
    src AS (SELECT c.grid_id, latitude, longitude, CASE WHEN coalesce(traffic, 0) = 0 THEN 1e0 ELSE traffic END AS t FROM cells c LEFT JOIN t USING (grid_id)),
    pr AS (SELECT a.grid_id, (b.longitude - a.longitude) * 111e0 * cos(radians(lm)) AS e, (b.latitude - a.latitude) * 111e0 AS nn, b.t FROM cells a, src b, (SELECT avg(latitude) AS lm FROM (SELECT DISTINCT latitude, longitude FROM cells))),
    pk AS (SELECT *, sqrt(e * e + nn * nn) AS km, (degrees(atan2(e, nn)) + 360e0) % 360e0 AS ang FROM pr),
    up AS (SELECT grid_id, {sums} FROM pk WHERE km > 0 AND km <= {km} GROUP BY grid_id)"""


@query(roles("cells", "daily") + f", {_upwind_sql()} SELECT grid_id, " + ", ".join(f"round(upwind_{k}, 4) AS upwind_{k}" for k in range(8)) + " FROM up")
def upwind_sums(spark, sf_dir: str) -> DataFrame:
    traffic = daily_sparse(spark, sf_dir).groupBy("grid_id").agg(F.avg("traffic").alias("traffic"))
    return rounded(covariates.upwind_on_grid(R.cells(spark, sf_dir), traffic, R.STEP), 4)


@query(roles("cells", "daily") + f", {_upwind_sql('0.5e0')} SELECT grid_id, " + ", ".join(f"round(upwind_{k}, 4) AS upwind_{k}" for k in range(8)) + " FROM up")
def upwind_scattered(spark, sf_dir: str) -> DataFrame:
    """Upwind sums within 0.5 km by pairs, as for places off any grid."""
    traffic = daily_sparse(spark, sf_dir).groupBy("grid_id").agg(F.avg("traffic").alias("traffic"))
    return rounded(covariates.upwind_sums(R.cells(spark, sf_dir), traffic, 0.5), 4)


@query(roles("cells", "daily") + f", {_upwind_sql()}, {_wind_sql()} SELECT grid_id, date, " + ", ".join(f"round(coalesce(upwind_{k}, 0) * freq_{k}, 4) AS traffic_wind_{k}, round(speed_{k} * freq_{k}, 4) AS speed_freq_{k}" for k in range(8)) + " FROM wind LEFT JOIN up USING (grid_id)", date="date")
def wind_weighted(spark, sf_dir: str) -> DataFrame:
    df = daily_sparse(spark, sf_dir)
    traffic = df.groupBy("grid_id").agg(F.avg("traffic").alias("traffic"))
    up = covariates.upwind_on_grid(R.cells(spark, sf_dir), traffic, R.STEP)
    return rounded(covariates.wind_weighted(R.wind(df), up), 4)


@query(roles("cells") + " SELECT grid_id, r, c FROM cells WHERE latitude BETWEEN 53.2515e0 AND 53.2555e0 AND longitude BETWEEN -6.41e0 AND -6.35e0")
def study_area(spark, sf_dir: str) -> DataFrame:
    return clean.in_box(R.cells(spark, sf_dir), (53.2515, 53.2555), (-6.41, -6.35)).select("grid_id", "r", "c")


@query(roles("cells", "daily") + " SELECT (r * 1000 + c)::INT AS cell, date, round(station, 6) AS station FROM daily JOIN cells USING (grid_id) WHERE c < 60 AND station IS NOT NULL", date="date")
def mapped_ids(spark, sf_dir: str) -> DataFrame:
    """Daily stations under integer cell ids; cells outside the map dropped."""
    ids = R.cells(spark, sf_dir).filter("c < 60").select("grid_id", (F.col("r") * 1000 + F.col("c")).cast("int").alias("cell"))
    return rounded(daily.map_ids(daily_sparse(spark, sf_dir).filter("station is not null"), ids).select("cell", "date", "station"))


@query(roles("daily") + f""", h AS (SELECT grid_id, date, station, {hash_sql(42, "grid_id", "date")} AS h FROM daily WHERE station IS NOT NULL), t AS (SELECT grid_id, date, station, NULL::DOUBLE AS z FROM h WHERE h < 0.7e0 UNION ALL SELECT grid_id, date, station, station / 2e0 FROM h WHERE h >= 0.7e0 AND h < 0.85e0)
    SELECT grid_id, count(*) AS n, count(z) AS n_val, round(sum(station), 6) AS total FROM t GROUP BY grid_id""")
def concatenated(spark, sf_dir: str) -> DataFrame:
    """Training and validation rows put below each other, with a column only one of them has."""
    from ..operators.splits import random_split

    df = random_split(daily_sparse(spark, sf_dir).filter("station is not null").select("grid_id", "date", "station"), ["grid_id", "date"])
    train, val = df.filter("split = 'train'"), df.filter("split = 'val'").withColumn("z", F.col("station") / 2)
    return rounded(daily.concat([train, val]).groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), F.count("z").alias("n_val"), F.sum("station").alias("total")))


@query(roles("daily") + """, d AS (SELECT DISTINCT date FROM daily WHERE station IS NOT NULL), j AS (SELECT q.grid_id, q.date, arg_min(p.date, (abs(date_diff('day', q.date, p.date)), p.date)) AS near FROM daily q, d p WHERE q.satellite IS NOT NULL GROUP BY ALL)
    SELECT grid_id, date, near::VARCHAR AS nearest_day FROM j""", date="date")
def nearest_day(spark, sf_dir: str) -> DataFrame:
    """For every satellite row the nearest day with stations, the same day if it has some."""
    df = daily_sparse(spark, sf_dir)
    days = daily.nearest_days(df.filter("satellite is not null"), df.filter("station is not null"))
    out = df.filter("satellite is not null").join(F.broadcast(days) if days.count() <= 100_000 else days, "date")
    return out.select("grid_id", "date", F.col("nearest_day").cast("string"))


@query(roles("cells", "daily", "priors") + """, d AS (SELECT DISTINCT date FROM daily) SELECT c.grid_id, d.date, round(lur, 6) AS mean, round(station, 6) AS station, round(satellite, 6) AS satellite
    FROM cells c CROSS JOIN d JOIN priors p ON p.grid_id = c.grid_id LEFT JOIN daily y ON y.grid_id = c.grid_id AND y.date = d.date""", date="date")
def attached_observations(spark, sf_dir: str) -> DataFrame:
    """Values exported for every cell and day, with the observations of that cell and day beside them."""
    df = daily_sparse(spark, sf_dir)
    grid = daily.cell_frame(R.cells(spark, sf_dir).select("grid_id"), daily.date_union([df])).join(R.priors(spark, sf_dir), "grid_id")
    return rounded(daily.attach_observations(grid.select("grid_id", "date", F.col("lur").alias("mean")), df, ["station", "satellite"]))


@query(roles("cells", "priors") + """, p AS (SELECT c.grid_id, CASE WHEN r % 5 <> 0 THEN lur END AS lur, atmo FROM cells c JOIN priors USING (grid_id)), q AS (SELECT coalesce(atmo, lur) AS prior, CASE WHEN atmo IS NOT NULL THEN 'atmo' WHEN lur IS NOT NULL THEN 'lur' END AS src FROM p)
    SELECT src AS prior_source, count(*) AS n, count(*) FILTER (prior IS NULL) AS n_missing, round(avg(prior), 6) AS mean FROM q GROUP BY src""")
def prior_choice(spark, sf_dir: str) -> DataFrame:
    """The prior's first choice or its fallback, with the cells that have neither."""
    cells = R.cells(spark, sf_dir)
    priors = cells.join(R.priors(spark, sf_dir), "grid_id").select("grid_id", F.when(F.col("r") % 5 != 0, F.col("lur")).alias("lur"), "atmo")
    chosen = daily.choose_prior(cells.select("grid_id"), priors)
    return rounded(chosen.groupBy("prior_source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prior").isNull()).alias("n_missing"), F.avg("prior").alias("mean")))


@query(roles("cells", "priors") + " SELECT count(*) AS n, count(*) FILTER (coalesce(atmo, CASE WHEN r % 5 <> 0 THEN lur END) IS NULL) AS n_missing FROM cells JOIN priors USING (grid_id)")
def prior_gaps(spark, sf_dir: str) -> DataFrame:
    cells = R.cells(spark, sf_dir)
    priors = cells.join(R.priors(spark, sf_dir), "grid_id").select("grid_id", F.when(F.col("r") % 5 != 0, F.col("lur")).alias("lur"), "atmo")
    return daily.missing_count(daily.choose_prior(cells.select("grid_id"), priors))


@query(roles("daily") + ", t AS (SELECT grid_id FROM daily WHERE station IS NOT NULL GROUP BY grid_id ORDER BY count(*) DESC, grid_id LIMIT 5) SELECT grid_id, date, round(station, 6) AS station FROM daily SEMI JOIN t USING (grid_id) WHERE station IS NOT NULL", date="date")
def top_site_rows(spark, sf_dir: str) -> DataFrame:
    """Readings of the sites with most days."""
    df = daily_sparse(spark, sf_dir)
    rows = df.filter("station is not null").select("grid_id", "date", "station")
    return rounded(rows.join(report.top_sites(df, "station").select("grid_id"), "grid_id", "left_semi"))


@query(roles("daily") + " SELECT date, count(*) AS n, round(avg(station - satellite), 9) AS difference FROM daily WHERE station IS NOT NULL AND satellite IS NOT NULL GROUP BY date", date="date")
def colocated_days(spark, sf_dir: str) -> DataFrame:
    """Mean difference of the sources where both are present."""
    both = daily.colocated(daily_sparse(spark, sf_dir), "station", "satellite")
    return rounded(both.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("station") - F.col("satellite")).alias("difference")), 9)


@query(roles("hourly", "priors") + """, h AS (SELECT h.grid_id, ts, value, lur, atmo FROM hourly h JOIN priors USING (grid_id) WHERE kind = 'station'), s AS (SELECT min(ts) AS t0 FROM h)
    SELECT grid_id, count(*) AS n, round(max(epoch_us(ts) - epoch_us(t0)) / 86400e6, 6) AS last_day, 0::BIGINT AS n_value, round(any_value(coalesce(atmo, lur)), 6) AS background FROM h, s GROUP BY grid_id""")
def blanked_source(spark, sf_dir: str) -> DataFrame:
    """Readings with their source blanked, days since the first reading, and the first background value there is."""
    from ..functions.scalars import days_since, first_available

    df = R.hourly(spark, sf_dir, "station").join(R.priors(spark, sf_dir), "grid_id")
    start = df.agg(F.min("ts").alias("t0"))
    out = clean.blank_source(df, "value").crossJoin(F.broadcast(start)).withColumn("day", days_since(F.col("ts"), F.col("t0")))
    best = first_available(out.columns, ("model", "atmo", "lur"))
    return rounded(out.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last_day"), F.count("value").alias("n_value"), F.first(best).alias("background")))


@query(roles("hourly", "cells") + """, h AS (SELECT CASE WHEN hour(ts) = 3 THEN 'NaN'::DOUBLE ELSE latitude END AS latitude, CASE WHEN hour(ts) = 4 THEN 'inf'::DOUBLE ELSE longitude END AS longitude, hour(ts) <> 5 AS timed FROM hourly JOIN cells USING (grid_id) WHERE kind = 'station')
    SELECT count(*) AS n, count(*) FILTER (NOT isfinite(latitude) OR NOT isfinite(longitude)) AS n_no_place, count(*) FILTER (NOT timed) AS n_no_time, count(*) FILTER (NOT isfinite(latitude) OR NOT isfinite(longitude) OR NOT timed) AS n_dropped FROM h""")
def dropped_rows(spark, sf_dir: str) -> DataFrame:
    """How many readings go for lack of a finite place or a readable time."""
    df = R.hourly(spark, sf_dir, "station").join(R.cells(spark, sf_dir), "grid_id")
    hour = F.hour("ts")
    spoilt = df.select(
        F.when(hour == 3, F.lit("NaN")).otherwise(F.col("latitude").cast("string")).alias("latitude"), F.when(hour == 4, F.lit("inf")).otherwise(F.col("longitude").cast("string")).alias("longitude"),
        F.when(hour == 5, F.lit("no date")).otherwise(F.col("ts").cast("string")).alias("ts"),
    )
    return tables.dropped_counts(spoilt)


@query(roles("hourly", "daily") + """, b AS (SELECT grid_id, arg_min(value, (ts, value)) AS baseline FROM hourly WHERE kind = 'satellite' AND value IS NOT NULL GROUP BY grid_id)
    SELECT grid_id, date, round(station, 6) AS station, round(baseline, 6) AS baseline FROM daily LEFT JOIN b USING (grid_id) WHERE station IS NOT NULL""", date="date")
def looked_up_baseline(spark, sf_dir: str) -> DataFrame:
    """Station days with the first satellite reading of their cell, of a table that has many a cell."""
    rows = daily_sparse(spark, sf_dir).filter("station is not null").select("grid_id", "date", "station")
    return rounded(daily.baseline_lookup(rows, R.hourly(spark, sf_dir, "satellite"), "value", ["ts", "value"]))
