"""Events, calendars, counts and phase distributions."""

from pyspark.sql import functions as F

from fieldloom.operators import calendars, events, phases, select
from workload import views
from workload.registry import query, student_p

MIN_SUM = 11


def event_days(spark, d):
    return events.event_table(views.waves(spark, d), min_sum=MIN_SUM)


def numbered_days(spark, d):
    return events.gap_sessionise(events.topk_wave_rule(views.waves(spark, d), min_sum=MIN_SUM))


@query("running_mean", "time:d lat lon value:6", """
    SELECT time, lat, lon, m AS value FROM (
        SELECT *, avg(value) OVER w AS m, count(value) OVER w AS c FROM field
        WINDOW w AS (PARTITION BY lat, lon ORDER BY time ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)) WHERE c = 12""")
def _(spark, d):
    return events.running_mean(views.field(spark, d), 12)


_RUN = """
    SELECT time, m AS value FROM (SELECT *, avg(value) OVER w AS m, count(value) OVER w AS c FROM series
        WINDOW w AS (ORDER BY time ROWS BETWEEN {0} PRECEDING AND {1} FOLLOWING)) WHERE c = {2}"""


@query("running_mean_series", "time:d value:6", _RUN.format(15, 14, 30))
def _(spark, d):
    return events.running_mean(views.series(spark, d).drop("n"), 30, by=[])


@query("running_mean_long", "time:d value:6", _RUN.format(182, 182, 365))
def _(spark, d):
    return events.running_mean(views.series(spark, d).drop("n"), 365, by=[])


@query("running_mean_calendar", "time:d value:6", """
    SELECT time, m AS value FROM (SELECT *, avg(value) OVER w AS m, count(value) OVER w AS c FROM series
        WINDOW w AS (ORDER BY time RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND INTERVAL 4 DAY FOLLOWING)) WHERE c = 10""")
def _(spark, d):
    return events.running_mean(views.series(spark, d).drop("n"), 10, by=[], axis="day")


@query("rank_across_columns", "time:d " + " ".join(f"wave{k}_amp:1" for k in range(1, 11)), "SELECT time, "
    + ", ".join(f"max(rnk) FILTER (k = {k}) AS wave{k}_amp" for k in range(1, 11)) + " FROM wave_ranks GROUP BY time")
def _(spark, d):
    return events.rank_across_columns(views.waves(spark, d), [f"wave{k}_amp" for k in range(1, 11)])


@query("topk_wave_rule", "time:d wave5_amp:1 wave6_amp:1", """
    SELECT time, max(rnk) FILTER (k = 5) AS wave5_amp, max(rnk) FILTER (k = 6) AS wave6_amp FROM wave_ranks GROUP BY time
    HAVING wave5_amp + wave6_amp >= 17""")
def _(spark, d):
    return events.topk_wave_rule(views.waves(spark, d))


@query("gap_sessionise", "time:d time_delta:3 in_event:b event_number:i", "SELECT * FROM numbered")
def _(spark, d):
    return numbered_days(spark, d)


@query("event_duration", "time:d event_number:i event_duration:i", "SELECT * FROM positioned")
def _(spark, d):
    return event_days(spark, d)


@query("phase_unwrap", "time:d wave6_phase:2 event_phase:2", "SELECT * FROM unwrapped")
def _(spark, d):
    return event_days(spark, d)


@query("event_gradient", "time:d event_gradient:6", "SELECT * FROM events_full")
def _(spark, d):
    return event_days(spark, d)


@query("event_bounds", "time:d event_start:b event_end:b", "SELECT * FROM events_full")
def _(spark, d):
    return event_days(spark, d)


@query(
    "event_table",
    "time:d time_delta:3 in_event:b event_number:i event_duration:i event_phase:2 event_gradient:6 event_start:b event_end:b wave5_amp:1 wave6_amp:1 wave6_phase:2 env_max:6",
    "SELECT *, r5 AS wave5_amp, r6 AS wave6_amp FROM events_full",
)
def _(spark, d):
    return event_days(spark, d)


@query("event_dates", "date:d", """
    SELECT CAST(time AS DATE) AS date FROM events_full WHERE event_duration > 1 AND month(time) IN (6, 7, 8) AND (wave6_phase > 40 OR wave6_phase < 20)""")
def _(spark, d):
    return events.event_dates(event_days(spark, d), duration=1, season="JJA", phase=(40, 80))


@query("event_table_sign_limit", "time:d event_number:i event_duration:i sign_count:i", """
    SELECT *, count(*) OVER (PARTITION BY event_number) AS event_duration FROM (
        SELECT *, sum(CASE WHEN coalesce(date_diff('day', before, time) < 2, false) THEN 0 ELSE 1 END) OVER (ORDER BY time) - 1 AS event_number
        FROM (SELECT *, lag(time) OVER (ORDER BY time) AS before FROM chosen WHERE sign_count <= 6))""")
def _(spark, d):
    return events.event_table(views.waves(spark, d), min_sum=MIN_SUM, max_sign_change=6)


@query("duration_filter", "time:d event_duration:i", "SELECT * FROM positioned WHERE event_duration > 2")
def _(spark, d):
    return select.duration_filter(event_days(spark, d), 2)


@query("duration_filter_inclusive", "time:d event_duration:i", "SELECT * FROM positioned WHERE event_duration >= 2")
def _(spark, d):
    return select.duration_filter(event_days(spark, d), 2, strict=False)


@query("duration_histogram", "event_duration:i n_events:i mean_duration:6", """
    SELECT event_duration, count(*) AS n_events, (SELECT count(*) * 1.0 / count(DISTINCT event_number) FROM numbered) AS mean_duration
    FROM (SELECT event_number, count(*) AS event_duration FROM numbered GROUP BY 1) GROUP BY 1""")
def _(spark, d):
    return events.duration_histogram(event_days(spark, d))


@query("gradient_stats", "gradient_mean:6 gradient_std:6 forward:i backward:i stationary:i", """
    SELECT avg(g) AS gradient_mean, stddev_pop(g) AS gradient_std, count(*) FILTER (g > 0.25) AS forward,
           count(*) FILTER (g < -0.25) AS backward, count(*) FILTER (g BETWEEN -0.25 AND 0.25) AS stationary
    FROM (SELECT event_number, max(event_gradient) AS g FROM events_full WHERE event_duration >= 2 GROUP BY 1)""")
def _(spark, d):
    return events.gradient_stats(event_days(spark, d), 2)


_BINS = """
    SELECT season, {split} bin, sum(n) AS n FROM (
        SELECT unnest(['annual', season]) AS season, {split} floor((wave6_phase + 0.375) / 0.75) % 80 * 0.75 AS bin, 1 AS n
        FROM {src} JOIN seasons ON month(time) = mon
        UNION ALL SELECT DISTINCT unnest(['annual', season]) AS season, {split} b * 0.75, 0
        FROM {src} JOIN seasons ON month(time) = mon, range(80) r(b))
    GROUP BY ALL"""

_EPOCH = "CASE WHEN year(time) < 1997 THEN 'early' WHEN year(time) > 1999 THEN 'late' ELSE 'middle' END AS split"


@query("phase_histogram", "season:s bin:2 n:i", _BINS.format(split="", src="waves"))
def _(spark, d):
    return phases.phase_histogram(views.waves(spark, d))


@query("phase_histogram_split", "season:s split:s bin:2 n:i", _BINS.format(split="split,", src=f"(SELECT *, {_EPOCH} FROM waves)"))
def _(spark, d):
    return phases.phase_histogram(views.waves(spark, d), split=phases.split_by_epoch(first=1997, last=1999))


@query("phase_histogram_gradient", "season:s split:s bin:2 n:i", _BINS.format(
    split="split,", src="(SELECT *, CASE WHEN event_gradient < -0.2 THEN 'backwards' WHEN event_gradient > 0.2 THEN 'forward' ELSE 'stationary' END AS split FROM events_full)"))
def _(spark, d):
    return phases.phase_histogram(event_days(spark, d), split=phases.split_by_gradient())


_KDE = """
    SELECT season, bin, sum(n * 0.75 / (h * sqrt(2 * pi())) * (exp(-0.5 * pow((bin - x) / h, 2)) + exp(-0.5 * pow((bin - x + 59.25) / h, 2))
             + exp(-0.5 * pow((bin - x - 59.25) / h, 2)))) AS density
    FROM (SELECT season, x, count(*) AS n, {h} AS h FROM (
              SELECT unnest(['annual', season]) AS season, wave6_phase AS x FROM waves JOIN seasons ON month(time) = mon) GROUP BY season, x)
    CROSS JOIN (SELECT b * 0.75::DOUBLE AS bin FROM range(80) r(b)) GROUP BY season, bin"""


@query("cyclic_kde", "season:s bin:2 density:6", _KDE.format(h="3.0"))
def _(spark, d):
    return phases.cyclic_kde(views.waves(spark, d), bandwidth=3.0)


@query("cyclic_kde_auto", "season:s bin:2 density:6", """
    WITH p AS (SELECT unnest(['annual', season]) AS season, wave6_phase AS x FROM waves JOIN seasons ON month(time) = mon),
         w AS (SELECT season, stddev_samp(x) * pow(count(*), -0.2) AS h FROM p GROUP BY season)
    SELECT season, bin, sum(0.75 / (h * sqrt(2 * pi())) * (exp(-0.5 * pow((bin - x) / h, 2)) + exp(-0.5 * pow((bin - x + 59.25) / h, 2))
             + exp(-0.5 * pow((bin - x - 59.25) / h, 2)))) AS density
    FROM p JOIN w USING (season) CROSS JOIN (SELECT b * 0.75::DOUBLE AS bin FROM range(80) r(b)) GROUP BY season, bin""")
def _(spark, d):
    return phases.cyclic_kde(views.waves(spark, d))


_GROWN = """
    WITH RECURSIVE axis AS (SELECT season, list(density ORDER BY bin) AS d FROM (
        SELECT season, bin, sum(0.75 / (3.0 * sqrt(2 * pi())) * (exp(-0.5 * pow((bin - x) / 3.0, 2)) + exp(-0.5 * pow((bin - x + 59.25) / 3.0, 2)) + exp(-0.5 * pow((bin - x - 59.25) / 3.0, 2)))) AS density
        FROM (SELECT wave6_phase AS x, unnest(['annual', season]) AS season FROM waves JOIN seasons ON month(time) = mon) CROSS JOIN (SELECT b * 0.75::DOUBLE AS bin FROM range(80) r(b))
        GROUP BY season, bin) GROUP BY season),
    peaks AS (SELECT season, d, i, CASE WHEN d[i + 1] > d[i] AND d[i + 1] > d[i + 2] THEN 'max' WHEN d[i + 1] < d[i] AND d[i + 1] < d[i + 2] THEN 'min' END AS kind
              FROM axis, range(1, 79) r(i)),
    grown AS (
        SELECT season, d, kind, i, i AS l, i AS r, 0 AS step FROM peaks WHERE kind IS NOT NULL
        UNION ALL SELECT season, d, kind, i, CASE WHEN go_right THEN l ELSE below END, CASE WHEN go_right THEN above ELSE r END, step + 1 FROM (
            SELECT *, CASE kind WHEN 'max' THEN d[above + 1] >= d[below + 1] ELSE d[above + 1] <= d[below + 1] END AS go_right
            FROM (SELECT *, (r + 1) % 79 AS above, (l + 78) % 79 AS below FROM grown WHERE step < 10)))
    SELECT season, kind, i * 0.75 AS bin, l * 0.75 AS "left", r * 0.75 AS "right" FROM grown WHERE step = 10"""


@query("kde_extrema", "season:s kind:s bin:2 left_bin:2 right_bin:2", _GROWN.replace('"left"', "left_bin").replace('"right"', "right_bin"))
def _(spark, d):
    found = phases.kde_extrema(phases.cyclic_kde(views.waves(spark, d), bandwidth=3.0))
    return found.withColumnsRenamed({"left": "left_bin", "right": "right_bin"})


# Calendars and counts.


@query("fill_calendar", "date:d count:i", """
    SELECT r.day AS date, coalesce(n, 0) AS count FROM (SELECT unnest(generate_series((SELECT make_date(year(min(time)), 1, 1) FROM series), (SELECT make_date(year(max(time)), 12, 31) FROM series), INTERVAL 1 DAY)) AS day) r
    LEFT JOIN (SELECT date, count(*) AS n FROM urgent_days GROUP BY 1) u ON u.date = r.day""")
def _(spark, d):
    counts = calendars.counts_per_day(views.urgent_days(spark, d))
    return calendars.fill_calendar(counts, bounds=calendars.calendar_year_bounds(views.series(spark, d), "time"))


@query("complete_season_years", "time:d value:6", """
    SELECT time, value FROM series, (SELECT min(time) AS a, max(time) AS b FROM series)
    WHERE CAST(time AS DATE) BETWEEN make_date(year(a) + CASE WHEN month(a) = 12 THEN 1 ELSE 0 END, 12, 1)
      AND make_date(year(b) - CASE WHEN month(b) < 12 THEN 1 ELSE 0 END, 11, 30)""")
def _(spark, d):
    return calendars.complete_season_years(views.series(spark, d), "time")


@query("month_frequency_pct", "month:i pct:6", """
    SELECT month(day) AS month, 100.0 * count(date) / count(*) AS pct
    FROM (SELECT unnest(generate_series((SELECT min(time) FROM series), (SELECT max(time) FROM series), INTERVAL 1 DAY)) AS day)
    LEFT JOIN high_days ON date = day GROUP BY 1""")
def _(spark, d):
    from workload.stats_queries import high_days

    days = views.series(spark, d).agg(F.to_date(F.min("time")).alias("first_day"), F.to_date(F.max("time")).alias("last_day"))
    return calendars.month_frequency_pct(high_days(spark, d), bounds=days)


_COUNTS = """
    SELECT year(date + INTERVAL 1 MONTH) AS season_year, count(*) FILTER (season = 'DJF') AS DJF, count(*) FILTER (season = 'MAM') AS MAM,
           count(*) FILTER (season = 'JJA') AS JJA, count(*) FILTER (season = 'SON') AS SON, count(*) AS annual
    FROM high_days JOIN seasons ON month(date) = mon WHERE date BETWEEN (SELECT make_date(year(min(time)) + CASE WHEN month(min(time)) = 12 THEN 1 ELSE 0 END, 12, 1) FROM series)
      AND (SELECT make_date(year(max(time)) - CASE WHEN month(max(time)) < 12 THEN 1 ELSE 0 END, 11, 30) FROM series) GROUP BY 1"""


def _season_counts(spark, d):
    from workload.stats_queries import high_days

    whole_years = calendars.season_year_bounds(views.series(spark, d), "time")
    filled = calendars.fill_calendar(calendars.counts_per_day(high_days(spark, d)), bounds=whole_years)
    return calendars.season_year_counts(filled)


@query("season_year_counts", "season_year:i DJF:i MAM:i JJA:i SON:i annual:i", _COUNTS)
def _(spark, d):
    return _season_counts(spark, d)


_TRENDS = f"""
    SELECT season, count(*) AS n, regr_slope(y, season_year) AS slope, corr(y, season_year) AS r FROM (
        SELECT season_year, unnest(['annual', 'DJF', 'MAM', 'JJA', 'SON']) AS season, unnest([annual, DJF, MAM, JJA, SON]) AS y FROM ({_COUNTS})) GROUP BY season"""


@query("seasonal_trend", "season:s n:i slope:6 r:6", _TRENDS)
def _(spark, d):
    return calendars.seasonal_trend(_season_counts(spark, d))


@query("seasonal_trend_p", "season:s p:6", f"SELECT season, {student_p('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')} AS p FROM ({_TRENDS})")
def _(spark, d):
    return calendars.seasonal_trend(_season_counts(spark, d))


@query("date_overlap_stats", "season:s n_primary:i n_secondary:i n_common:i common_pct:6", """
    SELECT season, count(*) FILTER (src = 'p') AS n_primary, count(*) FILTER (src = 's') AS n_secondary,
           count(DISTINCT date) FILTER (src = 'p' AND date IN (SELECT date FROM high_days)) AS n_common,
           100.0 * n_common / n_primary AS common_pct
    FROM (SELECT date, src, unnest(['annual', season]) AS season FROM (
              SELECT date, 'p' AS src FROM urgent_days UNION ALL SELECT date, 's' FROM high_days) JOIN seasons ON month(date) = mon)
    GROUP BY season""")
def _(spark, d):
    from workload.stats_queries import high_days

    return calendars.date_overlap_stats(views.urgent_days(spark, d), high_days(spark, d))


@query("expand_intervals", "id:i date:d", "SELECT id, unnest(generate_series(CAST(start_ts AS DATE), CAST(end_ts AS DATE), INTERVAL 1 DAY)) AS date FROM intervals")
def _(spark, d):
    return calendars.expand_intervals(views.intervals(spark, d), "start_ts", "end_ts")


@query("expand_intervals_distinct", "date:d", "SELECT DISTINCT unnest(generate_series(CAST(start_ts AS DATE), CAST(end_ts AS DATE), INTERVAL 1 DAY)) AS date FROM intervals")
def _(spark, d):
    return calendars.expand_intervals(views.intervals(spark, d), "start_ts", "end_ts", distinct=True)
