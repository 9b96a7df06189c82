"""The derived views as SQL; ``workload.views`` builds the same ones with Spark."""

VIEWS = {
    # One observation per line item: grows with the table.
    "obs": """
        SELECT l_shipdate AS time, CAST(-80 + 5 * (l_suppkey % 17) AS DOUBLE) AS lat,
               CAST(10 * (l_partkey % 36) AS DOUBLE) AS lon, ln(l_extendedprice) AS value
        FROM lineitem""",
    # Line items averaged by month and cell.
    "cell_month": """
        SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS time, l_suppkey % 17 AS li, l_partkey % 36 AS lj,
               sqrt(avg(l_extendedprice)) / 10 AS price, sqrt(avg(l_quantity)) AS quantity
        FROM lineitem GROUP BY ALL""",
    "months": "SELECT DISTINCT time FROM cell_month",
    # Dense monthly grid, 17 latitudes by 36 longitudes, with a travelling wave added.
    "field": """
        SELECT m.time, CAST(-80 + 5 * a.i AS DOUBLE) AS lat, CAST(10 * b.j AS DOUBLE) AS lon,
               coalesce(c.price, 20 + sin(7.0 * a.i + 3.0 * b.j * b.j)) + 10 * cos(radians(30.0 * b.j) - 0.5 * ((year(m.time) - 1994) * 12 + month(m.time)))
                 * cos(radians(CAST(-80 + 5 * a.i AS DOUBLE))) AS value
        FROM months m CROSS JOIN range(17) a(i) CROSS JOIN range(36) b(j)
        LEFT JOIN cell_month c ON c.time = m.time AND c.li = a.i AND c.lj = b.j""",
    # A second variable on the same grid.
    "field_b": """
        SELECT m.time, CAST(-80 + 5 * a.i AS DOUBLE) AS lat, CAST(10 * b.j AS DOUBLE) AS lon,
               coalesce(c.quantity, 20 + sin(7.0 * a.i + 3.0 * b.j * b.j)) + 5 * sin(radians(20.0 * b.j) + 0.3 * ((year(m.time) - 1994) * 12 + month(m.time))) AS value
        FROM months m CROSS JOIN range(17) a(i) CROSS JOIN range(36) b(j)
        LEFT JOIN cell_month c ON c.time = m.time AND c.li = a.i AND c.lj = b.j""",
    # Tropical observations for the sea-surface indices: latitudes -10..10.
    "tropics_obs": """
        SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS time, CAST(-10 + 5 * (l_suppkey % 5) AS DOUBLE) AS lat,
               CAST(10 * (l_partkey % 36) AS DOUBLE) AS lon, ln(l_extendedprice) AS value
        FROM lineitem""",
    # Month amplitudes of a global wind with a known streamfunction and potential.
    "wind_month": """
        SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS time, sqrt(avg(l_quantity)) AS amp_a,
               ln(avg(l_extendedprice)) AS amp_b, ln(1 + count(*)) AS amp_u
        FROM lineitem GROUP BY ALL""",
    "wind_cells": """
        SELECT w.time, amp_a, amp_b, amp_u, CAST(-90 + 10 * a.i AS DOUBLE) AS lat, CAST(10 * b.j AS DOUBLE) AS lon,
               sin(radians(-90.0 + 10 * a.i)) AS s, cos(radians(-90.0 + 10 * a.i)) AS c,
               radians(10.0 * b.j) AS x
        FROM wind_month w CROSS JOIN range(19) a(i) CROSS JOIN range(36) b(j)""",
    "wind": """
        SELECT time, lat, lon, s, c, x, amp_a, amp_b, amp_u,
               -amp_a * cos(2 * x) * (c * c * c - 2 * c * s * s) - amp_b * s * sin(x) + amp_u * c AS u,
               -2 * amp_a * c * s * sin(2 * x) + amp_b * cos(x) * (c * c - s * s) AS v
        FROM wind_cells""",
    # Daily series.
    "series": """
        SELECT CAST(o_orderdate AS TIMESTAMP) AS time, sqrt(sum(o_totalprice) / 1000) AS value, count(*) AS n
        FROM orders GROUP BY o_orderdate""",
    "series_b": """
        SELECT CAST(l_shipdate AS TIMESTAMP) AS time, sqrt(sum(l_quantity * l_extendedprice)) / 100 AS value
        FROM lineitem GROUP BY l_shipdate""",
    # Dates on which the daily series is high.
    "high_days": """
        SELECT CAST(time AS DATE) AS date FROM series
        WHERE value >= (SELECT quantile_cont(value, 0.75) FROM series)""",
    "urgent_days": """
        SELECT CAST(o_orderdate AS DATE) AS date FROM orders
        WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_totalprice > 350000""",
    # Daily wave description built from order counts and keys.
    "wave_days": """
        SELECT CAST(o_orderdate AS TIMESTAMP) AS time, count(*) AS cnt, sum(o_orderkey) AS keys
        FROM orders GROUP BY o_orderdate""",
    "waves": """
        SELECT time,
               CAST((cnt * 1 * 37 + keys) % 101 AS DOUBLE) AS wave1_amp, CAST((cnt * 2 * 37 + keys) % 101 AS DOUBLE) AS wave2_amp,
               CAST((cnt * 3 * 37 + keys) % 101 AS DOUBLE) AS wave3_amp, CAST((cnt * 4 * 37 + keys) % 101 AS DOUBLE) AS wave4_amp,
               CAST((cnt * 5 * 37 + keys) % 101 AS DOUBLE) AS wave5_amp, CAST((cnt * 6 * 37 + keys) % 101 AS DOUBLE) AS wave6_amp,
               CAST((cnt * 7 * 37 + keys) % 101 AS DOUBLE) AS wave7_amp, CAST((cnt * 8 * 37 + keys) % 101 AS DOUBLE) AS wave8_amp,
               CAST((cnt * 9 * 37 + keys) % 101 AS DOUBLE) AS wave9_amp, CAST((cnt * 10 * 37 + keys) % 101 AS DOUBLE) AS wave10_amp,
               (keys % 80) * 0.75::DOUBLE AS wave6_phase, keys % 12 AS sign_count, ln(1 + keys) AS env_max
        FROM wave_days""",
    "wave_ranks": """
        SELECT w.time, k, rank() OVER p + (count(*) OVER (PARTITION BY w.time, amp) - 1) / 2.0 AS rnk
        FROM (SELECT time, unnest([wave1_amp, wave2_amp, wave3_amp, wave4_amp, wave5_amp, wave6_amp, wave7_amp, wave8_amp,
                                   wave9_amp, wave10_amp]) AS amp, unnest(range(1, 11)) AS k FROM waves) w
        WINDOW p AS (PARTITION BY w.time ORDER BY amp)""",
    # Days whose ranks of waves 5 and 6 sum to 11 or more, with their event columns.
    "chosen": """
        SELECT w.time, w.wave6_phase, w.sign_count, w.env_max, r.r5, r.r6
        FROM waves w JOIN (
            SELECT time, max(rnk) FILTER (k = 5) AS r5, max(rnk) FILTER (k = 6) AS r6 FROM wave_ranks GROUP BY time) r
        ON r.time = w.time WHERE r5 + r6 >= 11""",
    "gaps": """
        SELECT *, date_diff('day', lag(time) OVER (ORDER BY time), time) AS time_delta FROM chosen""",
    "numbered": """
        SELECT *, coalesce(time_delta < 2, false) AS in_event,
               sum(CASE WHEN coalesce(time_delta < 2, false) THEN 0 ELSE 1 END) OVER (ORDER BY time) - 1 AS event_number
        FROM gaps""",
    "positioned": """
        SELECT *, row_number() OVER (PARTITION BY event_number ORDER BY time) - 1 AS i,
               count(*) OVER (PARTITION BY event_number) AS event_duration,
               abs(wave6_phase - lag(wave6_phase) OVER (PARTITION BY event_number ORDER BY time)) AS step
        FROM numbered""",
    "unwrapped": """
        SELECT *, CASE WHEN max(step) OVER (PARTITION BY event_number) > 50 AND wave6_phase < 30
                       THEN wave6_phase + 60 ELSE wave6_phase END AS event_phase FROM positioned""",
    "event_slopes": """
        SELECT event_number, CASE WHEN count(*) > 1 THEN regr_slope(event_phase, i) END AS event_gradient
        FROM unwrapped GROUP BY event_number""",
    "events_full": """
        SELECT u.*, s.event_gradient, i = 0 AS event_start, i = event_duration - 1 AS event_end
        FROM unwrapped u JOIN event_slopes s USING (event_number)""",
    # Order intervals: start on the order day, up to four days long.
    "intervals": """
        SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS start_ts,
               CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 5 AS INTEGER)) AS end_ts
        FROM orders""",
    "seasons": """
        SELECT * FROM (VALUES (12, 'DJF'), (1, 'DJF'), (2, 'DJF'), (3, 'MAM'), (4, 'MAM'), (5, 'MAM'), (6, 'JJA'), (7, 'JJA'),
                              (8, 'JJA'), (9, 'SON'), (10, 'SON'), (11, 'SON')) AS t(mon, season)""",
    # Fourier coefficients of the dense field, wavenumbers 0..18.
    "dft": """
        SELECT time, lat, k, sum(value * cos(radians(k * lon))) AS re, -sum(value * sin(radians(k * lon))) AS im
        FROM field CROSS JOIN range(0, 19) w(k) GROUP BY ALL""",
    "lon_axis": "SELECT CAST(10 * j AS DOUBLE) AS lon, j FROM range(36) t(j)",
    # Single-wavenumber signals 1..10.
    "single": """
        SELECT time, lat, k, j, lon, 2.0 / 36 * (re * cos(radians(k * lon)) - im * sin(radians(k * lon))) AS s
        FROM dft CROSS JOIN lon_axis WHERE k BETWEEN 1 AND 10""",
    "envelope": """
        SELECT time, lat, lon,
               2.0 / 36 * sqrt(pow(sum(re * cos(radians(k * lon)) - im * sin(radians(k * lon))), 2)
                             + pow(sum(re * sin(radians(k * lon)) + im * cos(radians(k * lon))), 2)) AS value
        FROM dft CROSS JOIN lon_axis WHERE k BETWEEN 1 AND 9 GROUP BY ALL""",
    "pwi_series": """
        SELECT time, median(m) AS pwi FROM (
            SELECT time, lon, max(value) AS m FROM envelope WHERE lat BETWEEN -70 AND -40 GROUP BY ALL) GROUP BY time""",
    "pwi_days": """
        SELECT CAST(time AS DATE) AS date FROM pwi_series WHERE pwi >= (SELECT quantile_cont(pwi, 0.75) FROM pwi_series)""",
    # Mean over 45-30S per month and longitude.
    "lat_band": "SELECT time, lon, avg(value) AS value FROM field WHERE lat BETWEEN -45 AND -30 GROUP BY ALL",
    "band_dft": """
        SELECT time, k, sum(value * cos(radians(k * lon))) AS re, -sum(value * sin(radians(k * lon))) AS im
        FROM lat_band CROSS JOIN range(0, 19) w(k) GROUP BY ALL""",
    # Event stream.
    "stream": "SELECT ts AS time, event_type, value, user_id FROM events",
    # Rank-two field with known patterns for the decomposition.
    "two_series": """
        SELECT time, a - avg(a) OVER () AS a1, b - avg(b) OVER () AS b1 FROM (
            SELECT time, avg(quantity) * 4 AS a, avg(price) / 10 AS b FROM cell_month GROUP BY time)""",
    "two_modes": """
        SELECT time, a1, b1 - a1 * (SELECT sum(a1 * b1) / sum(a1 * a1) FROM two_series) AS a2 FROM two_series""",
    "patterns": """
        SELECT CAST(-60 + 15 * i AS DOUBLE) AS lat, CAST(30 * j AS DOUBLE) AS lon,
               cos(radians(30.0 * j)) + 0.5 * cos(radians(60.0 * j)) AS p1,
               cos(radians(90.0 * j)) + 0.5 * cos(radians(120.0 * j)) AS p2, sqrt(cos(radians(-60.0 + 15 * i))) AS w
        FROM range(5) a(i) CROSS JOIN range(12) b(j)""",
    "mode_stats": """
        SELECT (SELECT sum(p1 * p1 * w * w) FROM patterns) AS n1, (SELECT sum(p2 * p2 * w * w) FROM patterns) AS n2,
               (SELECT sum(a1 * a1) / (count(*) - 1) FROM two_modes) AS v1, (SELECT sum(a2 * a2) / (count(*) - 1) FROM two_modes) AS v2,
               (SELECT count(*) FROM two_modes) AS nt""",
    "mode_list": """
        SELECT 3 - row_number() OVER (ORDER BY eig) AS mode, *, sqrt(eig) AS root FROM (
            SELECT 1 AS src, v1 * n1 AS eig, n1 AS nn, v1 * n1 + v2 * n2 AS total, nt FROM mode_stats
            UNION ALL SELECT 2, v2 * n2, n2, v1 * n1 + v2 * n2, nt FROM mode_stats)""",
    "mode_patterns": """
        SELECT mode, lat, lon, CASE WHEN src = 1 THEN p1 ELSE p2 END * w / sqrt(nn) AS loading, root
        FROM mode_list CROSS JOIN patterns""",
    "mode_pcs": """
        SELECT mode, time, CASE WHEN src = 1 THEN a1 ELSE a2 END * sqrt(nn) AS pc, root FROM mode_list CROSS JOIN two_modes""",
    # Parts of the two-mode field: cells and months of each, their inner products, and the eigenpairs of covariance times cell products.
    "part_cells": """
        SELECT part, lat, lon, p1, p2, w FROM patterns JOIN (VALUES ('all', -90), ('north', -15), ('winter', -90), ('north_summer', 0)) AS g(part, least) ON lat >= least""",
    "part_times": """
        SELECT part, time, a1, a2, a1 - avg(a1) OVER (PARTITION BY part) AS c1, a2 - avg(a2) OVER (PARTITION BY part) AS c2
        FROM two_modes JOIN (VALUES ('all', [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]), ('north', [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]), ('winter', [12, 1, 2]),
                             ('north_summer', [6, 7, 8])) AS g(part, months) ON list_contains(months, month(time))""",
    "part_products": """
        SELECT * FROM (SELECT part, sum(p1 * p1 * w * w) AS g11, sum(p1 * p2 * w * w) AS g12, sum(p2 * p2 * w * w) AS g22, count(*) AS cells FROM part_cells GROUP BY part)
        JOIN (SELECT part, sum(c1 * c1) / (count(*) - 1) AS v11, sum(c1 * c2) / (count(*) - 1) AS v12, sum(c2 * c2) / (count(*) - 1) AS v22, count(*) AS nt
              FROM part_times GROUP BY part) USING (part)""",
    "part_modes": """
        SELECT *, sqrt(y1 * y1 * g11 + 2 * y1 * y2 * g12 + y2 * y2 * g22) AS norm FROM (
            SELECT *, CASE WHEN abs(eig - m22) >= abs(eig - m11) THEN eig - m22 ELSE m12 END AS y1, CASE WHEN abs(eig - m22) >= abs(eig - m11) THEN m21 ELSE eig - m11 END AS y2
            FROM (SELECT *, m11 + m22 AS total, (m11 + m22) / 2 + (3 - 2 * mode) * sqrt(pow((m11 - m22) / 2, 2) + m12 * m21) AS eig FROM (
                SELECT *, v11 * g11 + v12 * g12 AS m11, v11 * g12 + v12 * g22 AS m12, v12 * g11 + v22 * g12 AS m21, v12 * g12 + v22 * g22 AS m22 FROM part_products)
                CROSS JOIN (VALUES (1), (2)) AS k(mode)))""",
    "part_signs": """
        SELECT m.*, turn FROM part_modes m JOIN (
            SELECT part, mode, arg_max(sign(x), (round(abs(x), 12), -lat, -lon)) AS turn
            FROM (SELECT part, mode, lat, lon, (y1 * p1 + y2 * p2) * w / norm AS x FROM part_modes JOIN part_cells USING (part)) GROUP BY ALL) USING (part, mode)""",
}
