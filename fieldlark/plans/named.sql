-- The four questions of the sensor database, over views readings, sensors and bounds.

-- name: a_hourly_avg_temperature
SELECT sensor_id,
       date_format(ts, 'yyyy-MM-dd HH:00:00') AS hour,
       count(*) AS n,
       floor(avg(value) * 100D + 0.5D) / 100D AS avg_temp
FROM readings
WHERE variable = :variable
GROUP BY ALL
ORDER BY sensor_id, hour;

-- name: b_missing_intervals
-- One pass over readings: the span of the whole table is that of its sensors together.
WITH seen AS (
    SELECT sensor_id,
           count(DISTINCT ts) AS n,
           unix_micros(CAST(min(ts) AS TIMESTAMP)) AS first_us,
           unix_micros(CAST(max(ts) AS TIMESTAMP)) AS last_us
    FROM readings GROUP BY sensor_id),
due AS (
    SELECT CAST((max(last_us) - min(first_us)) / 30000000D AS BIGINT) AS n_expected FROM seen)
SELECT sensor_id, n_samples, n_expected, n_expected - n_samples AS n_missing
FROM due JOIN (SELECT s.sensor_id, ifnull(n, 0) AS n_samples FROM seen RIGHT JOIN sensors AS s ON seen.sensor_id = s.sensor_id)
ORDER BY n_missing DESC, sensor_id
LIMIT 5;

-- name: c_rolling_1h_voltage
SELECT sensor_id,
       ts,
       value AS voltage,
       floor(avg(value) OVER w * 10000D + 0.5D) / 10000D AS voltage_1h_avg,
       count(*) OVER w AS n_in_window
FROM readings
WHERE variable = :variable
WINDOW w AS (PARTITION BY sensor_id ORDER BY CAST(ts AS TIMESTAMP) RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)
ORDER BY sensor_id, ts;

-- name: d_outside_plausible_range
SELECT variable,
       count(*) AS n_readings,
       count(DISTINCT sensor_id) AS n_sensors,
       min(value) AS min_value,
       max(value) AS max_value
FROM readings JOIN bounds USING (variable)
WHERE value NOT BETWEEN low AND high
GROUP BY variable
ORDER BY n_readings DESC, variable;
