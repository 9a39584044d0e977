"""Standard SQL with the same results as the queries of this package.

Written from the definitions of the operators, not from their plans: ranks where
the operators count, joins where they carry values along. The fixed values are
those of :mod:`muster.plans.batch` and :mod:`muster.plans.streams`.
"""

from __future__ import annotations

# Named table expressions the statements below start from.
PUNCH = """p AS (
  SELECT event_id AS punch_id, user_id AS person, ts, event_type AS kind, value, props, CAST(ts AS DATE) AS day
  FROM events)"""
DAILY = """daily AS (
  SELECT person, day, min(ts) AS first_in, max(ts) AS last_out, count(*) AS punches FROM p GROUP BY person, day)"""
RANKED = """ranked AS (
  SELECT person, day, ts AS in_ts, lead(ts) OVER w AS out_ts, row_number() OVER w AS nth
  FROM p WINDOW w AS (PARTITION BY person, day ORDER BY ts, punch_id))"""
PAIRS = """pairs AS (SELECT person, day, in_ts, out_ts FROM ranked WHERE nth % 2 = 1)"""
WORKED = """worked AS (
  SELECT person, day, CAST(sum(date_sub('minute', in_ts, out_ts)) AS BIGINT) AS minutes, count(*) AS intervals
  FROM pairs WHERE out_ts IS NOT NULL GROUP BY person, day)"""
ROSTER = """roster AS (
  SELECT c_custkey AS person, c_nationkey AS nation_id, c_mktsegment AS cohort
  FROM customer WHERE c_custkey IN (SELECT user_id FROM events))"""
CALENDAR = "calendar AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)"
ABSENT = """absent AS (
  SELECT r.person, c.day FROM roster r CROSS JOIN calendar c
  WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.person = r.person AND d.day = c.day))"""
ORG = """org AS (
  SELECT roster.*, n_name AS nation, r_name AS region
  FROM roster JOIN nation ON n_nationkey = nation_id JOIN region ON r_regionkey = n_regionkey)"""
SHIFT = """shift AS (
  SELECT cohort, effective_from, start_min,
         lead(effective_from) OVER (PARTITION BY cohort ORDER BY effective_from) AS until
  FROM (VALUES ('AUTOMOBILE', DATE '2024-01-01', 480), ('AUTOMOBILE', DATE '2024-01-16', 540),
               ('BUILDING', DATE '2024-01-01', 420), ('FURNITURE', DATE '2024-01-01', 540),
               ('HOUSEHOLD', DATE '2024-01-01', 600), ('MACHINERY', DATE '2024-01-01', 360))
       AS v(cohort, effective_from, start_min))"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _streaks(source: str) -> str:
    return f"""SELECT person, min(day) AS streak_start, max(day) AS streak_end, count(*) AS days
FROM (SELECT person, day, day - CAST(row_number() OVER (PARTITION BY person ORDER BY day) AS INTEGER) AS run FROM {source})
GROUP BY person, run"""


def _periods(op: str) -> str:
    return f"""SELECT user_id AS person FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-01'
{op} SELECT user_id AS person FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-02'"""


_MONTH = ", ".join(
    f"CAST(max(CASE WHEN day = DATE '2024-01-{d:02d}' THEN 1 ELSE 0 END) AS INTEGER) AS d_2024_01_{d:02d}"
    for d in range(1, 31)
)

_SESSIONS = """starts AS (
  SELECT person, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS starts
  FROM p WINDOW w AS (PARTITION BY person ORDER BY ts)),
numbered AS (
  SELECT person, ts, sum(starts) OVER (PARTITION BY person ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM starts),
sessions AS (
  SELECT person, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS punches
  FROM numbered GROUP BY person, session)"""

# The last watermark of a finite run: newest event time in milliseconds less the lateness.

SQL = {
    "a01_read_punches": _with(PUNCH) + """SELECT punch_id, person, CASE WHEN kind <> 'error' THEN ts END AS ts,
  CASE WHEN kind = 'error' THEN 'malformed' ELSE 'good' END AS outcome FROM p""",
    "a02_write_register": _with(PUNCH) + """SELECT person, day, min(ts) AS first_in, max(ts) AS last_out, count(*) AS punches
FROM p WHERE day < DATE '2024-01-02' OR kind <> 'error' GROUP BY person, day""",
    "a03_drop_repeats": _with(PUNCH) + """SELECT punch_id, person, ts, kind
FROM (SELECT *, lag(ts) OVER (PARTITION BY person ORDER BY ts, punch_id) AS prev FROM p)
WHERE prev IS NULL OR ts - prev >= INTERVAL 5 MINUTE""",
    "a04_apply_corrections": _with(PUNCH) + """SELECT punch_id, person,
  CASE WHEN kind = 'error' THEN ts + INTERVAL 10 MINUTE ELSE ts END AS ts, kind FROM p""",
    "a05_assign_workday": """SELECT user_id AS person, CAST(ts - INTERVAL 6 HOUR AS DATE) AS day, count(*) AS punches
FROM events GROUP BY 1, 2""",
    "a06_parse_attributes": """SELECT event_id AS punch_id, user_id AS person,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "a07_daily_attendance": _with(PUNCH, DAILY) + "SELECT * FROM daily",
    "a08_pair_punches": _with(PUNCH, RANKED, PAIRS) + "SELECT * FROM pairs",
    "a09_open_intervals": _with(PUNCH, RANKED, PAIRS) + "SELECT person, day, in_ts FROM pairs WHERE out_ts IS NULL",
    "a10_presence_sessions": _with(PUNCH, _SESSIONS) + "SELECT * FROM sessions",
    "a11_worked_minutes": _with(PUNCH, RANKED, PAIRS, WORKED) + "SELECT * FROM worked",
    "a12_overtime": _with(PUNCH, RANKED, PAIRS, WORKED)
    + "SELECT person, day, minutes, minutes - 480 AS overtime FROM worked WHERE minutes > 480",
    "a13_close_punches": _with(PUNCH) + ",\n" + """pair AS (
  SELECT b.person, b.ts, a.ts AS before FROM p a JOIN p b
    ON a.person = b.person AND (a.ts < b.ts OR (a.ts = b.ts AND a.punch_id < b.punch_id)) AND b.ts - a.ts < INTERVAL 5 MINUTE),
instant AS (SELECT person, ts, count(*) AS punches FROM p GROUP BY person, ts)
SELECT person, ts, punches,
  CAST(count(*) FILTER (WHERE before < ts) // punches AS BIGINT) AS earlier, count(*) AS pairs
FROM pair JOIN instant USING (person, ts) GROUP BY person, ts, punches""",
    "a14_last_before": _with(PUNCH) + """SELECT e.punch_id, e.person, e.ts, o.ts AS last_ts, o.punch_id AS last_id
FROM (SELECT * FROM p WHERE kind = 'error') e
ASOF LEFT JOIN (SELECT * FROM p WHERE kind = 'purchase') o ON e.person = o.person AND e.ts >= o.ts""",
    "a15_absences": _with(PUNCH, DAILY, ROSTER, CALENDAR, ABSENT) + "SELECT * FROM absent",
    "a16_absences_net": _with(PUNCH, DAILY, ROSTER, CALENDAR, ABSENT, ORG) + """SELECT * FROM absent
EXCEPT SELECT person, DATE '2024-01-06' FROM org WHERE region = 'ASIA'""",
    "a17_working_calendar": _with(PUNCH, DAILY, ROSTER, CALENDAR, ABSENT) + """SELECT * FROM absent
WHERE isodow(day) <= 5 AND day NOT IN (DATE '2024-01-01', DATE '2024-01-15')""",
    "a18_classify_arrival": _with(PUNCH, DAILY, ROSTER, SHIFT) + """SELECT d.person, d.day, d.first_in, r.cohort, s.start_min,
  CASE WHEN hour(first_in) * 60 + minute(first_in) <= s.start_min + 15 THEN 'on_time'
       WHEN s.start_min IS NOT NULL THEN 'late' END AS status
FROM daily d LEFT JOIN roster r ON r.person = d.person
LEFT JOIN shift s ON s.cohort = r.cohort AND d.day >= s.effective_from AND (s.until IS NULL OR d.day < s.until)""",
    "a19_attendance_rate": _with(PUNCH, DAILY, ROSTER, CALENDAR) + """SELECT r.person, count(d.day) AS attended,
  (SELECT count(*) FROM calendar) AS expected,
  round(CAST(count(d.day) AS DOUBLE) / (SELECT count(*) FROM calendar), 4) AS rate
FROM roster r LEFT JOIN daily d ON d.person = r.person GROUP BY r.person""",
    "a20_attendance_streaks": _with(PUNCH, DAILY) + _streaks("daily"),
    "a21_absence_streaks": _with(PUNCH, DAILY, ROSTER, CALENDAR, ABSENT) + _streaks("absent"),
    "a22_shortage": _with(PUNCH, DAILY) + "SELECT person, count(*) AS days FROM daily GROUP BY person HAVING count(*) < 25",
    "a23_roster_lost": _periods("EXCEPT"),
    "a23_roster_gained": """SELECT user_id AS person FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-02'
EXCEPT SELECT user_id AS person FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-01'""",
    "a23_roster_kept": _periods("INTERSECT"),
    "a23_roster_either": _periods("UNION"),
    "a24_org_rollup": _with(PUNCH, ROSTER, ORG) + """SELECT region, nation, CAST(grouping(region, nation) AS INTEGER) AS level,
  count(*) AS punches, count(DISTINCT p.person) AS people
FROM p JOIN org ON org.person = p.person GROUP BY ROLLUP (region, nation)""",
    "a25_org_cube": _with(PUNCH, ROSTER) + """SELECT cohort, kind, CAST(grouping(cohort, kind) AS INTEGER) AS level,
  count(*) AS punches, count(DISTINCT p.person) AS people
FROM p JOIN roster ON roster.person = p.person GROUP BY CUBE (cohort, kind)""",
    "a26_register": _with(PUNCH)
    + f"SELECT person, {_MONTH} FROM p WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY person",
    "a27_arrival_histogram": "SELECT date_trunc('hour', ts) AS window_start, count(*) AS punches FROM events GROUP BY 1",
    "a28_occupancy": _with(PUNCH, RANKED, PAIRS) + ",\n" + """change AS (
  SELECT in_ts AS ts, 1 AS came, 0 AS left_ FROM pairs WHERE out_ts IS NOT NULL
  UNION ALL SELECT out_ts, 0, 1 FROM pairs WHERE out_ts IS NOT NULL)
SELECT ts, CAST(sum(came) AS BIGINT) AS came, CAST(sum(left_) AS BIGINT) AS "left",
  CAST(sum(sum(came) - sum(left_)) OVER (ORDER BY ts) AS BIGINT) AS present
FROM change GROUP BY ts""",
    "a29_occupancy_by_hour": _with(PUNCH, DAILY) + """SELECT hour_start, count(*) AS people
FROM (SELECT unnest(range(date_trunc('hour', first_in), last_out + INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS hour_start FROM daily)
GROUP BY hour_start""",
    "a30_rolling_days": _with(PUNCH, DAILY) + """SELECT person, day, count(*) OVER (
  PARTITION BY person ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS days FROM daily""",
    "a31_top_attendance": _with(PUNCH, DAILY, ROSTER) + ",\n" + """counted AS (
  SELECT cohort, person, count(*) AS days FROM roster JOIN daily USING (person) GROUP BY cohort, person)
SELECT * FROM (
  SELECT cohort, CAST(row_number() OVER (PARTITION BY cohort ORDER BY days DESC, person) AS INTEGER) AS place, person, days
  FROM counted) WHERE place <= 3""",
    "a32_arrival_percentile": """SELECT user_id AS person,
  round(quantile_cont(hour(ts) * 60 + minute(ts), 0.9), 6) AS minute FROM events GROUP BY user_id""",
    "a33_week_change": _with(PUNCH, DAILY) + ",\n" + """weeks AS (
  SELECT person, CAST(date_trunc('week', day) AS DATE) AS week, count(*) AS days FROM daily GROUP BY 1, 2)
SELECT person, week, days, days - lag(days) OVER (PARTITION BY person ORDER BY week) AS change FROM weeks""",
    "a34_distinct_people": "SELECT count(DISTINCT user_id) AS people FROM events",
    "a34_distinct_people_sketch": "SELECT count(DISTINCT user_id) AS people, true AS within FROM events",
    "u01_apply_policy": _with(PUNCH, RANKED, PAIRS, WORKED) + ",\n" + """summed AS (
  SELECT person, day, minutes, sum(minutes - 480) OVER (PARTITION BY person, date_trunc('month', day) ORDER BY day) AS total
  FROM worked)
SELECT person, day, minutes, CAST(total - least(0, min(total) OVER (
  PARTITION BY person, date_trunc('month', day) ORDER BY day)) AS BIGINT) AS balance FROM summed""",
    "u02_classify": _with(PUNCH, RANKED, PAIRS, WORKED) + """SELECT person, day, minutes,
  CASE WHEN minutes < 240 THEN 'short' WHEN minutes <= 480 THEN 'full' ELSE 'long' END AS length FROM worked""",
    "s01_live_counts": "SELECT date_trunc('hour', ts) AS window_start, count(*) AS punches FROM events GROUP BY 1",
    "s02_live_dedup": _with(PUNCH) + "SELECT punch_id, person, ts, kind FROM p",
    "s03_live_sessions": _with(PUNCH, _SESSIONS) + "SELECT * FROM sessions",
    "s04_live_enrich": _with(PUNCH, ROSTER, ORG) + """SELECT p.punch_id, p.person, p.ts, org.cohort, org.nation, org.region
FROM p LEFT JOIN org ON org.person = p.person""",
    "s05_live_unmatched": _with(PUNCH) + """SELECT punch_id, person, ts FROM p i WHERE kind = 'signup'
  AND NOT EXISTS (SELECT 1 FROM p o WHERE o.kind = 'purchase' AND o.person = i.person
                  AND o.ts > i.ts AND o.ts <= i.ts + INTERVAL 12 HOUR)""",
    "s06_late_punches": _with(PUNCH) + """SELECT punch_id, person, ts FROM p
WHERE kind = 'error' AND day < DATE '2024-01-16' AND ts < (SELECT max(ts) - INTERVAL 10 MINUTE FROM p)""",
    "s06_settled_register": _with(PUNCH, DAILY) + "SELECT * FROM daily",
    "s07_live_state": _with(PUNCH) + ",\n" + """starts AS (
  SELECT person, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS starts
  FROM p WINDOW w AS (PARTITION BY person ORDER BY ts, punch_id)),
runs AS (
  SELECT person, ts, sum(starts) OVER (PARTITION BY person ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM starts),
toggled AS (
  SELECT person, ts, row_number() OVER w AS nth, lead(ts) OVER w AS next_ts FROM runs
  WINDOW w AS (PARTITION BY person, run ORDER BY ts)),
stays AS (
  SELECT person, ts AS in_ts, coalesce(next_ts, ts + INTERVAL 8 HOUR) AS out_ts,
         CASE WHEN next_ts IS NULL THEN 'timeout' ELSE 'punch' END AS closed_by
  FROM toggled WHERE nth % 2 = 1)
SELECT * FROM stays""",
}
