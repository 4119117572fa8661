"""Plain SQL for the same results, written from the definitions and run by another engine."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Lines rendered from the events table, parsed step by step.
_BASE = r"""
numbers AS (
  SELECT event_id AS k, user_id AS u, CAST(round(value) AS BIGINT) AS v, event_id // 12 AS j,
         (epoch_us(ts) - 1704067200000000) // 3600 AS t
  FROM events),
parts AS (
  SELECT *, CAST(t // 1000000 AS VARCHAR) || '.' || lpad(CAST(t % 1000000 AS VARCHAR), 6, '0') AS tt,
         '00000000-0000-4000-8000-' || lpad(CAST(u % 24 AS VARCHAR), 12, '0') AS boot,
         lpad(CAST(u % 8 AS VARCHAR), 40, '0') AS dev,
         '2024-01-' || lpad(CAST(1 + (k // 400) % 28 AS VARCHAR), 2, '0') || ' 00:'
           || lpad(CAST((k // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(k % 60 AS VARCHAR), 2, '0')
           || '.' || CAST(100000 + k % 800000 AS VARCHAR) AS dt
  FROM numbers),
bodies AS (
  SELECT *, CASE
    WHEN k % 12 = 0 THEN format('sched_cpu_hotplug: cpu {} {} error={}', j % 4,
      CASE WHEN v % 3 = 0 THEN 'offline' ELSE 'online' END, CASE WHEN v % 10 = 9 THEN -1 ELSE 0 END)
    WHEN k % 12 = 1 THEN format('thermal_temp: sensor_id={} temp={}', u % 6, 30 + v % 50)
    WHEN k % 12 = 2 THEN format('cpu_frequency: state={} cpu_id={}', 300000 * (1 + v % 5), j % 4)
    WHEN k % 12 = 3 THEN format('cpu_frequency: state={} cpu_id={}', 300000 * (1 + v % 7), (j + 1) % 4)
    WHEN k % 12 = 4 THEN format('phonelab_num_online_cpus: num_online_cpus={}', 1 + v % 4)
    WHEN k % 12 = 5 THEN format('phonelab_proc_foreground: pid={} tgid={} comm=app{}',
      CASE WHEN v % 2 = 0 THEN 0 ELSE 100 + v END, 100 + v, v % 5)
    WHEN k % 12 = 6 THEN format('phonelab_periodic_ctx_switch_marker: {} cpu={} count={} log_idx={}',
      CASE WHEN v % 2 = 0 THEN 'BEGIN' ELSE 'END' END, (v % 3) % 2, j, k)
    WHEN k % 12 IN (7, 8) THEN format('phonelab_periodic_ctx_switch_info: cpu={} pid={} tgid={} nice=0 comm={}'
      || ' utime=0 stime=0 rtime={} bg_utime=0 bg_stime=0 bg_rtime={} s_run=0 s_int=2 s_unint=0 s_oth=0 log_idx={}{}',
      v % 2, v, v, CASE WHEN v % 4 = 0 THEN 'swapper/0' ELSE 'kworker/0:1' END, 1000 + v, v, k,
      CASE WHEN k % 12 = 8 THEN ' rx=1 tx=2' ELSE '' END)
    WHEN k % 12 = 9 THEN format('<6>[   {}] healthd: battery l={} v={} t={}.5 h=2 st=3 c=-{} chg={}', tt,
      95 - (k // 700) % 40, 3900 + v, 25 + v % 15, v, CASE WHEN v % 13 = 0 THEN 'u' ELSE '' END)
    WHEN k % 12 = 10 AND j % 3 = 0 THEN format('<6>[{}] PM: suspend {} {} UTC', tt,
      CASE WHEN v % 2 = 0 THEN 'entry' ELSE 'exit' END, dt)
    WHEN k % 12 = 10 AND j % 3 = 1 THEN format('<6>[{}] msm_thermal: {} CPU{} Temp: {}', tt,
      CASE WHEN v % 2 = 0 THEN 'Set Offline:' ELSE 'Allow Online' END, v % 4, 60 + v % 30)
    WHEN k % 12 = 10 THEN format('<6>[{}] acpuclk-8974 qcom,acpuclk.30: ACPU PVS: {}', tt, u % 7)
    WHEN j % 3 = 0 THEN 'unknown_tag: a=1'
    ELSE format('cpu_frequency: state=300000 cpu_id={}', j % 4) END AS body
  FROM parts),
payloads AS (
  SELECT *, CASE WHEN k % 12 IN (9, 10) THEN body
    ELSE format('kworker/0:1-1 [00{}] ...1 {}: {}', u % 4, tt, body) END AS full_body
  FROM bodies),
text_lines AS (
  SELECT k AS line_no, dev AS file_device, CASE
    WHEN k % 12 = 11 AND j % 3 = 2 THEN 'dummy line'
    WHEN k % 12 = 11 AND j % 3 = 1 THEN
      format('{} {} {} [{}]   201   202 D Kernel-Trace:      {}', boot, dt, k, tt, full_body)
    ELSE concat_ws('  ', dev, t, t || '.0', boot, k, tt, dt, '201', '202', 'D',
      CASE WHEN k % 12 IN (9, 10) THEN 'KernelPrintk' ELSE 'Kernel-Trace' END, full_body) END AS line
  FROM payloads),
words AS (
  SELECT *, regexp_split_to_array(line, '\s+') AS w, regexp_matches(line, '^[a-z0-9]+\s+\d+\s+\d+\.\d+\s') AS by_device
  FROM text_lines WHERE line LIKE '%-%-%:%'),
loglines AS (
  SELECT line,
    CASE WHEN by_device THEN w[1] ELSE file_device END AS device_id,
    CASE WHEN by_device THEN w[4] ELSE w[1] END AS boot_id,
    CASE WHEN by_device THEN w[7] || ' ' || w[8] ELSE w[2] || ' ' || w[3] END AS stamp,
    CAST(CASE WHEN by_device THEN w[5] ELSE w[4] END AS BIGINT) AS logcat_token,
    CAST(CAST(CASE WHEN by_device THEN w[6] ELSE trim(w[5], '[]') END AS DECIMAL(18,6)) * 1000000 AS BIGINT) AS trace_us,
    CAST(CASE WHEN by_device THEN w[9] ELSE w[6] END AS INTEGER) AS pid,
    CAST(CASE WHEN by_device THEN w[10] ELSE w[7] END AS INTEGER) AS tid,
    CASE WHEN by_device THEN w[11] ELSE w[8] END AS level,
    CASE WHEN by_device THEN w[12] ELSE rtrim(w[9], ':') END AS tag,
    CASE WHEN by_device THEN regexp_extract(line, '^(?:\S+\s+){12}(.*)$', 1)
         ELSE regexp_extract(line, '^(?:\S+\s+){9}(.*)$', 1) END AS payload
  FROM words),
trace AS (
  SELECT *, regexp_extract(payload, '^(\S+) \[', 1) AS thread,
    CAST(regexp_extract(payload, '\[(\d+)\]', 1) AS INTEGER) AS trace_cpu,
    regexp_extract(payload, '\] (....) ', 1) AS flags,
    round(CAST(regexp_extract(payload, '(\d+\.\d+): ', 1) AS DOUBLE), 9) AS trace_timestamp,
    regexp_extract(payload, '\d+\.\d+: (\w+): ', 1) AS trace_tag,
    regexp_extract(payload, '\d+\.\d+: \w+: (.*)$', 1) AS text
  FROM loglines WHERE tag = 'Kernel-Trace'),
hotplug AS (
  SELECT *, CAST(split_part(text, ' ', 2) AS INTEGER) AS cpu, split_part(text, ' ', 3) AS state,
    CAST(split_part(text, '=', 2) AS INTEGER) AS error
  FROM trace WHERE trace_tag = 'sched_cpu_hotplug'),
frequency AS (
  SELECT *, CAST(regexp_extract(text, 'state=(\d+)', 1) AS INTEGER) AS freq,
    CAST(regexp_extract(text, 'cpu_id=(\d+)', 1) AS INTEGER) AS cpu
  FROM trace WHERE trace_tag = 'cpu_frequency'),
thermal AS (
  SELECT *, CAST(regexp_extract(text, 'sensor_id=(\d+)', 1) AS INTEGER) AS sensor_id,
    CAST(regexp_extract(text, 'temp=(\d+)', 1) AS INTEGER) AS temp
  FROM trace WHERE trace_tag = 'thermal_temp'),
online AS (
  SELECT *, CAST(split_part(text, '=', 2) AS INTEGER) AS num_online_cpus
  FROM trace WHERE trace_tag = 'phonelab_num_online_cpus'),
foreground AS (
  SELECT *, CAST(regexp_extract(text, '^pid=(\d+)', 1) AS INTEGER) AS fg_pid,
    CAST(regexp_extract(text, 'tgid=(\d+)', 1) AS INTEGER) AS fg_tgid, split_part(text, 'comm=', 2) AS comm
  FROM trace WHERE trace_tag = 'phonelab_proc_foreground'),
marker AS (
  SELECT *, split_part(text, ' ', 1) AS marker, CAST(regexp_extract(text, 'cpu=(\d+)', 1) AS INTEGER) AS cpu,
    CAST(regexp_extract(text, 'count=(\d+)', 1) AS INTEGER) AS "count",
    CAST(regexp_extract(text, 'log_idx=(\d+)', 1) AS BIGINT) AS log_idx
  FROM trace WHERE trace_tag = 'phonelab_periodic_ctx_switch_marker'),
info AS (
  SELECT *, CAST(regexp_extract(text, '^cpu=(\d+)', 1) AS INTEGER) AS cpu,
    CAST(regexp_extract(text, ' pid=(\d+)', 1) AS INTEGER) AS task_pid,
    CAST(regexp_extract(text, ' tgid=(\d+)', 1) AS INTEGER) AS task_tgid,
    CAST(regexp_extract(text, ' nice=(-?\d+)', 1) AS INTEGER) AS nice,
    regexp_extract(text, ' comm=(.*) utime', 1) AS comm,
    CAST(regexp_extract(text, ' utime=(\d+)', 1) AS BIGINT) AS utime,
    CAST(regexp_extract(text, ' stime=(\d+)', 1) AS BIGINT) AS stime,
    CAST(regexp_extract(text, ' rtime=(\d+)', 1) AS BIGINT) AS rtime,
    CAST(regexp_extract(text, ' bg_utime=(\d+)', 1) AS BIGINT) AS bg_utime,
    CAST(regexp_extract(text, ' bg_stime=(\d+)', 1) AS BIGINT) AS bg_stime,
    CAST(regexp_extract(text, ' bg_rtime=(\d+)', 1) AS BIGINT) AS bg_rtime,
    CAST(regexp_extract(text, ' s_run=(\d+)', 1) AS BIGINT) AS s_run,
    CAST(regexp_extract(text, ' s_int=(\d+)', 1) AS BIGINT) AS s_int,
    CAST(regexp_extract(text, ' s_unint=(\d+)', 1) AS BIGINT) AS s_unint,
    CAST(regexp_extract(text, ' s_oth=(\d+)', 1) AS BIGINT) AS s_oth,
    CAST(regexp_extract(text, ' log_idx=(\d+)', 1) AS BIGINT) AS log_idx,
    coalesce(TRY_CAST(regexp_extract(text, ' rx=(\d+)', 1) AS BIGINT), 0) AS rx,
    coalesce(TRY_CAST(regexp_extract(text, ' tx=(\d+)', 1) AS BIGINT), 0) AS tx
  FROM trace WHERE trace_tag = 'phonelab_periodic_ctx_switch_info'),
healthd AS (
  SELECT *, round(CAST(regexp_extract(payload, '\[\s*(\d+\.\d+)\]', 1) AS DOUBLE), 9) AS "timestamp",
    CAST(regexp_extract(payload, ' l=(\d+)', 1) AS INTEGER) AS l,
    CAST(regexp_extract(payload, ' v=(\d+)', 1) AS INTEGER) AS v,
    CAST(regexp_extract(payload, ' t=(\d+\.\d+)', 1) AS DOUBLE) AS t,
    CAST(regexp_extract(payload, ' h=(-?\d+)', 1) AS INTEGER) AS h,
    CAST(regexp_extract(payload, ' st=(-?\d+)', 1) AS INTEGER) AS st,
    CAST(regexp_extract(payload, ' c=(-?\d+)', 1) AS INTEGER) AS c,
    split_part(payload, 'chg=', 2) AS chg
  FROM loglines WHERE payload LIKE '%healthd: battery%'),
power AS (
  SELECT *, regexp_extract(payload, 'PM: suspend (\w+)', 1) AS power,
    epoch_us(CAST(regexp_extract(payload, '(\d{4}-\S+ \S+) UTC', 1) AS TIMESTAMP)) AS power_time_us
  FROM loglines WHERE payload LIKE '%PM: suspend e%'),
pvs AS (
  SELECT *, CAST(regexp_extract(payload, 'PVS: (\d+)$', 1) AS INTEGER) AS pvs_bin,
    round(CAST(regexp_extract(payload, '\[\s*(\d+\.\d+)\]', 1) AS DOUBLE), 9) AS "timestamp"
  FROM loglines WHERE payload LIKE '%ACPU PVS:%'),
cpu_rows AS (
  SELECT device_id, boot_id, logcat_token, trace_us, cpu, freq, CAST(NULL AS VARCHAR) AS word, CAST(NULL AS INTEGER) AS error
  FROM frequency
  UNION ALL
  SELECT device_id, boot_id, logcat_token, trace_us, cpu, NULL, state, error FROM hotplug),
sampled AS (
  SELECT l.device_id, l.boot_id, l.logcat_token, l.trace_us, f.fg_pid,
    coalesce(last_value(f.fg_pid IGNORE NULLS) OVER w, 0) AS active_pid,
    last_value(CASE WHEN f.fg_pid IS NOT NULL THEN l.trace_us END IGNORE NULLS) OVER w AS event_us,
    last_value(CASE WHEN f.fg_pid IS NOT NULL THEN l.logcat_token END IGNORE NULLS) OVER w AS event_token
  FROM loglines l LEFT JOIN foreground f USING (device_id, boot_id, logcat_token)
  WINDOW w AS (PARTITION BY l.device_id, l.boot_id ORDER BY l.logcat_token
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fgbg_marks AS (
  SELECT *, CASE WHEN event_us IS NULL THEN NULL WHEN active_pid <> 0 THEN 'FOREGROUND'
                 WHEN trace_us - event_us > 1000000 THEN 'BACKGROUND' END AS mark
  FROM sampled),
fgbg AS (
  SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER w, 'UNKNOWN') AS fgbg_state,
    coalesce(last_value(mark IGNORE NULLS) OVER p, 'UNKNOWN') AS old_state,
    row_number() OVER (PARTITION BY device_id, boot_id, event_token, mark ORDER BY logcat_token) AS nth
  FROM fgbg_marks
  WINDOW w AS (PARTITION BY device_id, boot_id ORDER BY logcat_token
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         p AS (PARTITION BY device_id, boot_id ORDER BY logcat_token
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
"""

_TRACKED = r"""
charging AS (
  SELECT l.device_id, l.boot_id, l.logcat_token, h.l IS NOT NULL AS is_charging_event,
    coalesce(last_value(CASE WHEN h.chg = '' THEN 'CHARGING' WHEN h.chg <> '' THEN 'UNPLUGGED' END IGNORE NULLS) OVER w,
             'UNKNOWN') AS charging_state,
    coalesce(last_value(CASE WHEN p.power = 'entry' THEN 'SUSPENDED' WHEN p.power = 'exit' THEN 'AWAKE' END IGNORE NULLS)
             OVER w, 'UNKNOWN') AS suspend_state,
    p.power IS NOT NULL AS is_suspend_event
  FROM loglines l
  LEFT JOIN healthd h USING (device_id, boot_id, logcat_token)
  LEFT JOIN power p USING (device_id, boot_id, logcat_token)
  WINDOW w AS (PARTITION BY l.device_id, l.boot_id ORDER BY l.logcat_token
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
power_steps AS (
  SELECT device_id, boot_id, logcat_token, power, trace_us,
    CASE WHEN power = 'entry' THEN 'SUSPENDED' ELSE 'AWAKE' END AS new_state,
    lag(power) OVER w AS before, lag(trace_us) OVER w AS before_us
  FROM power WINDOW w AS (PARTITION BY device_id, boot_id ORDER BY logcat_token)),
cpu_tracked AS (
  SELECT *,
    last_value(CASE WHEN freq IS NOT NULL OR (word = 'online' AND error = 0) THEN 'ONLINE'
                    WHEN word = 'offline' AND error = 0 THEN 'OFFLINE' END IGNORE NULLS) OVER w AS state_at,
    last_value(freq IGNORE NULLS) OVER w AS freq_at,
    last_value(CASE WHEN freq IS NOT NULL OR (word = 'online' AND error = 0) THEN 'ONLINE'
                    WHEN word = 'offline' AND error = 0 THEN 'OFFLINE' END IGNORE NULLS) OVER p AS state_before,
    last_value(freq IGNORE NULLS) OVER p AS freq_before,
    last_value(CASE WHEN freq IS NOT NULL THEN trace_us END IGNORE NULLS) OVER p AS since_us,
    last_value(CASE WHEN freq IS NOT NULL THEN freq WHEN word = 'offline' THEN 0 END IGNORE NULLS) OVER p AS open_freq,
    last_value(CASE WHEN freq IS NOT NULL OR word = 'offline' THEN trace_us END IGNORE NULLS) OVER p AS open_us
  FROM cpu_rows
  WINDOW w AS (PARTITION BY device_id, boot_id, cpu ORDER BY logcat_token
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         p AS (PARTITION BY device_id, boot_id, cpu ORDER BY logcat_token
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
spans AS (
  SELECT device_id, boot_id, cpu, logcat_token, freq_before AS freq, trace_us - since_us AS duration_us
  FROM cpu_tracked WHERE (freq IS NOT NULL OR word = 'offline') AND freq_before <> 0),
closed_spans AS (
  SELECT device_id, boot_id, cpu, logcat_token, open_freq AS freq, trace_us - open_us AS duration_us
  FROM cpu_tracked WHERE (freq IS NOT NULL OR word = 'offline') AND open_freq <> 0),
online_spans AS (
  SELECT * FROM (
    SELECT device_id, boot_id, logcat_token, lag(num_online_cpus) OVER w AS num_online_cpus,
           trace_us - lag(trace_us) OVER w AS duration_us
    FROM online WINDOW w AS (PARTITION BY device_id, boot_id ORDER BY logcat_token))
  WHERE num_online_cpus IS NOT NULL),
per_cpu AS (
  SELECT c.device_id, c.boot_id, c.logcat_token, c.trace_us, n.cpu AS n,
    last_value(CASE WHEN c.cpu = n.cpu AND c.word IN ('online', 'offline') THEN c.word END IGNORE NULLS) OVER p AS word,
    last_value(CASE WHEN c.cpu = n.cpu THEN coalesce(c.freq, CASE WHEN c.word = 'offline' THEN -1 END) END IGNORE NULLS)
      OVER p AS freq
  FROM cpu_rows c, range(4) n(cpu) WHERE coalesce(c.error, 0) = 0
  WINDOW p AS (PARTITION BY c.device_id, c.boot_id, n.cpu ORDER BY c.logcat_token
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
combined AS (
  SELECT device_id, boot_id, logcat_token, any_value(trace_us) AS trace_us,
    bool_and(coalesce(word = 'offline' OR (coalesce(word, 'online') = 'online' AND freq <> -1), false)) AS is_full,
    coalesce(string_agg(CAST(freq AS VARCHAR), '-' ORDER BY CAST(freq AS VARCHAR))
      FILTER (coalesce(word, 'online') = 'online'), '') AS freq_key
  FROM per_cpu GROUP BY device_id, boot_id, logcat_token),
combinations AS (
  SELECT device_id, boot_id, logcat_token, freq_key,
    trace_us - coalesce(lag(trace_us) OVER (PARTITION BY device_id, boot_id ORDER BY logcat_token), first_us) AS duration_us
  FROM (SELECT *, first_value(trace_us) OVER (PARTITION BY device_id, boot_id ORDER BY logcat_token) AS first_us
        FROM combined)
  WHERE is_full),
combination_extent AS (
  SELECT device_id, boot_id, arg_max(trace_us, logcat_token) - arg_min(trace_us, logcat_token) AS boot_us
  FROM cpu_rows WHERE coalesce(error, 0) = 0 GROUP BY ALL),
online_extent AS (
  SELECT device_id, boot_id, arg_max(trace_us, logcat_token) - arg_min(trace_us, logcat_token) AS boot_us
  FROM online GROUP BY ALL),
online_shares AS (
  SELECT num_online_cpus, s.device_id, s.boot_id, CAST(sum(duration_us) AS BIGINT) AS duration_us,
    CASE WHEN boot_us <> 0 THEN CAST(sum(duration_us) AS DOUBLE) / boot_us END AS share
  FROM online_spans s JOIN online_extent USING (device_id, boot_id)
  GROUP BY num_online_cpus, s.device_id, s.boot_id, boot_us),
"""

# Sessions: which markers open and close, then the rows between them.
_SESSIONS = r"""
ctx_rows AS (
  SELECT device_id, boot_id, cpu, logcat_token, marker, NULL AS comm, NULL AS rtime, NULL AS bg_rtime FROM marker
  UNION ALL
  SELECT device_id, boot_id, cpu, logcat_token, NULL, comm, rtime, bg_rtime FROM info),
ctx_ends AS (
  SELECT *, coalesce(sum(CASE WHEN marker = 'END' THEN 1 ELSE 0 END) OVER (
      PARTITION BY device_id, boot_id, cpu ORDER BY logcat_token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS island
  FROM ctx_rows),
ctx_bounds AS (
  SELECT device_id, boot_id, cpu, island, min(logcat_token) FILTER (marker = 'BEGIN') AS start_token,
    min(logcat_token) FILTER (marker = 'END') AS end_token
  FROM ctx_ends GROUP BY ALL),
ctx_members AS (
  SELECT c.device_id, c.boot_id, c.cpu, c.logcat_token, c.marker, c.comm, c.rtime, c.bg_rtime, start_token, end_token
  FROM ctx_ends c JOIN ctx_bounds b USING (device_id, boot_id, cpu, island)
  WHERE start_token < end_token AND logcat_token BETWEEN start_token AND end_token
    AND (marker IS NULL OR logcat_token IN (start_token, end_token))),
ctx_metrics AS (
  SELECT device_id, boot_id, cpu, start_token, end_token, CAST(coalesce(sum(rtime), 0) AS BIGINT) AS total_time,
    coalesce(sum(rtime) FILTER (comm NOT LIKE '%swapper%'), 0) AS busy,
    coalesce(sum(bg_rtime) FILTER (comm NOT LIKE '%swapper%'), 0) AS bg_busy
  FROM ctx_members GROUP BY ALL),
"""


def _chunks(reports: str) -> str:
    """The battery state machine, row by row, over the named reports."""
    return f"""
reports AS (
  SELECT device_id, boot_id, logcat_token AS token, l, t, chg,
    row_number() OVER (PARTITION BY device_id, boot_id ORDER BY logcat_token) AS n
  FROM {reports}),
steps(device_id, boot_id, n, token, waiting, x, opens, closes) AS (
  SELECT device_id, boot_id, n, token, true, l, false, false FROM reports WHERE n = 1
  UNION ALL
  SELECT r.device_id, r.boot_id, r.n, r.token,
    CASE WHEN r.chg <> '' THEN true WHEN s.waiting THEN r.l >= s.x ELSE false END,
    CASE WHEN r.chg <> '' THEN r.l WHEN s.waiting AND r.l < s.x THEN r.l
         WHEN NOT s.waiting AND r.l = s.x - 1 THEN r.l ELSE s.x END,
    r.chg = '' AND ((s.waiting AND r.l < s.x) OR (NOT s.waiting AND r.l = s.x - 1)),
    r.chg = '' AND NOT s.waiting AND r.l = s.x - 1
  FROM steps s JOIN reports r ON r.device_id = s.device_id AND r.boot_id = s.boot_id AND r.n = s.n + 1),
bounds AS (
  SELECT device_id, boot_id, token, x, closes, lag(token) OVER (PARTITION BY device_id, boot_id ORDER BY n) AS opened
  FROM steps WHERE opens),
chunks AS (
  SELECT b.device_id, b.boot_id, b.opened AS start_token, b.token AS end_token, s.l AS start_level, e.l AS end_level,
    s.t AS start_temp, e.t AS end_temp
  FROM bounds b
  JOIN reports s ON s.device_id = b.device_id AND s.boot_id = b.boot_id AND s.token = b.opened
  JOIN reports e ON e.device_id = b.device_id AND e.boot_id = b.boot_id AND e.token = b.token
  WHERE closes),
"""


_MEMBERS = r"""
members AS (
  SELECT c.device_id, c.boot_id, start_token, end_token, l.logcat_token, l.payload
  FROM chunks c JOIN loglines l ON l.device_id = c.device_id AND l.boot_id = c.boot_id
    AND l.logcat_token > start_token AND l.logcat_token < end_token
  LEFT JOIN healthd h ON h.device_id = l.device_id AND h.boot_id = l.boot_id AND h.logcat_token = l.logcat_token
  WHERE h.l IS NULL OR (h.chg = '' AND h.l = start_level)),
"""

_DENSE = r"""
dense AS (
  SELECT *, n + n // 50 AS seq FROM (
    SELECT *, row_number() OVER (PARTITION BY device_id, boot_id ORDER BY logcat_token) AS n FROM loglines)),
dense_reports AS (
  SELECT h.device_id, h.boot_id, d.seq AS logcat_token, l, t, chg
  FROM healthd h JOIN dense d USING (device_id, boot_id, logcat_token)),
"""

_DENSE_MEMBERS = r"""
dense_members AS (
  SELECT c.device_id, c.boot_id, start_token, end_token, d.seq
  FROM chunks c JOIN dense d ON d.device_id = c.device_id AND d.boot_id = c.boot_id
    AND d.seq > start_token AND d.seq < end_token
  LEFT JOIN dense_reports h ON h.device_id = d.device_id AND h.boot_id = d.boot_id AND h.logcat_token = d.seq
  WHERE h.l IS NULL OR (h.chg = '' AND h.l = start_level)),
"""


def oracle(name: str, select: str, *more: str) -> None:
    parts = "".join(more)
    recursive = " RECURSIVE" if "steps(" in parts else ""
    ORACLES[name] = f"WITH{recursive} {(_BASE + parts).rstrip().rstrip(',')}\n{select}"


AT = "device_id, boot_id, logcat_token"

oracle("parse_loglines", f"""SELECT {AT}, epoch_us(CAST(stamp AS TIMESTAMP)) AS datetime_us,
  CAST(substr(stamp, 21) AS BIGINT) AS datetime_nanos, trace_us, pid, tid, level, tag, payload FROM loglines""")
oracle("line_round_trip", "SELECT line_no AS logcat_token, line FROM text_lines WHERE line <> 'dummy line'")
oracle("rejected_lines", "SELECT line_no, line FROM text_lines WHERE line = 'dummy line'")
oracle("parse_trace", f"SELECT {AT}, thread, trace_cpu, flags, trace_timestamp, trace_tag, text FROM trace")
oracle("trace_dispatch", "SELECT trace_tag, count(*) AS events FROM trace WHERE trace_tag <> 'unknown_tag' GROUP BY 1")
oracle("int_parse", """SELECT event_id, TRY_CAST(CAST(event_id * 1000003 AS VARCHAR) AS INTEGER) AS strict32,
  coalesce(TRY_CAST(CAST(event_id * 1000003 AS VARCHAR) AS INTEGER), 0) AS zero32,
  event_id * 1000003 AS strict64 FROM events""")
for _name, _table, _columns in [
    ("hotplug_events", "hotplug", "cpu, state, error"),
    ("thermal_events", "thermal", "sensor_id, temp"),
    ("cpu_frequency_events", "frequency", "freq, cpu"),
    ("num_online_cpus_events", "online", "num_online_cpus"),
    ("proc_foreground_events", "foreground", "fg_pid, fg_tgid, comm"),
    ("ctx_switch_marker_events", "marker", 'marker, cpu, "count", log_idx'),
    ("ctx_switch_info_events", "info", "cpu, task_pid, task_tgid, nice, comm, utime, stime, rtime, bg_utime, bg_stime,"
     " bg_rtime, s_run, s_int, s_unint, s_oth, log_idx, rx, tx"),
    ("power_events", "power", "power, power_time_us"),
    ("healthd_events", "healthd", '"timestamp", l, v, t, h, st, c, chg'),
    ("pvs_events", "pvs", '"timestamp", pvs_bin'),
    ("pvs_last_digit", "pvs", "pvs_bin"),
    ("cpu_events", "cpu_rows", "cpu, freq, word, error"),
]:
    oracle(_name, f"SELECT {AT}, {_columns} FROM {_table}")
oracle("msm_thermal_events", rf"""SELECT {AT},
  CASE WHEN payload LIKE '%Set Offline%' THEN 'OFFLINE' ELSE 'ONLINE' END AS state,
  CAST(regexp_extract(payload, 'CPU(\d+)', 1) AS INTEGER) AS cpu,
  CAST(regexp_extract(payload, 'Temp: (\d+)', 1) AS INTEGER) AS temp FROM loglines WHERE payload LIKE '%msm_thermal%'""")

for _name, _where in [
    ("freq_prefilter", "line LIKE '%Kernel-Trace%' AND (line LIKE '%cpu\\_frequency%' ESCAPE '\\' OR line LIKE '%sched\\_cpu\\_hotplug%' ESCAPE '\\')"),
    ("freq_prefilter_colon", "line LIKE '%Kernel-Trace%' AND (contains(line, 'cpu_frequency:') OR contains(line, 'sched_cpu_hotplug:'))"),
    ("ncpu_prefilter", "line LIKE '%Kernel-Trace%' AND contains(line, 'num_online_cpus')"),
    ("thermal_prefilter", "contains(line, 'thermal_temp')"),
    ("pvs_prefilter", "line LIKE '%ACPU PVS:%'"),
    ("healthd_predicate", "tag = 'KernelPrintk' AND payload LIKE '%healthd%chg%'"),
    ("power_predicate", "line LIKE '%KernelPrintk%' AND line LIKE '%PM: suspend e%'"),
    ("line_filter", "line LIKE '%Kernel-Trace%' AND contains(line, 'cpu_id=0')"),
]:
    oracle(_name, f"SELECT {AT} FROM loglines WHERE {_where}")

oracle("charging_state", f"SELECT {AT}, charging_state, is_charging_event FROM charging", _TRACKED)
oracle("charging_transitions", f"""SELECT {AT}, CASE WHEN chg = '' THEN 'CHARGING' ELSE 'UNPLUGGED' END AS new_state,
  CASE lag(chg = '') OVER (PARTITION BY device_id, boot_id ORDER BY logcat_token)
    WHEN true THEN 'CHARGING' WHEN false THEN 'UNPLUGGED' ELSE 'UNKNOWN' END AS old_state FROM healthd""")
oracle("in_state", f"SELECT {AT} FROM charging WHERE charging_state = 'UNPLUGGED'", _TRACKED)
oracle("exclusive", f"SELECT {AT}, suspend_state FROM charging WHERE is_suspend_event", _TRACKED)
oracle("suspend_state", f"SELECT {AT}, suspend_state FROM charging", _TRACKED)
oracle("apply_all", """SELECT charging_state, suspend_state, active_pid <> 0 AS active, count(*) AS lines
  FROM charging JOIN sampled USING (device_id, boot_id, logcat_token) GROUP BY ALL""", _TRACKED)
oracle("suspend_transitions", f"""SELECT {AT}, new_state,
  CASE before WHEN 'entry' THEN 'SUSPENDED' WHEN 'exit' THEN 'AWAKE' ELSE 'UNKNOWN' END AS old_state,
  CASE WHEN power = 'entry' AND before = 'entry' THEN 'entry while suspended'
       WHEN power = 'exit' AND coalesce(before, 'exit') = 'exit' THEN 'exit while not suspended' END AS anomaly
  FROM power_steps""", _TRACKED)
oracle("suspend_intervals", """SELECT device_id, boot_id, before_us AS entry_us, trace_us AS exit_us,
  trace_us - before_us AS suspended_us FROM power_steps WHERE power = 'exit' AND before = 'entry'""", _TRACKED)
oracle("fgbg_state", f"SELECT {AT}, fgbg_state FROM fgbg")
for _name in ("fgbg_transitions", "fgbg_stream", "fgbg_stream_late"):
    oracle(_name, f"""SELECT {AT}, old_state, mark AS new_state FROM fgbg
      WHERE (mark = 'BACKGROUND' AND nth = 1) OR fg_pid <> 0""")
oracle("active_pid", f"SELECT {AT}, active_pid FROM sampled")
oracle("active_use", f"SELECT {AT} FROM sampled WHERE active_pid <> 0")
oracle("cpu_state", f"""SELECT {AT}, cpu, coalesce(state_at, 'UNKNOWN') AS cpu_state, coalesce(freq_at, 0) AS cpu_freq
  FROM cpu_tracked""", _TRACKED)
oracle("cpu_state_before", f"""SELECT {AT}, cpu, coalesce(state_before, 'UNKNOWN') AS cpu_state,
  coalesce(freq_before, 0) AS cpu_freq FROM cpu_tracked""", _TRACKED)
oracle("day_boundaries", f"""SELECT * FROM (SELECT {AT},
    CAST(lag(dayofyear(CAST(stamp AS TIMESTAMP))) OVER (PARTITION BY device_id, boot_id ORDER BY logcat_token) AS INTEGER) AS old_day,
    CAST(dayofyear(CAST(stamp AS TIMESTAMP)) AS INTEGER) AS new_day FROM loglines) WHERE old_day <> new_day""")

_PERIOD_US = (5 * 60 + 7) * 60_000_000
_PERIODS = f"""
timed AS (SELECT device_id, boot_id, logcat_token, epoch_us(CAST(stamp AS TIMESTAMP)) AS us FROM loglines),
period_steps(device_id, boot_id, logcat_token, us, old_us) AS (
  SELECT device_id, boot_id, logcat_token, us, CAST(NULL AS BIGINT) FROM timed
  QUALIFY row_number() OVER (PARTITION BY device_id, boot_id ORDER BY logcat_token) = 1
  UNION ALL
  SELECT s.device_id, s.boot_id, t.logcat_token, t.us, s.us
  FROM period_steps s JOIN timed t ON t.device_id = s.device_id AND t.boot_id = s.boot_id
  WHERE t.logcat_token = (SELECT min(m.logcat_token) FROM timed m WHERE m.device_id = s.device_id
    AND m.boot_id = s.boot_id AND m.logcat_token > s.logcat_token AND m.us >= s.us + {_PERIOD_US})),
"""
oracle("period_boundaries", f"SELECT {AT}, old_us AS old_start, us AS new_start FROM period_steps WHERE old_us IS NOT NULL", _PERIODS)
_HEAT = """
degrees AS (SELECT device_id, boot_id, logcat_token, CASE WHEN temp % 2 = 1 THEN 1 ELSE -1 END AS step,
    row_number() OVER (PARTITION BY device_id, boot_id ORDER BY logcat_token) AS n FROM thermal),
heat_steps(device_id, boot_id, n, logcat_token, heat) AS (
  SELECT device_id, boot_id, n, logcat_token, greatest(step, 0) FROM degrees WHERE n = 1
  UNION ALL
  SELECT d.device_id, d.boot_id, d.n, d.logcat_token, least(greatest(s.heat + d.step, 0), 2)
  FROM heat_steps s JOIN degrees d ON d.device_id = s.device_id AND d.boot_id = s.boot_id AND d.n = s.n + 1),
heated AS (
  SELECT c.device_id, c.boot_id, c.logcat_token, c.suspend_state,
    last_value(heat IGNORE NULLS) OVER (PARTITION BY c.device_id, c.boot_id ORDER BY c.logcat_token
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heat
  FROM charging c LEFT JOIN heat_steps h ON h.device_id = c.device_id AND h.boot_id = c.boot_id AND h.logcat_token = c.logcat_token),
"""
oracle("custom_tracker", f"""SELECT {AT}, suspend_state,
  CASE coalesce(heat, 0) WHEN 0 THEN 'cool' WHEN 1 THEN 'warm' ELSE 'hot' END AS heat FROM heated""", _TRACKED, _HEAT)

oracle("freq_spans", "SELECT * FROM spans", _TRACKED)
oracle("freq_spans_closed", "SELECT * FROM closed_spans", _TRACKED)
oracle("ncpu_spans", "SELECT * FROM online_spans", _TRACKED)
oracle("freq_combinations", "SELECT * FROM combinations", _TRACKED)
oracle("freq_time_total", "SELECT freq, CAST(sum(duration_us) AS BIGINT) AS total_us FROM spans GROUP BY freq", _TRACKED)
oracle("freq_combination_share", """SELECT freq_key, c.device_id, c.boot_id, CAST(sum(duration_us) AS BIGINT) AS duration_us,
  round(CASE WHEN boot_us <> 0 THEN CAST(sum(duration_us) AS DOUBLE) / boot_us END, 9) AS share
  FROM combinations c JOIN combination_extent USING (device_id, boot_id)
  GROUP BY freq_key, c.device_id, c.boot_id, boot_us""", _TRACKED)
oracle("ncpu_share", """SELECT num_online_cpus, device_id, boot_id, duration_us, round(share, 9) AS share
  FROM online_shares""", _TRACKED)
oracle("ncpu_share_lists", """SELECT num_online_cpus, 0 AS part,
  string_agg(CAST(CAST(round(share * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY share) AS millionths
  FROM online_shares GROUP BY num_online_cpus""", _TRACKED)
oracle("combination_lists_file", """SELECT freq_key, 0 AS part,
  string_agg(CAST(CAST(round(share * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY share) AS millionths
  FROM (SELECT freq_key, CAST(sum(duration_us) AS DOUBLE) / boot_us AS share
        FROM combinations c JOIN combination_extent USING (device_id, boot_id) WHERE boot_us <> 0
        GROUP BY freq_key, c.device_id, c.boot_id, boot_us) GROUP BY freq_key""", _TRACKED)
oracle("temp_histogram", """SELECT temp, count(*) AS samples FROM thermal t
  JOIN sampled s USING (device_id, boot_id, logcat_token) WHERE active_pid <> 0 GROUP BY temp""")
oracle("pvs_by_device", """SELECT device_id, arg_min(pvs_bin, boot_id || lpad(CAST(logcat_token AS VARCHAR), 20, '0')) AS pvs_bin
  FROM pvs GROUP BY device_id""")
oracle("thermal_line_counts", "SELECT device_id, count(*) AS lines FROM thermal GROUP BY device_id")
oracle("extract_thermal_lines", "SELECT device_id, line FROM thermal")

oracle("ctx_switch_sessions", f"SELECT {AT}, cpu, marker, rtime, comm, start_token, end_token FROM ctx_members", _SESSIONS)
_SESSION = "device_id, boot_id, cpu, start_token, end_token"
oracle("ctx_total_time", f"SELECT {_SESSION}, total_time FROM ctx_metrics", _SESSIONS)
for _name, _value in [("busyness", "busy"), ("fg_busyness", "busy - bg_busy"), ("bg_busyness", "bg_busy")]:
    oracle(f"ctx_{_name}", f"""SELECT {_SESSION}, round(CASE WHEN total_time = 0 THEN 0.0::DOUBLE
      ELSE CAST({_value} AS DOUBLE) / total_time END, 9) AS {_name} FROM ctx_metrics""", _SESSIONS)

_CHUNK = "device_id, boot_id, start_token, end_token"
_CUT = _chunks("healthd")
oracle("discharge_chunks", "SELECT * FROM chunks", _CUT)
oracle("chunk_lines", f"SELECT {_CHUNK}, logcat_token FROM members", _CUT, _MEMBERS)
oracle("chunk_cpu_state", f"""SELECT {_CHUNK}, cpu, coalesce(arg_max(CASE WHEN freq IS NOT NULL OR (word = 'online' AND error = 0) THEN 'ONLINE'
      WHEN word = 'offline' AND error = 0 THEN 'OFFLINE' END, logcat_token)
      FILTER (freq IS NOT NULL OR (word IN ('online', 'offline') AND error = 0)), 'UNKNOWN') AS cpu_state,
  coalesce(arg_max(freq, logcat_token) FILTER (freq IS NOT NULL), 0) AS cpu_freq
  FROM chunks JOIN cpu_rows USING (device_id, boot_id) WHERE logcat_token <= start_token GROUP BY {_CHUNK}, cpu""", _CUT)
oracle("chunk_fgbg_state", f"""SELECT {_CHUNK.replace('device_id, boot_id', 'c.device_id, c.boot_id')}, fgbg_state
  FROM chunks c JOIN fgbg f ON f.device_id = c.device_id AND f.boot_id = c.boot_id AND f.logcat_token = start_token""", _CUT)
oracle("chunk_devices_reload", f"""SELECT c.device_id, c.boot_id, start_token, end_token,
  (SELECT count(*) FROM members m WHERE m.device_id = c.device_id AND m.boot_id = c.boot_id AND m.start_token = c.start_token) AS lines,
  (SELECT nullif(count(DISTINCT r.cpu), 0) FROM cpu_rows r WHERE r.device_id = c.device_id AND r.boot_id = c.boot_id
     AND r.logcat_token <= c.start_token) AS cpus, fgbg_state
  FROM chunks c JOIN fgbg f ON f.device_id = c.device_id AND f.boot_id = c.boot_id AND f.logcat_token = start_token
  WHERE c.device_id NOT LIKE '%3'""", _CUT, _MEMBERS)
oracle("chunk_dumps", f"""SELECT c.device_id, c.boot_id, start_token, end_token, start_level - end_level AS drop,
  (SELECT count(*) FROM members m WHERE m.device_id = c.device_id AND m.boot_id = c.boot_id AND m.start_token = c.start_token) AS lines,
  (SELECT nullif(count(DISTINCT r.cpu), 0) FROM cpu_rows r WHERE r.device_id = c.device_id AND r.boot_id = c.boot_id
     AND r.logcat_token <= c.start_token) AS cpus,
  CASE fgbg_state WHEN 'UNKNOWN' THEN 1 WHEN 'FOREGROUND' THEN 2 ELSE 4 END AS fgbg
  FROM chunks c JOIN fgbg f ON f.device_id = c.device_id AND f.boot_id = c.boot_id AND f.logcat_token = start_token""", _CUT, _MEMBERS)
oracle("no_suspend_chunks", f"""SELECT {_CHUNK} FROM chunks EXCEPT
  SELECT {_CHUNK} FROM members WHERE payload LIKE '%PM: suspend exit%'""", _CUT, _MEMBERS)
oracle("gapless_chunks", f"""SELECT {_CHUNK.replace('device_id, boot_id', 'c.device_id, c.boot_id')} FROM chunks c
  WHERE (SELECT count(*) FROM dense_members m WHERE m.device_id = c.device_id AND m.boot_id = c.boot_id
         AND m.start_token = c.start_token) = end_token - start_token - 1""", _DENSE, _chunks("dense_reports"), _DENSE_MEMBERS)
oracle("chunk_filter", f"SELECT {_CHUNK} FROM chunks WHERE start_level >= 90 AND end_temp > start_temp", _CUT)
oracle("chunk_counts", """SELECT device_id, boot_id, count(*) AS chunks, count(*) FILTER (start_level >= 90) AS kept
  FROM chunks GROUP BY ALL""", _CUT)
oracle("chunk_counts_by_device", """SELECT device_id, count(*) AS chunks, count(*) FILTER (end_temp > start_temp) AS kept
  FROM chunks GROUP BY ALL""", _CUT)
oracle("chunk_meta", """SELECT b.device_id, b.boot_id, count(start_token) AS chunks
  FROM (SELECT DISTINCT device_id, boot_id FROM loglines) b LEFT JOIN chunks USING (device_id, boot_id) GROUP BY ALL""", _CUT)
oracle("read_chunks", f"""SELECT {_CHUNK}, (SELECT count(*) FROM members m WHERE m.device_id = c.device_id
  AND m.boot_id = c.boot_id AND m.start_token = c.start_token) AS lines FROM chunks c""", _CUT, _MEMBERS)

_SEQ = "row_number() OVER (PARTITION BY device_id, boot_id ORDER BY logcat_token) AS seq"
oracle("stitch_sort", f"SELECT {AT}, {_SEQ} FROM loglines")
oracle("write_stitched", f"SELECT {AT}, {_SEQ}, line FROM loglines")
oracle("token_order_violations", f"""SELECT * FROM (SELECT {AT}, lag(logcat_token) OVER (PARTITION BY device_id, boot_id
  ORDER BY logcat_token + 1 - 2 * (logcat_token % 2)) AS previous_token FROM loglines) WHERE logcat_token < previous_token""")
oracle("read_raw_logs", """SELECT file_device, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS characters
  FROM text_lines GROUP BY file_device""")
oracle("read_boot", f"""SELECT {AT}, payload FROM loglines
  WHERE device_id = lpad('5', 40, '0') AND boot_id = '00000000-0000-4000-8000-' || lpad('13', 12, '0')
    AND tag = 'Kernel-Trace' AND (contains(line, 'cpu_frequency') OR contains(line, 'sched_cpu_hotplug'))""")
for _name in ("boot_ids", "stitch_manifest"):
    oracle(_name, "SELECT DISTINCT device_id, boot_id FROM loglines")
oracle("list_devices", "SELECT DISTINCT file_device AS device_id FROM text_lines")
oracle("filter_devices", """SELECT device_id, count(*) AS lines FROM loglines
  WHERE device_id IN (lpad('1', 40, '0'), lpad('3', 40, '0'), lpad('9', 40, '0')) GROUP BY device_id""")
_KNOWN = """
known AS (
  SELECT device_id FROM pvs GROUP BY device_id
  HAVING arg_min(pvs_bin, boot_id || lpad(CAST(logcat_token AS VARCHAR), 20, '0')) > 2),
"""
oracle("read_manifest", """SELECT device_id, CAST(count(DISTINCT boot_id) AS INTEGER) AS boots, 1 AS files, true AS is_valid
  FROM loglines JOIN known USING (device_id) GROUP BY device_id""", _KNOWN)
oracle("device_boots", """SELECT DISTINCT d.file_device AS device_id, b.boot_id FROM text_lines d
  LEFT JOIN (SELECT DISTINCT device_id, boot_id FROM loglines JOIN known USING (device_id)) b ON b.device_id = d.file_device""", _KNOWN)
oracle("skipped_devices", "SELECT file_device AS device_id FROM text_lines EXCEPT SELECT device_id FROM known", _KNOWN)
oracle("device_intersection", "SELECT device_id FROM known", _KNOWN)
oracle("pending_devices", "SELECT file_device AS device_id FROM text_lines EXCEPT SELECT device_id FROM known", _KNOWN)
_FILE = "file_device || '/' || CAST(line_no // 400 AS VARCHAR) || '.out.gz'"
oracle("new_files", f"""SELECT {_FILE} AS file_name FROM text_lines EXCEPT
  SELECT {_FILE} FROM text_lines WHERE line LIKE '%chg=u%'""")
oracle("merged_files", f"""SELECT {_FILE} AS file_name FROM text_lines WHERE line LIKE '%chg=u%' UNION
  SELECT {_FILE} FROM text_lines WHERE line LIKE '%PM: suspend exit%'""")
oracle("merged_bootids", """SELECT device_id, boot_id FROM loglines WHERE line LIKE '%chg=u%' UNION
  SELECT device_id, boot_id FROM loglines WHERE line LIKE '%PVS: 6%'""")
oracle("ingest_stream", f"SELECT {AT}, trace_us, tag FROM loglines")
oracle("daily_counts", """SELECT device_id, epoch_us(date_trunc('day', CAST(stamp AS TIMESTAMP))) AS start_us, count(*) AS lines
  FROM loglines GROUP BY ALL""")

# The same rows by another way.
for _name, _same in {
    "stitch_incremental": "write_stitched",
    "charging_incremental": "charging_state",
    "chunk_devices_cpu": "chunk_cpu_state",
    "chunk_devices_fgbg": "chunk_fgbg_state",
    "chunk_devices_counts": "chunk_meta",
    "freq_totals_file": "freq_time_total",
    "ncpu_lists_file": "ncpu_share_lists",
    "temp_histogram_file": "temp_histogram",
    "pvs_file": "pvs_by_device",
    "closed_daily_counts": "daily_counts",
}.items():
    ORACLES[_name] = ORACLES[_same]
oracle("in_state_suspended", f"SELECT {AT} FROM charging WHERE suspend_state = 'SUSPENDED'", _TRACKED)
oracle("in_state_foreground", f"SELECT {AT} FROM fgbg WHERE fgbg_state = 'FOREGROUND'")
oracle("deviceless_lines", """SELECT device AS device_id, boot_id, logcat_token,
  row_number() OVER (PARTITION BY device, boot_id ORDER BY logcat_token) AS seq
  FROM (SELECT *, CASE WHEN starts_with(line, device_id) THEN device_id ELSE '' END AS device FROM loglines)""")
