"""Shared parts of the DuckDB twins of the registered queries."""

from __future__ import annotations

from runloom.dims import ALL_TAGS
from runloom.sources.driver_tables import NOMINAL, PULL, SPEC, TYPES


def d(x: float) -> str:
    """A DOUBLE literal (plain decimals would be DECIMAL)."""
    text = repr(float(x))
    if text.startswith("-"):
        return f"(-{d(-x)})"
    return text if "e" in text else f"{text}e0"


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


EV = """ev AS (
  SELECT user_id AS run_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS sample_idx,
         ts, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""
SPS = "sps AS (SELECT event_type, round(avg(value), 2) AS sp FROM events GROUP BY event_type)"
S = f"""s AS (
  SELECT ev.*, sample_idx * {d(SPEC.dt_s)} / 60e0 AS t_min, sp,
         (value - sp) / greatest(abs(sp), 1e-9) * 100e0 AS dev
  FROM ev JOIN sps USING (event_type))"""
BASE = f"{EV},\n{SPS},\n{S}"
W = "PARTITION BY run_id ORDER BY sample_idx"
BAND = d(SPEC.band_pct)
GRADES = """grades AS (
  SELECT event_type AS code, round(avg(value), 2) AS basis_weight,
         5e0 + (count(*) % 7) / 2e0 AS moisture, 8e0 + (count(*) % 20) AS ash,
         400e0 + (count(*) % 500) AS machine_speed, 5e0 + (count(*) % 5) AS nominal_ramp_min
  FROM events GROUP BY event_type)"""
PLANS = """plans AS (
  SELECT run_id, count(*) AS n_samples, arg_min(event_type, sample_idx) AS from_grade,
         arg_max(event_type, sample_idx) AS to_grade,
         2e0 + run_id % 9 AS plan_ramp_min, 5e-1 + (count(*) % 10) / 10e0 AS plan_lead_scale,
         4e-1 + (count(*) % 20) / 10e0 AS plan_tau_c_scale, count(*) % 2 = 0 AS plan_trim_enabled,
         1e0 AS plan_start_min,
         coalesce(string_agg(DISTINCT CASE WHEN value > 200 THEN event_type END, '|'
                  ORDER BY CASE WHEN value > 200 THEN event_type END), '') AS fault_text
  FROM ev GROUP BY run_id)"""


def tag_sql(tag: str) -> str:
    if tag == "basis_weight":
        return "value"
    a, b = PULL[tag]
    return f"{d(NOMINAL[tag])} * (1e0 + {d(a)} * (value - 50e0) + {d(b)} * (k - 50))"


WIDE = (
    "wide AS (SELECT run_id, sample_idx, t_min, dev, "
    + ", ".join(f"{tag_sql(t)} AS {t}" for t in ALL_TAGS)
    + ", sp AS basis_weight_sp, 6e0 AS moisture_sp, 12e0 AS ash_sp FROM s)"
)
DAY_TAGS = f"""day_tags AS (
  SELECT g.run_id, g.sample_idx, {", ".join(f"coalesce(p.{t}, 0e0) AS {t}" for t in TYPES)}
  FROM (SELECT DISTINCT user_id AS run_id, CAST(x AS INTEGER) AS sample_idx
        FROM events, (SELECT unnest(range(0, date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1)) AS x FROM events) r) g
  LEFT JOIN (SELECT user_id AS run_id, CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS INTEGER) AS sample_idx,
               {", ".join(f"round(sum(CASE WHEN event_type = '{t}' THEN value ELSE 0e0 END), 2) AS {t}" for t in TYPES)}
             FROM events GROUP BY 1, 2) p USING (run_id, sample_idx))"""
SCORED = f"""scored AS (
  SELECT *, round(1e0 / (1e0 + exp(-(abs(dev) / 60e0 + max2 / 150e0 - 2e0))), 4) AS proba,
         CAST(abs(dev) > {BAND} AS INTEGER) AS off,
         CAST(coalesce(fut, 0) AS INTEGER) AS y
  FROM (SELECT run_id, sample_idx, t_min, dev,
               max(abs(dev)) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS max2,
               max(CAST(abs(dev) > {BAND} AS INTEGER)) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {SPEC.horizon} FOLLOWING) AS fut
        FROM s) q
  WHERE sample_idx >= {SPEC.warmup})"""
LEDGER = """ledger AS (
  SELECT CAST(event_id AS VARCHAR) AS entry_id,
         CASE WHEN event_type = 'view' THEN 'surfaced' ELSE 'response' END AS kind,
         CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS advisory_id,
         epoch_us(ts) / 1000000e0 AS "timestamp",
         CASE WHEN event_type = 'view' THEN list_extract(['RISK_MODEL', 'PHYSICS_MODEL', 'CORRELATION_DISCOVERY', 'RECIPE_LIMIT'], k % 4 + 1) END AS source,
         CASE WHEN event_type = 'view' THEN k / 100e0 END AS confidence,
         CASE WHEN event_type = 'view' AND k % 5 <> 0 THEN value * 10e0 END AS value_usd,
         CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'signup' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'ignored' END AS decision,
         CASE WHEN event_type <> 'view' THEN 'answer' || chr(9) || ' of  ' || event_type || ' ' || props END AS note,
         user_id AS run_id, event_id AS seq
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
LATEST = """latest AS (
  SELECT s.advisory_id, s.source, s.confidence, s.value_usd, r.decision
  FROM (SELECT * FROM ledger WHERE kind = 'surfaced'
        QUALIFY row_number() OVER (PARTITION BY advisory_id ORDER BY seq DESC) = 1) s
  JOIN (SELECT * FROM ledger WHERE kind = 'response'
        QUALIFY row_number() OVER (PARTITION BY advisory_id ORDER BY seq DESC) = 1) r USING (advisory_id))"""
