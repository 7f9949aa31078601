"""SQL text for the independent DuckDB oracle.

The oracle re-states each rule as plain SQL over the same test tables; the
helpers here only spell lookups and bins as ``CASE`` text from the same
fixed values, so both engines read one source of constants.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from ..functions import dims
from .fixtures import scores_sql, subscribers_sql


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        if math.isinf(v):
            return "'inf'::DOUBLE" if v > 0 else "'-inf'::DOUBLE"
        return f"{v!r}::DOUBLE"
    return str(v)


def case_map(expr: str, mapping: Mapping, default=None) -> str:
    whens = " ".join(f"WHEN {expr} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {whens} ELSE {lit(default)} END)"


def case_cut(expr: str, edges: Sequence[float], labels: Sequence[str], right: bool = True,
             include_lowest: bool = True) -> str:
    parts = []
    for i, (lo, hi, lab) in enumerate(zip(edges[:-1], edges[1:], labels)):
        lo_s, hi_s = lit(float(lo)), lit(float(hi))
        if right:
            lower = f"{expr} >= {lo_s}" if (i == 0 and include_lowest) else f"{expr} > {lo_s}"
            parts.append(f"WHEN {lower} AND {expr} <= {hi_s} THEN {lit(lab)}")
        else:
            parts.append(f"WHEN {expr} >= {lo_s} AND {expr} < {hi_s} THEN {lit(lab)}")
    return f"(CASE {' '.join(parts)} ELSE NULL END)"


def flag(cond: str) -> str:
    return f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS BIGINT)"


def risk(expr: str) -> str:
    return (f"(CASE WHEN {expr} < {dims.RISK_LOW_BELOW}::DOUBLE THEN '{dims.RISK_LOW}' "
            f"WHEN {expr} < {dims.RISK_MEDIUM_BELOW}::DOUBLE THEN '{dims.RISK_MEDIUM}' "
            f"ELSE '{dims.RISK_HIGH}' END)")


def model_ready_sql() -> str:
    """Canonical model-ready table over ``subscribers``."""
    loc_fixed = case_map("location", dims.LOCATION_CORRECTIONS, default=None)
    loc_fixed = f"coalesce({loc_fixed}, location)"
    state = case_map("trim(location_c)", dims.STATE_NAME_TO_CODE_19)
    return f"""
mr0 AS (
  SELECT * REPLACE ({loc_fixed} AS location), {loc_fixed} AS location_c FROM subscribers),
model_ready AS (
  SELECT * EXCLUDE (location_c),
    -signup_date AS tenure_days,
    CAST(-signup_date AS DOUBLE) / 30.0::DOUBLE AS tenure_months,
    CASE WHEN weekly_hours = 0 THEN NULL ELSE CAST(weekly_songs_played AS DOUBLE) / weekly_hours END
      AS songs_per_hour,
    {flag(f"song_skip_rate >= {dims.HIGH_SKIP_THRESHOLD}::DOUBLE")} AS high_skip_user,
    {case_cut("age", dims.AGE_EDGES, dims.AGE_LABELS, True, True)} AS age_group,
    {case_cut("weekly_hours", dims.HOURS_EDGES, dims.HOURS_LABELS, False)} AS weekly_hours_bin,
    {case_cut("song_skip_rate", dims.SKIP_EDGES_LEFT, dims.SKIP_LABELS, False)} AS skip_rate_bin,
    {state} AS state_code,
    {case_map(state, dims.STATE_CODE_TO_REGION_19)} AS region
  FROM mr0)"""


def with_ctes(body: str, *ctes: str) -> str:
    """``WITH subscribers AS (...), <ctes> <body>``; subscribers always first."""
    all_ctes = [subscribers_sql()]
    for c in ctes:
        if c == "model_ready":
            all_ctes.append(model_ready_sql())
        elif c == "scores":
            all_ctes.append(scores_sql(False))
        elif c == "signal_scores":
            all_ctes.append(scores_sql(True))
        else:
            all_ctes.append(c)
    return "WITH " + ",\n".join(x.strip() for x in all_ctes) + "\n" + body
