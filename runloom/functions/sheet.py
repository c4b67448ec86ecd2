"""Static mass and energy balance of the sheet, and its inverse.

Both are plain column arithmetic, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runloom.dims import DV_NOMINAL, ENVELOPE
from runloom.functions.numeric import clip

# Furnish, geometry and sheet calibration.
WIRE_WIDTH_M = 6.0
FIBER_RETENTION = 0.95
FILLER_CONSISTENCY = 0.30
FILLER_RETENTION = 0.60
MOISTURE_K = 0.02512
MOISTURE_FLOOR = 1.5
STEAM_EXPONENT = 0.85
SHEET_DENSITY = 700.0
DENSITY_PER_ASH = 0.004
DENSITY_PER_MOISTURE = 0.010
DENSITY_PER_LOAD = 0.00035
RECIPE_AID_PPM = 250.0
RECIPE_JET_WIRE = 0.995

SENSOR_INPUTS = (
    "stock_flow",
    "filler_flow",
    "steam_pressure",
    "machine_speed",
    "retention_aid",
    "headbox_consistency",
    "broke_ratio",
    "wire_drainage_index",
    "white_water_freeness",
    "press_load",
    "ambient_humidity",
)


def _retentions(aid: Column, drainage: Column, freeness: Column, broke: Column) -> tuple[Column, Column]:
    aid_gain = 1.0 + 0.045 * F.log1p(F.greatest(aid, F.lit(1e-9)) / 250.0)
    fiber = FIBER_RETENTION * aid_gain * (0.94 + 0.06 * drainage) * (1.0 + 0.00018 * (freeness - 340.0))
    filler = FILLER_RETENTION * aid_gain * (1.0 + 0.35 * broke)
    return clip(fiber, 0.70, 0.995), clip(filler, 0.20, 0.92)


def _humidity_factor(humidity: Column) -> Column:
    return 1.0 + 0.0035 * (humidity - 52.0)


def soft_sensor(inputs: dict[str, Column] | None = None) -> dict[str, Column]:
    """Quality variables from the eleven inputs (columns of the same name
    unless other columns are given)."""
    x = {name: (inputs or {}).get(name, F.col(name)) for name in SENSOR_INPUTS}
    fiber_ret, filler_ret = _retentions(
        x["retention_aid"], x["wire_drainage_index"], x["white_water_freeness"], x["broke_ratio"]
    )
    fiber = x["stock_flow"] * 1000.0 * x["headbox_consistency"] * fiber_ret
    filler = x["filler_flow"] * 1000.0 * FILLER_CONSISTENCY * filler_ret
    solids = fiber + filler
    weight = solids / F.greatest(x["machine_speed"] * WIRE_WIDTH_M, F.lit(1e-9)) * 1000.0
    ash = filler / F.greatest(solids, F.lit(1e-9)) * 100.0
    capacity = F.pow(F.greatest(x["steam_pressure"], F.lit(1.0)), F.lit(STEAM_EXPONENT))
    moisture = clip(
        MOISTURE_FLOOR
        + MOISTURE_K * weight * x["machine_speed"] / capacity * _humidity_factor(x["ambient_humidity"]),
        1.5,
        25.0,
    )
    density = clip(
        SHEET_DENSITY
        * (1.0 + DENSITY_PER_ASH * (ash - 10.0))
        * (1.0 + DENSITY_PER_MOISTURE * (moisture - 6.0))
        * (1.0 + DENSITY_PER_LOAD * (x["press_load"] - 320.0)),
        450.0,
        1100.0,
    )
    return {
        "basis_weight": weight,
        "ash": ash,
        "moisture": moisture,
        "caliper": weight / density * 1000.0,
    }


def grade_setpoints(prefix: str = "") -> dict[str, Column]:
    """Setpoints of a grade row whose columns carry ``prefix`` and its limits."""
    limits = {tag: (F.col(f"{prefix}{tag}_limits.lo"), F.col(f"{prefix}{tag}_limits.hi")) for tag in ENVELOPE}
    targets = [F.col(f"{prefix}{c}") for c in ("basis_weight", "moisture", "ash", "machine_speed")]
    return recipe_setpoints(*targets, limits=limits)


def recipe_setpoints(
    weight: Column, moisture: Column, ash: Column, speed: Column, state: dict[str, Column] | None = None,
    limits: dict[str, tuple] | None = None,
) -> dict[str, Column]:
    """Actuator setpoints that hit a grade's targets at the given disturbance
    state (the healthy one by default), held inside the recipe envelope or the
    given (low, high) ``limits``."""
    limits = ENVELOPE | (limits or {})
    d = {k: (state or {}).get(k, F.lit(v)) for k, v in DV_NOMINAL.items()}
    fiber_ret, filler_ret = _retentions(
        F.lit(RECIPE_AID_PPM), d["wire_drainage_index"], d["white_water_freeness"], d["broke_ratio"]
    )
    solids = weight * (speed * WIRE_WIDTH_M) / 1000.0
    filler = ash / 100.0 * solids
    fiber = solids - filler
    margin = F.greatest(moisture - MOISTURE_FLOOR, F.lit(0.2))
    capacity = MOISTURE_K * weight * speed * _humidity_factor(d["ambient_humidity"])
    raw = {
        "stock_flow": fiber / (1000.0 * d["headbox_consistency"] * fiber_ret),
        "filler_flow": filler / (1000.0 * FILLER_CONSISTENCY * filler_ret),
        "steam_pressure": F.pow(capacity / margin, F.lit(1.0 / STEAM_EXPONENT)),
    }
    out = {tag: clip(raw[tag], *limits[tag]) for tag in raw}
    out["machine_speed"] = speed
    out["retention_aid"] = F.lit(RECIPE_AID_PPM)
    out["jet_wire_ratio"] = F.lit(RECIPE_JET_WIRE)
    return out
