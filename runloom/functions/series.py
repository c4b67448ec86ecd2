"""Per-sample expressions of a run: deviation, ramp phase, setpoint curve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runloom.functions.numeric import clip, flag

TINY = 1e-9


def deviation_pct(value: Column, setpoint: Column) -> Column:
    """Signed deviation from the setpoint, in percent of it."""
    return (value - setpoint) / F.greatest(F.abs(setpoint), F.lit(TINY)) * 100.0


def out_of_band(deviation: Column, band_pct: float) -> Column:
    return F.abs(deviation) > F.lit(float(band_pct))


def headroom(deviation: Column, band_pct: float) -> Column:
    return F.lit(float(band_pct)) - F.abs(deviation)


def ramp_phase(t_min: Column, start_min: Column, ramp_min: Column) -> dict[str, Column]:
    since = t_min - start_min
    end = start_min + ramp_min
    return {
        "t_since_ramp_min": since,
        "ramp_progress": clip(since / F.greatest(ramp_min, F.lit(1e-6)), 0.0, 1.0),
        "in_ramp": flag((t_min >= start_min) & (t_min <= end)),
        "post_ramp": flag(t_min > end),
    }


def s_curve(u: Column) -> Column:
    """Smooth step: 0 below 0, 1 above 1, flat at both ends."""
    x = clip(u, 0.0, 1.0)
    return x * x * (3.0 - 2.0 * x)


def ramp_fraction(t_min: Column, start_min: Column, ramp_min: Column) -> Column:
    """Share of the transition done at ``t_min``; no ramp means a step."""
    step = flag(t_min >= start_min)
    u = F.try_divide(t_min - start_min, ramp_min)
    return F.when(ramp_min <= 0, step).otherwise(s_curve(u))


def blend(start: Column, target: Column, fraction: Column) -> Column:
    return start + (target - start) * fraction


def transition_context(a: str, b: str) -> dict[str, Column]:
    """Size of a change between two grade rows with column prefixes a and b."""

    def g(prefix: str, name: str) -> Column:
        return F.col(f"{prefix}{name}")

    bw_a, bw_b = g(a, "basis_weight"), g(b, "basis_weight")
    sp_a, sp_b = g(a, "machine_speed"), g(b, "machine_speed")
    ash = g(b, "ash") - g(a, "ash")
    magnitude = (
        F.abs(bw_b - bw_a) / F.greatest(bw_a, F.lit(1e-6))
        + F.abs(ash) / 30.0 * 0.5
        + F.abs(sp_b - sp_a) / F.greatest(sp_a, F.lit(1e-6)) * 0.5
    )
    return {
        "bw_from": bw_a,
        "bw_to": bw_b,
        "bw_change_pct": (bw_b - bw_a) / bw_a * 100.0,
        "ash_change": ash,
        "moisture_change": g(b, "moisture") - g(a, "moisture"),
        "speed_change_pct": (sp_b - sp_a) / sp_a * 100.0,
        "transition_magnitude": magnitude,
    }


def spec_band(target: Column, band_pct: float) -> dict[str, Column]:
    tolerance = target * band_pct / 100.0
    return {
        "tolerance": tolerance,
        "band_lo": target - tolerance,
        "band_hi": target + tolerance,
    }
