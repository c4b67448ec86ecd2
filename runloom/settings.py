"""Tunable parameters, grouped so that every operator takes one small object."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RunSpec:
    """Sampling grid, bands and look-ahead of a run.  All windows are given in
    minutes and turned into sample counts on the ``dt_s`` grid."""

    # Defaults of the modelled machine.
    dt_s: float = 5.0
    band_pct: float = 2.5
    moisture_band: float = 0.40
    ash_band: float = 1.50
    horizon_min: float = 10.0
    settle_tol_pct: float = 1.0
    settle_dwell_min: float = 2.0
    warmup_min: float = 2.0
    window_min: float = 30.0

    def steps(self, minutes: float, at_least: int = 1) -> int:
        return max(int(round(minutes * 60.0 / self.dt_s)), at_least)

    @property
    def horizon(self) -> int:
        return self.steps(self.horizon_min)

    @property
    def dwell(self) -> int:
        return self.steps(self.settle_dwell_min)

    @property
    def warmup(self) -> int:
        return self.steps(self.warmup_min, at_least=0)

    @property
    def step_min(self) -> float:
        return self.dt_s / 60.0


@dataclass(frozen=True)
class Economics:
    # Default mill economics in USD, tonnes, GJ.
    net_margin_per_tonne: float = 95.0
    rework_cost_per_tonne: float = 42.0
    steam_cost_per_gj: float = 9.0
    steam_gj_per_tonne: float = 2.4
    grade_changes_per_day: float = 3.2
    operating_days_per_year: float = 340.0
    low_multiplier: float = 0.70
    high_multiplier: float = 1.35

    @property
    def per_tonne(self) -> float:
        return self.net_margin_per_tonne + self.rework_cost_per_tonne

    @property
    def annual_changes(self) -> float:
        return self.grade_changes_per_day * self.operating_days_per_year


# Accepted range of each economics field, (low, low allowed, high).
ECONOMICS_BOUNDS: dict[str, tuple[float, bool, float | None]] = {
    "net_margin_per_tonne": (0.0, True, None),
    "rework_cost_per_tonne": (0.0, True, None),
    "steam_cost_per_gj": (0.0, True, None),
    "steam_gj_per_tonne": (0.0, True, None),
    "grade_changes_per_day": (0.0, False, 100.0),
    "operating_days_per_year": (0.0, False, 366.0),
    "low_multiplier": (0.0, False, None),
    "high_multiplier": (0.0, False, None),
}


@dataclass(frozen=True)
class SurfacePolicy:
    # Advice below these floors is not shown.
    min_value_usd: float = 150.0
    min_confidence: float = 0.35
    max_shown: int = 4


@dataclass(frozen=True)
class ForecastSpec:
    horizons_min: tuple[float, ...] = (2.0, 5.0, 10.0)
    quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)


@dataclass(frozen=True)
class PlanBounds:
    # Recipe bounds of the three plan knobs, then the narrower
    # bounds a plan search stays inside.
    recipe: dict[str, tuple[float, float]] = field(
        default_factory=lambda: {
            "ramp_min": (2.0, 25.0),
            "lead_scale": (0.0, 2.5),
            "tau_c_scale": (0.3, 4.0),
        }
    )
    search: dict[str, tuple[float, float]] = field(
        default_factory=lambda: {
            "ramp_min": (2.0, 25.0),
            "lead_scale": (0.5, 1.6),
            "tau_c_scale": (0.5, 2.2),
        }
    )
    shrink: float = 0.45
