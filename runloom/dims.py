"""Fixed dimension tables of the modelled machine (bounded by construction)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tag, kind, unit, label.
TAGS: tuple[tuple[str, str, str, str], ...] = (
    ("stock_flow", "MV", "m3/min", "Thick stock flow"),
    ("filler_flow", "MV", "m3/min", "Filler flow"),
    ("steam_pressure", "MV", "kPa", "Dryer steam pressure"),
    ("machine_speed", "MV", "m/min", "Machine speed"),
    ("retention_aid", "MV", "ppm", "Retention aid dosage"),
    ("jet_wire_ratio", "MV", "-", "Jet/wire ratio"),
    ("basis_weight", "CV", "g/m2", "Basis weight"),
    ("moisture", "CV", "%", "Moisture"),
    ("ash", "CV", "%", "Ash content"),
    ("caliper", "CV", "um", "Caliper"),
    ("headbox_consistency", "DV", "frac", "Headbox consistency"),
    ("broke_ratio", "DV", "frac", "Broke ratio"),
    ("wire_drainage_index", "DV", "-", "Wire drainage index"),
    ("steam_header_kpa", "DV", "kPa", "Steam header pressure"),
    ("white_water_freeness", "DV", "ml CSF", "White water freeness"),
    ("couch_vacuum", "DV", "kPa", "Couch vacuum"),
    ("press_load", "DV", "kN/m", "Press load"),
    ("refiner_sec", "DV", "kWh/t", "Refiner specific energy"),
    ("ambient_humidity", "DV", "%", "Ambient humidity"),
)
MV_TAGS = [t[0] for t in TAGS if t[1] == "MV"]
CV_TAGS = [t[0] for t in TAGS if t[1] == "CV"]
DV_TAGS = [t[0] for t in TAGS if t[1] == "DV"]
ALL_TAGS = [t[0] for t in TAGS]
SETPOINT_TAGS = ["basis_weight_sp", "moisture_sp", "ash_sp"]

# Fixed values: (cause, effect) links the control system already models.
KNOWN_LOOPS: tuple[tuple[str, str], ...] = (
    ("stock_flow", "basis_weight"),
    ("machine_speed", "basis_weight"),
    ("filler_flow", "ash"),
    ("filler_flow", "basis_weight"),
    ("steam_pressure", "moisture"),
    ("machine_speed", "moisture"),
    ("basis_weight", "moisture"),
    ("basis_weight", "caliper"),
    ("steam_header_kpa", "steam_pressure"),
)

# Code, name, basis weight, moisture, ash, speed, nominal ramp.
GRADES: tuple[tuple[str, str, float, float, float, float, float], ...] = (
    ("NP-45", "Newsprint 45", 45.0, 8.5, 8.0, 950.0, 5.0),
    ("SC-56", "Supercalendered 56", 56.0, 6.2, 28.0, 880.0, 6.0),
    ("LWC-52", "Lightweight coated base 52", 52.0, 7.4, 18.0, 900.0, 6.0),
    ("WFU-70", "Woodfree uncoated 70", 70.0, 5.2, 14.0, 720.0, 7.0),
    ("WFU-80", "Woodfree uncoated 80", 80.0, 5.0, 16.0, 680.0, 7.0),
    ("BRD-120", "Folding boxboard 120", 120.0, 6.6, 10.0, 520.0, 8.0),
    ("BRD-150", "Folding boxboard 150", 150.0, 7.0, 12.0, 450.0, 9.0),
)

# Recipe envelope (low, high) shared by all grades.
ENVELOPE: dict[str, tuple[float, float]] = {
    "stock_flow": (5.0, 80.0),
    "filler_flow": (0.0, 1.2),
    "steam_pressure": (120.0, 1100.0),
    "machine_speed": (300.0, 1200.0),
    "retention_aid": (100.0, 600.0),
}

# Permitted actuator rate per minute, in tie-break order.
SLEW_LIMITS: dict[str, float] = {
    "stock_flow": 3.0,
    "filler_flow": 0.10,
    "steam_pressure": 60.0,
    "machine_speed": 45.0,
    "retention_aid": 200.0,
    "jet_wire_ratio": 0.2,
}
PEAK_TO_MEAN_RATE = 1.5

# Healthy level and physical bounds of each disturbance.
DV_NOMINAL: dict[str, float] = {
    "headbox_consistency": 0.009,
    "broke_ratio": 0.14,
    "wire_drainage_index": 1.00,
    "steam_header_kpa": 1150.0,
    "white_water_freeness": 340.0,
    "couch_vacuum": 45.0,
    "press_load": 320.0,
    "refiner_sec": 95.0,
    "ambient_humidity": 52.0,
}
DV_BOUNDS: dict[str, tuple[float, float]] = {
    "headbox_consistency": (0.0055, 0.0125),
    "broke_ratio": (0.0, 0.45),
    "wire_drainage_index": (0.70, 1.10),
    "steam_header_kpa": (700.0, 1250.0),
    "white_water_freeness": (250.0, 430.0),
    "couch_vacuum": (30.0, 60.0),
    "press_load": (260.0, 400.0),
    "refiner_sec": (60.0, 140.0),
    "ambient_humidity": (25.0, 90.0),
}

# Source code and display label of each kind of advice.
SOURCE_LABELS: dict[str, str] = {
    "RECIPE_LIMIT": "Recipe / grade limit",
    "HISTORICAL_DATA": "Historical transition data",
    "PHYSICS_MODEL": "First-principles twin",
    "CORRELATION_DISCOVERY": "Discovered correlation",
    "OPERATOR_PRECEDENT": "Operator precedent",
    "RISK_MODEL": "Risk model inference",
}
DECISIONS = ("accepted", "rejected", "ignored")


def tags_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TAGS), "tag string, kind string, unit string, label string")


def with_limits(grades: DataFrame) -> DataFrame:
    """Add the shared recipe envelope (``<tag>_limits``) and actuator rates
    (``max_<tag>_rate``) where a grade table does not bring its own."""
    limits = [
        F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")).alias(f"{tag}_limits")
        for tag, (lo, hi) in ENVELOPE.items()
        if f"{tag}_limits" not in grades.columns
    ]
    rates = [
        F.lit(rate).alias(f"max_{tag}_rate")
        for tag, rate in SLEW_LIMITS.items()
        if f"max_{tag}_rate" not in grades.columns
    ]
    return grades.select("*", *limits, *rates)


def grades_table(spark: SparkSession) -> DataFrame:
    """One row per grade with its targets, envelope and rate limits."""
    base = spark.createDataFrame(
        list(GRADES),
        "code string, name string, basis_weight double, moisture double, ash double, "
        "machine_speed double, nominal_ramp_min double",
    )
    return with_limits(base)


def known_loops_table(spark: SparkSession) -> DataFrame:
    """Known links in both directions."""
    links = spark.createDataFrame(list(KNOWN_LOOPS), "cause string, effect string")
    return links.union(links.select("effect", "cause")).distinct()
