"""Sentences and table text built from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(p: Column) -> Column:
    """0.256 -> 26%, halves to even."""
    return F.concat(F.bround(p * 100.0).cast("long").cast("string"), F.lit("%"))


def signed(x: Column, digits: int) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), F.format_string(f"%.{digits}f", x))


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def explain_risk(probability: Column, drivers: Column, top: int = 3) -> Column:
    """``drivers``: array of (feature, phi) structs, strongest first."""
    named = F.transform(F.slice(drivers, 1, top), lambda s: F.concat(s["feature"], F.lit(" "), signed(s["phi"], 3)))
    some = F.coalesce(F.size(drivers), F.lit(0)) > 0
    return F.concat(
        F.lit("Breach risk "), percent(probability), F.when(some, F.concat(F.lit("; drivers: "), F.array_join(named, ", "))).otherwise(""),
    )


def explain_link(cause: Column, effect: Column, lag_min: Column, r: Column, mi: Column, known: Column) -> Column:
    return F.concat(
        F.when(known, "Known link: ").otherwise("New link: "), effect, F.lit(" follows "), cause, F.lit(" after "), fixed(lag_min, 2),
        F.lit(" min; correlation "), signed(r, 2), F.lit(", mutual information "), fixed(mi, 2),
    )


def explain_plan(
    old_ramp: Column, new_ramp: Column, lead: Column, tau: Column, saved_min: Column, source: Column,
    floor_min: Column, actuator: Column,
) -> Column:
    limit = F.concat(F.lit("; "), actuator, F.lit(" needs "), fixed(floor_min, 1), F.lit(" min"))
    return F.concat(
        F.lit("Ramp "), fixed(old_ramp, 1), F.lit(" -> "), fixed(new_ramp, 1), F.lit(" min, lead x "), fixed(lead, 2), F.lit(", trim x "),
        fixed(tau, 2), F.when(source == "RECIPE_LIMIT", limit).otherwise(""), F.lit("; off-spec time saved: "), fixed(saved_min, 2), F.lit(" min"),
    )


def explain_knob(knob: Column, direction: Column, delta: Column, saved_min: Column) -> Column:
    tried = F.concat(F.lit(": "), direction, F.lit(" by "), fixed(F.abs(delta), 2), F.lit(", settling gains "), fixed(saved_min, 2), F.lit(" min"))
    return F.concat(knob, F.when(direction == "none", ": leave as it is, no probe settles sooner").otherwise(tried))


def utc_text(epoch_s: Column) -> Column:
    """Epoch seconds as UTC text, whatever the session zone."""
    day = F.date_from_unix_date(F.floor(epoch_s / 86400.0).cast("int"))
    s = F.pmod(F.floor(epoch_s).cast("long"), F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))
    return F.concat_ws(" ", day.cast("string"), clock)


def one_line(text: Column, width: int) -> Column:
    """Control characters and runs of blanks become one space; text longer than
    ``width`` ends in an ellipsis."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{Cntrl}]", " "), r"\s+", " "))
    return F.when(F.length(clean) <= width, clean).otherwise(F.concat(F.substring(clean, 1, width - 1), F.lit("…")))
