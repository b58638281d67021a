"""Classes and derived figures of a site, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Storm depth (mm) and its error, change of the runoff coefficient and its error, litres of a tanker.
STORM_MM, STORM_ERROR, RUNOFF_CHANGE, RUNOFF_ERROR, TANKER_L = 60, 24, 0.55, 0.15, 6000
#: Terms of the error budget in metres, and the figure that is quoted.
ERROR_TERMS, UNCERTAINTY_M = (15, 7, 6), 20


def hand_class(metres: Column) -> Column:
    """Exposure by height above the nearest drainage."""
    return (
        F.when(metres == 0, "AT_DRAINAGE_LEVEL").when(metres <= 1, "DEEP_IN_A_WATER_PATH").when(metres <= 2, "LOW_GROUND").when(metres <= 5, "MARGINAL").otherwise("ELEVATED")
    )


def flow_class(metres: Column) -> Column:
    """Nearness to a flow path."""
    return F.when(metres == 0, "ON_FLOW_PATH").when(metres <= 10, "ADJACENT").when(metres <= 70, "NEAR").when(metres >= 255, "UNRESOLVED").otherwise("OFF")


def retreat(present: Column, historic: Column) -> Column:
    return F.greatest(F.lit(0), present - historic)


def risk_score(lost: Column, flow: Column, upstream: Column, hand: Column, zero_as_missing: bool = False) -> Column:
    """Missing fractions and areas count as 0, a missing height as 50; zero_as_missing treats height 0 as missing too."""
    height = F.when(hand == 0, None).otherwise(hand) if zero_as_missing else hand
    worst = F.greatest(F.coalesce(lost, F.lit(0.0)), F.coalesce(flow, F.lit(0.0)))
    return worst * F.log10(F.coalesce(upstream, F.lit(0.0)) + 1) / (F.greatest(F.coalesce(height, F.lit(50.0)), F.lit(0.0)) + 1) * 100


def risk_verdict(lost: Column, flow: Column) -> Column:
    lost, flow = F.coalesce(lost, F.lit(0.0)), F.coalesce(flow, F.lit(0.0))
    return F.when(lost > 0.5, "RED_FORMER_WATER_BODY").when(flow > 0.5, "RED_BLOCKS_DRAINAGE").when(F.greatest(lost, flow) > 0.15, "AMBER_PARTIAL").otherwise("GREEN_CLEAR")


def displaced_m3(plot_m: Column) -> Column:
    """Storm runoff that a sealed square plot no longer takes up."""
    return plot_m * plot_m * (STORM_MM / 1000) * RUNOFF_CHANGE


def two_figures(value: Column) -> Column:
    """Rounded to two significant figures."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(value)) - 1)
    return F.when(value > 0, F.floor(value / unit + 0.5) * unit).otherwise(F.lit(0.0))


def displaced_error(volume: Column) -> Column:
    """Errors of storm and coefficient in quadrature."""
    return volume * ((STORM_ERROR / STORM_MM) ** 2 + (RUNOFF_ERROR / RUNOFF_CHANGE) ** 2) ** 0.5


def tankers(volume: Column) -> Column:
    return volume * 1000 / TANKER_L


def shortfall(required: Column, stored: Column) -> Column:
    """What is still to be stored; null where nothing was stated."""
    return F.when(stored.isNotNull(), F.greatest(required - stored, F.lit(0.0)))


def error_of(*terms: Column) -> Column:
    """What independent errors come to; null if one of them is not known."""
    total = F.lit(0.0)
    for t in terms:
        total = total + t * t
    return F.sqrt(total)


def error_budget(terms: tuple[float, ...] = ERROR_TERMS) -> float:
    return sum(t * t for t in terms) ** 0.5
