"""Screening a site against buffer rules with an explicit uncertainty: a cascade in which the first match decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwright.functions.classes import UNCERTAINTY_M, displaced_error, displaced_m3, flow_class, hand_class, retreat, tankers, two_figures

#: Metres of the lake and drain buffers of each regime.
RULESETS = {"state": (30, 25), "ngt": (75, 50)}
#: Share of time under water from which a bed is a lake, retreat that puts shorelines in doubt, share of a plot built.
LAKE_OCCURRENCE, DOUBTFUL_RETREAT_M, BUILT_SHARE = 50, 30, 0.1


def rulesets(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in RULESETS.items()], "ruleId string, lakeM int, drainM int")


def with_classes(sites: DataFrame) -> DataFrame:
    """sites with retreatM, handClass and flowClass."""
    return sites.withColumns(
        {"retreatM": retreat(F.col("distPresent"), F.col("distHistoric")), "handClass": hand_class(F.col("handM")), "flowClass": flow_class(F.col("distDrain"))}
    )


def branches() -> list[tuple[str, Column, str]]:
    """(code, condition, verdict), in order. Columns: the site's and lakeM, drainM."""
    c = F.col
    return [
        ("refer.outside-study-area", ~c("inAoi"), "REFER"),
        ("reject.on-present-water", c("distPresent") == 0, "REJECT"),
        ("reject.on-lasting-bed", (c("distHistoric") == 0) & (c("occurrence") >= LAKE_OCCURRENCE), "REJECT"),
        ("reject.built-on-bed", (c("distHistoric") == 0) & (c("encroached") > BUILT_SHARE), "REJECT"),
        ("reject.inside-buffer", c("distPresent") + UNCERTAINTY_M <= c("lakeM"), "REJECT"),
        ("refer.low-bed", (c("distHistoric") == 0) & (c("handM") == 0), "REFER"),
        ("refer.former-bed", c("distHistoric") == 0, "REFER"),
        ("refer.shoreline-disagreement", (c("distPresent") > c("lakeM")) & (c("distHistoric") <= c("lakeM")) & (c("retreatM") > DOUBTFUL_RETREAT_M), "REFER"),
        ("refer.within-uncertainty", F.abs(c("distPresent") - c("lakeM")) <= UNCERTAINTY_M, "REFER"),
        ("refer.drain-buffer", c("distDrain") <= c("drainM"), "REFER"),
        ("conditions.low-ground", c("handM") <= 1, "CONDITIONS"),
    ]


def screen(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """sites (with classes) with code, verdict and measured; outside the study area no measurement is reported."""
    ruled = sites.join(rules, "ruleId")  # whoever gives the rules says how many; the engine sends them where they are small
    code, verdict = F.lit("none"), F.lit("NO_OBJECTION")
    for name, when, outcome in reversed(branches()):
        code, verdict = F.when(when, name).otherwise(code), F.when(when, outcome).otherwise(verdict)
    return ruled.withColumns({"code": code, "verdict": verdict, "measured": F.col("inAoi")})


def runoff(sites: DataFrame, plot: str = "plotM") -> DataFrame:
    """Displaced volume in m3, its error, both to two figures, and tankers."""
    volume = displaced_m3(F.col(plot))
    return sites.withColumns(
        {"displaced_m3": volume, "error_m3": displaced_error(volume), "shown_m3": two_figures(volume), "shown_error_m3": two_figures(displaced_error(volume)), "tankers": tankers(volume)}
    )


#: Ids and triggers of the options. Declared ranks, and whether an option says anything of the site, are ours.
OPTIONS = (
    ("option.wetland-restoration-tdr", 1, True, [[("distHistoric", "eq", 0), ("occurrence", "gte", 50)], [("distHistoric", "eq", 0)]]),
    ("option.sponge-park-retention", 2, True, [[("handClass", "in", ["AT_DRAINAGE_LEVEL", "DEEP_IN_A_WATER_PATH"]), ("retentionRequiredM3", "notnull", None)], [("handClass", "in", ["AT_DRAINAGE_LEVEL", "DEEP_IN_A_WATER_PATH", "LOW_GROUND"])]]),
    ("option.build-around-channel", 3, True, [[("flowClass", "eq", "ON_FLOW_PATH"), ("retentionRequiredM3", "notnull", None)], [("flowClass", "in", ["ON_FLOW_PATH", "ADJACENT"])]]),
    ("option.recharge-structure", 4, False, [[("retentionRequiredM3", "notnull", None)]]),
)


def options(sites: DataFrame, key: str = "site_id") -> DataFrame:
    """The options of each site, most specific trigger first, then by declared rank; none unless a site-specific one fired."""
    from tarnwright.operators.triggers import specificity

    each = [
        F.struct((-specificity(when, sites.schema)).alias("size"), F.lit(rank).alias("declared"), F.lit(name).alias("option"), F.lit(own).alias("own")) for name, rank, own, when in OPTIONS
    ]
    fired = F.filter(F.array(*each), lambda o: o["size"].isNotNull())
    rows = sites.select(key, F.array_sort(fired).alias("fired")).where(F.exists("fired", lambda o: o["own"]))
    return rows.select(key, F.posexplode("fired").alias("place", "o")).select(key, (F.col("place") + 1).alias("place"), "o.option", (-F.col("o.size")).alias("conditions"))


def certificate(screened: DataFrame, key: str = "site_id") -> DataFrame:
    """One JSON document a site: measurements, frontage, regime and outcome; saturated distances are flagged, not printed."""
    shown = lambda c: F.when(F.col(c) < 255, F.col(c)).alias(c)
    fields = F.struct(
        F.col(key), "ruleId", "lakeM", "drainM", "plotM", "verdict", "code",
        F.when(F.col("inAoi"), F.struct(shown("distPresent"), shown("distHistoric"), shown("distDrain"), "handM", "occurrence")).alias("measured"),
        F.lit(UNCERTAINTY_M).alias("uncertaintyM"),
    )
    return screened.select(key, F.to_json(fields).alias("certificate"))
