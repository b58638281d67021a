"""Tables whose columns have the names that operators give to columns of their own: rows and columns are as without them."""

from pyspark.sql import functions as F

from tarnwright.llm import mixing, near_dedup, pii, substring_dedup
from tarnwright.llm.common import spare

OWN = ("_cut_id", "_cut_key", "_cuts", "_gone_id", "_twice_id", "_mix_id", "_mix_rate", "_mix_times", "_MIX_copy", "count", "kept", "rate", "row")


def test_spare_names(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "_a int, _A_ int, b int")
    assert spare(frame, "_a", "c") == ["_a__", "c"]


def test_stages_keep_columns_of_any_name(spark, documents):
    plain = documents.limit(60).cache()
    long = " ".join(f"word{i}" for i in range(90))
    more = spark.createDataFrame([(9001, long), (9002, "before it " + long), (9003, "a text of its own"), (9003, "a text of its own")], "doc_id long, text string")
    plain = plain.select("doc_id", "text").unionByName(more).cache()
    clash = plain.select("*", *(F.lit(f"{i}").alias(c) for i, c in enumerate(OWN)))
    labels = spark.createDataFrame([(9001, "good"), (9003, "poor")], "doc_id long, domain string")
    stages = {
        "repeats": substring_dedup.without_repeats,
        "near": near_dedup.deduplicated,
        "mixing": lambda t: mixing.drawn(t, labels),
        "pii": pii.redacted,
    }
    for name, stage in stages.items():
        got, want = stage(clash), stage(plain)
        assert got.columns == clash.columns, name
        assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, want.collect())), name
        assert got.where(" or ".join(f"`{c}` <> '{i}'" for i, c in enumerate(OWN))).count() == 0, name
