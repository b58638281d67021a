"""Plot checks as a stream: requests meet the rules, a static table; no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tarnwright.operators.screening import screen, with_classes


def screened_stream(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """A stream of site records, screened as a batch of them would be."""
    return screen(with_classes(requests), rules)
