"""Record cleaning over streams.

The engine's batch operators have no streaming state; cleaning is narrow, so the same expressions run on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import BlockingConfig
from ..plans.normalize import add_text


def clean_stream(rows: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """add_text on a batch or streaming DataFrame (block keys need counts over all rows and stay in batch)."""
    return add_text(rows, config).drop("geo")
