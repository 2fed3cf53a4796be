"""Streaming variants: element-set updates with the set before, and daily cloud means."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "norad long, epoch_us long, gap_days double, da_km double"


def element_updates(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Element sets (norad, epoch, ...) once each, however often they are delivered."""
    return stream.withWatermark("epoch", late).dropDuplicatesWithinWatermark(["norad", "epoch"])


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes from the newest set seen so far; sets older than it are passed over."""
    last_us, last_a = state.get if state.exists else (None, None)
    rows = []
    for batch in batches:
        for epoch_us, a_km in sorted(zip(batch["epoch_us"], batch["a_km"], strict=True)):
            if last_us is not None and epoch_us > last_us:
                rows.append((key[0], epoch_us, (epoch_us - last_us) / 8.64e10, a_km - last_a))
            if last_us is None or epoch_us > last_us:
                last_us, last_a = int(epoch_us), float(a_km)
    state.update((last_us, last_a))
    yield pd.DataFrame(rows, columns=["norad", "epoch_us", "gap_days", "da_km"])


def element_changes(stream: DataFrame) -> DataFrame:
    """Gap and rise of the semi-major axis from set to set of (norad, epoch_us, a_km); state is one set a satellite."""
    return stream.groupBy("norad").applyInPandasWithState(_follow, CHANGES, "epoch_us long, a_km double", "append", GroupStateTimeout.NoTimeout)


def daily_cloud(stream: DataFrame, late: str = "3 hours") -> DataFrame:
    """Mean cloud a UTC day of (ts, aoi_id, pct); a day is final once the watermark has passed it."""
    return stream.withWatermark("ts", late).groupBy("aoi_id", F.window("ts", "1 day")).agg(F.avg("pct").alias("pct"), F.count("pct").alias("n"))
