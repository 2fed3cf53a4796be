"""Element sets: 3LE text, history, latest set, and changes between sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skyloom.functions.geo import MU
from skyloom.operators.ordered import lagged

#: Rise of the semi-major axis a day (km) that drag can't explain, and the speed (km/s) that turns along-track error into time.
MANOEUVRE_KM_PER_DAY = 0.03
SPEED_KM_S = 7.5
#: Time that one task orders at once for a satellite.
BLOCK_US = 30 * 86_400_000_000


def parse_3le(text: DataFrame) -> DataFrame:
    """(source, norad, line1, line2, ord) from whole files in column ``value``: a line '1 ' directly before a line '2 '; of repeated numbers the last counts."""
    lines = text.select("source", F.posexplode(F.split(F.col("value"), r"\r?\n")).alias("ord", "line1"))
    pair = lines.withColumn("line2", F.lead("line1").over(W.partitionBy("source").orderBy("ord")))
    pair = pair.where(F.col("line1").startswith("1 ") & F.col("line2").startswith("2 ")).withColumn("norad", F.expr("try_cast(trim(substring(line1, 3, 5)) as int)"))
    return latest(pair.where("norad is not null"), ["source", "norad"], ["ord"])


def latest(sets: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last set of each key: an aggregation, so keys need not be sorted."""
    rest = [c for c in sets.columns if c not in by]
    return sets.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(*by, "s.*")


def for_roster(sets: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The roster with its sets, and the satellites without one. A roster has a row a satellite of the catalogue, so it is broadcast."""
    wanted = F.broadcast(roster.where("norad is not null"))
    return sets.join(wanted, "norad"), roster.join(sets.select("norad"), "norad", "left_anti")


def epoch_us(line1: Column) -> Column:
    """Epoch: two-digit years from 57 are of the last century; the day of the year has a fraction. Null where a line is malformed."""
    year = F.substring(line1, 19, 2).try_cast("int")
    full = F.when(year >= 57, 1900 + year).otherwise(2000 + year)
    return F.unix_micros(F.make_timestamp(full, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))) + F.round((F.substring(line1, 21, 12).try_cast("double") - 1) * 86_400_000_000).cast("long")


def semi_major_km(mean_motion_rev_day: Column) -> Column:
    n = mean_motion_rev_day * 2 * 3.141592653589793 / 86400
    return F.cbrt(MU / (n * n))


def changes(sets: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Change of the semi-major axis from each set to the next of its satellite; ``sets`` has epoch_us and a_km, and ``order`` begins with epoch_us."""
    both = lagged(sets, by, "epoch_us", order, ["epoch_us", "a_km"], BLOCK_US, "__before")
    both = both.withColumns({"gap_days": (F.col("epoch_us") - F.col("__before.epoch_us")) / 8.64e10, "da_km": F.col("a_km") - F.col("__before.a_km")}).drop("__before")
    return both.where("gap_days > 0").withColumn("manoeuvred", F.col("da_km") / F.col("gap_days") > MANOEUVRE_KM_PER_DAY)
