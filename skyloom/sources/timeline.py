"""Timeline data: bars of passes, daily cloud strip, and an SVG of both."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.grading import cloud_band, offnadir_band

HALF_BAR_US = 3 * 3_600_000_000
#: Colours of the off-nadir and cloud bands.
COLOURS = ["#22c55e", "#f59e0b", "#ef4444"]
CLOUDS = {"clear": "#bcd9f5", "partly": "#9aa7b4", "cloudy": "#5c6b7f", "unknown": "#e9edf1"}


def bars(passes: DataFrame) -> DataFrame:
    """A bar a pass, three hours to either side of closest approach."""
    return passes.withColumns(
        {
            "left_us": F.col("tca_us") - HALF_BAR_US,
            "right_us": F.col("tca_us") + HALF_BAR_US,
            "band": offnadir_band(F.abs("off_nadir_deg")),
            "hatched": ~F.col("operational"),
            "label": F.format_string("%.1f", F.abs("off_nadir_deg")),
        }
    )


def strip(daily: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """A cell a day; days without cloud data are unknown."""
    spine = daily.sparkSession.range(first_day, last_day + 1).withColumnRenamed("id", "day")
    return spine.join(daily, "day", "left").withColumn("band", cloud_band(F.col("pct")))


def svg(bar_rows: list[dict], strip_rows: list[dict], satellites: list[tuple[str, bool]], start_us: int, end_us: int) -> str:
    """A drawing of the bars of one run, a lane a satellite of its roster; rows are those of one report."""
    width, lane, top = 1100.0, 30, 40
    x = lambda us: 120 + (us - start_us) / max(1, end_us - start_us) * (width - 140)
    lanes = {s: k for k, (s, _) in enumerate(satellites)}
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{top + lane * len(lanes) + 20}" font-family="sans-serif" font-size="10">', '<defs><pattern id="h" width="5" height="5" patternUnits="userSpaceOnUse"><path d="M0 5L5 0" stroke="#1b2230"/></pattern></defs>']
    for s in strip_rows:
        a, b = x(s["day"] * 86_400_000_000), x((s["day"] + 1) * 86_400_000_000)
        out.append(f'<rect x="{a:.1f}" y="10" width="{b - a:.1f}" height="14" fill="{CLOUDS[s["band"]]}"/>')
    for name, operational in satellites:
        out.append(f'<text x="4" y="{top + lane * lanes[name] + 18}">{escape(name)}{"" if operational else " (non-op)"}</text>')
    for b in bar_rows:
        y = top + lane * lanes[b["satellite"]] + 6
        box = f'x="{x(b["left_us"]):.1f}" y="{y}" width="{x(b["right_us"]) - x(b["left_us"]):.1f}" height="16"'
        out.append(f'<rect {box} fill="{COLOURS[b["band"]]}"/>' + (f'<rect {box} fill="url(#h)"/>' if b["hatched"] else "") + f'<text x="{x(b["left_us"]):.1f}" y="{y - 1}">{escape(b["label"])}</text>')
    return "\n".join([*out, "</svg>"])
