"""Workbooks as Office Open XML, with the standard library: what their sheets hold, and a small one in memory.

``sources/books.py`` writes them from tasks."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.clouds import has_cloud

#: The sheets' column titles.
HEADERS = ["Satellite", "Datetime (TCA, UTC)", "Local ({tz})", "Off Nadir Angle (°)", "Sun Angle of Elevation (°)", "Max Off Nadir across AOI (°)", "Slant Range (km)", "TLE Epoch (UTC)"]
QUALITY = ["Quality", "AOI Coverage %", "Node", "Eff. GSD (m)", "View Zenith (°)", "Sun Glint (°)", "Glint Risk", "Sun Airmass", "TCA ± (s)"]
CLOUD = ["Cloud % (total@TCA)", "Cloud low/mid/high %", "P(cloud<thr)", "Cloud spread (min–max %)", "Cloud label", "Hist. clear-sky rate (mon)"]
SHEETS = {"passes": "Passes", "marginal": "Marginal - stretch", "nonoperational": "Non-operational"}
_TYPES = '<?xml version="1.0" encoding="UTF-8"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"


def cloud_cells() -> list[Column]:
    """Six cells of an outlook; n/a where it has no value."""
    whole = lambda k: F.format_string("%.0f", F.bround(f"cloud.{k}"))
    given = lambda test, text: F.when(F.col(test).isNotNull(), text).otherwise("n/a")
    spread = F.concat(*[F.format_string("%.0f", F.bround(F.get("cloud.spread_pct", i))) if i < 2 else F.lit("–") for i in (0, 2, 1)])
    layers = [F.coalesce(F.when(F.col(f"cloud.{k}_pct").isNotNull(), whole(f"{k}_pct")), F.lit("n/a")) for k in ("low", "mid", "high")]
    return [
        given("cloud.total_pct", whole("total_pct")), given("cloud.low_pct", F.concat_ws("/", *layers)), given("cloud.p_clear", F.format_string("%.2f", "cloud.p_clear")), given("cloud.spread_pct", spread),
        given("cloud", F.col("cloud.label")), given("cloud.clim_clear_pct", F.concat(whole("clim_clear_pct"), F.lit("%"))),
    ]


def sheet_rows(passes: DataFrame, tz: str, with_aoi: bool = False, with_cloud: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Passes as the cells of a sheet, with ``keys``, bucket and tca_us to split and order by."""
    utc = lambda us: F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    local = F.date_format(F.from_utc_timestamp(F.timestamp_micros(F.col("tca_us")), tz), "yyyy-MM-dd HH:mm")
    g = lambda k, n: F.round(f"geometry.{k}", n)
    share = F.coalesce(F.format_string("%.0f%%", F.col("coverage_pct") * 100), F.lit("n/a"))
    cells = [
        F.col("satellite"), utc(F.col("tca_us")), local, F.round("off_nadir_deg", 1), F.round("sun_elev_deg", 4), F.round("max_off_nadir_aoi_deg", 1), F.round("slant_range_km", 0), utc(F.col("tle_epoch_us")),
        F.col("quality"), F.when(F.col("coverage_pct").isNull(), "n/a").otherwise(share), F.substring("node", 1, 3), g("effective_gsd_m", 2), g("view_zenith_deg", 1), g("sun_glint_deg", 1), F.col("geometry.glint_risk"), g("airmass_sun", 2), F.round("timing_sigma_s", 2),
    ]
    names = [h.format(tz=tz) for h in HEADERS] + QUALITY
    if with_cloud:
        cells, names = cells + cloud_cells(), names + CLOUD
    aoi = [F.col("name").alias("AOI")] if with_aoi else []
    return passes.select(*keys, "bucket", "tca_us", *aoi, *[c.alias(n) for c, n in zip(cells, names, strict=True)])


def column(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def cell(row: int, k: int, value, bold: bool = False) -> str:
    """Numbers as numbers; text always as text, so that a leading = stays text. ("=", formula) pairs are formulas."""
    at, style = f"{column(k)}{row}", ' s="1"' if bold else ""
    if value is None:
        return ""
    if isinstance(value, tuple):
        return f'<c r="{at}"{style}><f>{escape(value[1])}</f></c>'
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{at}"{style}><v>{value}</v></c>'
    return f'<c r="{at}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def row_xml(at: int, values: list, bold: bool = False) -> str:
    return f'<row r="{at}">' + "".join(cell(at, k, v, bold) for k, v in enumerate(values)) + "</row>"


SHEET_HEAD = f'{_TYPES}<worksheet xmlns="{_MAIN}"><cols><col min="1" max="40" width="24" customWidth="1"/></cols><sheetData>'
SHEET_TAIL = "</sheetData></worksheet>"


def sheet_xml(rows: list[list], bold_rows: frozenset[int] = frozenset({0})) -> str:
    return SHEET_HEAD + "".join(row_xml(i + 1, r, i in bold_rows) for i, r in enumerate(rows)) + SHEET_TAIL


def frame(titles: list[str]) -> dict[str, str]:
    """The members of an .xlsx beside its sheets, by name."""
    n = range(1, len(titles) + 1)
    parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
    return {
        "[Content_Types].xml": f'{_TYPES}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{parts}</Types>',
        "_rels/.rels": f'{_TYPES}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_TYPES}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(t)}" sheetId="{i}" r:id="r{i}"/>' for i, t in zip(n, titles, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{_TYPES}<Relationships xmlns="{_PACK}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + f'<Relationship Id="rs" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{_TYPES}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
    }


def workbook(sheets: list[tuple[str, list[list]]]) -> bytes:
    """An .xlsx of named sheets of rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        for name, text in frame([t for t, _ in sheets]).items():
            box.writestr(name, text)
        for i, (_, rows) in enumerate(sheets):
            box.writestr(f"xl/worksheets/sheet{i + 1}.xml", sheet_xml(rows))
    return out.getvalue()


def position(lat: Column, lon: Column) -> Column:
    """A place by degrees and hemisphere."""
    side = lambda x, below, above: F.concat(F.format_string("%.5f ", F.abs(x)), F.when(x < 0, below).otherwise(above))
    return F.concat(side(lat, "S", "N"), F.lit(", "), side(lon, "W", "E"))


def report(passes: DataFrame, aois: list[str], satellites: list[str], tz: str, notes: list[tuple[str, str]], hints: dict[str, str] | None = None, lanes: list[list] | None = None) -> bytes:
    """The workbook of one report: a sheet a bucket, live counts, notes, and the timeline's bars.

    Counts are by satellite of the roster for one area, by area for several; their criterion is a cell, so that a name with
    quotes can't break the formula. ``hints``: a line below a bucket's rows.
    """
    with_aoi = len(aois) > 1
    cells = sheet_rows(passes, tz, with_aoi, has_cloud(passes)).orderBy("tca_us")
    names = cells.columns[2:]
    held: dict[str, list[list]] = {b: [] for b in SHEETS}
    for r in cells.collect():
        held[r["bucket"]].append(list(r)[2:])
    sheets = []
    for bucket, title in SHEETS.items():
        if bucket == "nonoperational" and not held[bucket]:
            continue
        rows = [names, *held[bucket]]
        if bucket == "passes":
            last, first = max(2, len(rows)), len(rows) + 4
            counted = aois if with_aoi else sorted(satellites)
            rows += [[], [], ["Passes per AOI" if with_aoi else "Passes per satellite"]]
            rows += [[s, ("=", f"COUNTIF(A2:A{last},A{first + i})")] for i, s in enumerate(counted)]
            rows.append(["Total", ("=", f"SUM(B{first}:B{first + len(counted) - 1})")])
        elif hints and bucket in hints:
            rows += [[], [hints[bucket]]]
        sheets.append((title, rows))
    sheets.append(("Method", [["Item", "Value"], *map(list, notes)]))
    return workbook([*sheets, ("Timeline", lanes)] if lanes else sheets)
