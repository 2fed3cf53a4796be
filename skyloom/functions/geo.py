"""Earth geometry as column expressions: kilometres, degrees outside and radians inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.vectors import cross, dot, minus, norm, scaled, unit_bound, vec

#: WGS84 ellipsoid (km), its squared eccentricity, mean radius (km), rotation (rad/s) and gravitational parameter (km3/s2).
A = 6378.137
E2 = 6.69437999014e-3
RE = 6371.0
OMEGA = 7.292115e-5
MU = 398600.4418
F64 = "double"


def fov_half_angle_deg(swath_km: Column, alt_km: Column, re_km: float = RE) -> Column:
    """Half angle at the satellite that spans half a ground swath."""
    half = swath_km / 2 / re_km
    return F.degrees(F.atan2(F.lit(re_km) * F.sin(half), F.lit(re_km) * (1 - F.cos(half)) + alt_km))


def ground_half_swath_km(alt_km: Column, half_deg: Column, re_km: float = RE) -> Column:
    """Ground distance from nadir to the edge of the view; null past the limb."""
    eta = F.radians(half_deg)
    s = (alt_km + re_km) / re_km * F.sin(eta)
    return F.when(s < 1, re_km * (F.asin(unit_bound(s)) - eta))


def wrap180(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def geodetic_to_ecef(lat: Column, lon: Column, alt_km: Column) -> Column:
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(1 - E2 * F.pow(F.sin(phi), 2))
    return vec((n + alt_km) * F.cos(phi) * F.cos(lam), (n + alt_km) * F.cos(phi) * F.sin(lam), (n * (1 - E2) + alt_km) * F.sin(phi))


def ecef_to_geodetic(r: Column) -> Column:
    """Latitude and longitude in degrees, by Bowring's closed form."""
    b = A * (1 - E2) ** 0.5
    p = F.hypot(r["x"], r["y"])
    t = F.atan2(r["z"] * A, p * b)
    lat = F.atan2(r["z"] + (A * A - b * b) / b * F.pow(F.sin(t), 3), p - E2 * A * F.pow(F.cos(t), 3))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(r["y"], r["x"])).alias("lon"))


def gmst_rad(jd: Column) -> Column:
    """Greenwich mean sidereal time."""
    d = jd - 2451545.0
    t = d / 36525.0
    deg = 280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000.0
    return F.radians(F.pmod(deg, F.lit(360.0)))


def ecef_to_teme(r: Column, theta: Column) -> Column:
    c, s = F.cos(theta), F.sin(theta)
    return vec(c * r["x"] - s * r["y"], s * r["x"] + c * r["y"], r["z"])


def teme_to_ecef(r: Column, theta: Column) -> Column:
    c, s = F.cos(theta), F.sin(theta)
    return vec(c * r["x"] + s * r["y"], c * r["y"] - s * r["x"], r["z"])


def geodetic_up(lat: Column, lon: Column) -> Column:
    phi, lam = F.radians(lat), F.radians(lon)
    return vec(F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))


def nadir_unit(r: Column, theta: Column, ellipsoid: Column) -> Column:
    """Towards the Earth's centre, or against the ellipsoid's normal below the satellite."""
    below = ecef_to_geodetic(teme_to_ecef(r, theta))
    normal = ecef_to_teme(geodetic_up(below["lat"], below["lon"]), theta)
    return F.when(ellipsoid, scaled(normal, F.lit(-1.0))).otherwise(scaled(r, -1 / norm(r)))


def ellipsoid_intersect(p: Column, d: Column) -> Column:
    """Nearest point where a ray from p along d meets the ellipsoid; null if it misses or lies behind."""
    b2 = A * A * (1 - E2)
    a = (d["x"] * d["x"] + d["y"] * d["y"]) / (A * A) + d["z"] * d["z"] / b2
    h = (p["x"] * d["x"] + p["y"] * d["y"]) / (A * A) + p["z"] * d["z"] / b2
    c = (p["x"] * p["x"] + p["y"] * p["y"]) / (A * A) + p["z"] * p["z"] / b2 - 1
    disc = h * h - a * c
    k = (-h - F.sqrt(F.greatest(disc, F.lit(0.0)))) / a
    return F.when((disc >= 0) & (k > 0), vec(p["x"] + k * d["x"], p["y"] + k * d["y"], p["z"] + k * d["z"]))


def shoelace_centroid(ring: Column) -> Column:
    """Centroid <lon, lat> of an array of <lon, lat>: unwrapped and shifted to its first vertex; a ring without area has its vertices' mean."""
    origin = F.element_at(ring, 1)
    local = F.transform(ring, lambda v: F.struct(wrap180(v["lon"] - origin["lon"]).alias("x"), (v["lat"] - origin["lat"]).alias("y")))
    turned = F.concat(F.slice(local, F.lit(2), F.greatest(F.size(local) - 1, F.lit(0))), F.slice(local, F.lit(1), F.lit(1)))
    edges = F.zip_with(local, turned, lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("w"), (p["x"] + q["x"]).alias("sx"), (p["y"] + q["y"]).alias("sy")))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(edges, zero, lambda s, e: F.struct((s["a"] + e["w"]).alias("a"), (s["x"] + e["sx"] * e["w"]).alias("x"), (s["y"] + e["sy"] * e["w"]).alias("y")))
    mean = lambda k: F.aggregate(local, F.lit(0.0), lambda s, v: s + v[k]) / F.size(local)
    flat = F.abs(total["a"]) < 1e-14
    x = F.when(flat, mean("x")).otherwise(F.try_divide(total["x"], 3 * total["a"]))
    y = F.when(flat, mean("y")).otherwise(F.try_divide(total["y"], 3 * total["a"]))
    return F.struct(wrap180(origin["lon"] + x).alias("lon"), (origin["lat"] + y).alias("lat"))


def ring_ecef(ring: Column, alt_km: Column) -> Column:
    return F.transform(ring, lambda v: geodetic_to_ecef(v["lat"], v["lon"], alt_km))


def bbox_km(ring: Column) -> Column:
    """Diagonal of the bounding box of an array of vectors."""

    def extent(k: str) -> Column:
        axis = F.transform(ring, lambda v: v[k])
        return F.array_max(axis) - F.array_min(axis)

    spread = [extent(k) for k in "xyz"]
    return F.sqrt(sum((s * s for s in spread[1:]), spread[0] * spread[0]))


def airmass(zenith_deg: Column) -> Column:
    """Kasten and Young 1989; 40 where the formula breaks down."""
    z = F.least(zenith_deg, F.lit(90.0))
    low = F.cos(F.radians(z)) + 0.50572 * F.pow(F.lit(96.07995) - z, -1.6364)
    return F.when(low <= 0, F.lit(40.0)).otherwise(1 / low)


def specular_deg(view_zenith: Column, sun_zenith: Column, azimuth_gap: Column, sign: int) -> Column:
    """Angle between view and sun (sign +1: phase) or mirrored sun (sign -1: glint)."""
    v, s = F.radians(view_zenith), F.radians(sun_zenith)
    return F.degrees(F.acos(unit_bound(F.cos(v) * F.cos(s) + sign * F.sin(v) * F.sin(s) * F.cos(F.radians(azimuth_gap)))))


def glint_risk(glint_deg: Column) -> Column:
    return F.when(glint_deg < 20, "high").when(glint_deg < 40, "caution").otherwise("low")


def effective_gsd(gsd_m: Column, off_nadir_deg: Column, view_zenith_deg: Column) -> Column:
    return gsd_m / (F.cos(F.radians(off_nadir_deg)) * F.cos(F.radians(view_zenith_deg)))


def ground_velocity(v: Column, theta: Column, sat_ecef: Column) -> Column:
    """Velocity over the turning Earth."""
    return minus(teme_to_ecef(v, theta), vec(-OMEGA * sat_ecef["y"], OMEGA * sat_ecef["x"], F.lit(0.0)))


def local_axes(df: DataFrame) -> DataFrame:
    """Adds columns up, east, north (ECEF) at lat, lon. Each step is a column of its own, so that expressions stay short."""
    lam = F.radians("lon")
    df = df.withColumns({"up": geodetic_up(F.col("lat"), F.col("lon")), "east": vec(-F.sin(lam), F.cos(lam), F.lit(0.0))})
    return df.withColumn("north", cross(F.col("up"), F.col("east")))


def with_geometry(df: DataFrame, gsd_m: float) -> DataFrame:
    """Adds struct ``geometry``, unrounded, to rows with sat, site, up, east, north, moving (ECEF), v, eta and sun."""
    sat_lon = F.atan2(F.col("sat.y"), F.col("sat.x"))
    df = df.withColumns({"look": minus(F.col("sat"), F.col("site")), "sub_up": scaled(F.col("sat"), 1 / norm(F.col("sat"))), "sub_east": vec(-F.sin(sat_lon), F.cos(sat_lon), F.lit(0.0))})
    look = F.col("look")
    df = df.withColumns(
        {
            "sub_north": cross(F.col("sub_up"), F.col("sub_east")),
            "view_zenith": F.degrees(F.acos(unit_bound(dot(look, F.col("up")) / norm(look)))),
            "view_azimuth": F.pmod(F.degrees(F.atan2(dot(look, F.col("east")), dot(look, F.col("north")))), F.lit(360.0)),
            "sun_zenith": 90.0 - F.col("sun.elevation"),
        }
    )
    gap = F.col("view_azimuth") - F.col("sun.azimuth")
    df = df.withColumns({"glint": specular_deg(F.col("view_zenith"), F.col("sun_zenith"), gap, -1), "phase": specular_deg(F.col("view_zenith"), F.col("sun_zenith"), gap, 1)})
    fields = {
        "view_zenith_deg": F.col("view_zenith"),
        "phase_deg": F.col("phase"),
        "sun_glint_deg": F.col("glint"),
        "glint_risk": glint_risk(F.col("glint")),
        "effective_gsd_m": effective_gsd(F.lit(gsd_m), F.col("eta"), F.col("view_zenith")),
        "sun_azimuth_deg": F.col("sun.azimuth"),
        "view_azimuth_deg": F.col("view_azimuth"),
        "airmass_view": airmass(F.col("view_zenith")),
        "airmass_sun": airmass(F.col("sun_zenith")),
        "ground_track_heading_deg": F.pmod(F.degrees(F.atan2(dot(F.col("moving"), F.col("sub_east")), dot(F.col("moving"), F.col("sub_north")))), F.lit(360.0)),
        "node": F.when(F.col("v.z") >= 0, "ascending").otherwise("descending"),
    }
    return df.withColumn("geometry", F.struct(*[c.alias(k) for k, c in fields.items()])).drop("look", "sub_up", "sub_east", "sub_north", "view_zenith", "view_azimuth", "sun_zenith", "glint", "phase")


def with_footprint(df: DataFrame, swath_km: float, agile: bool, half_deg: float) -> DataFrame:
    """Adds ``footprint``: corners <lon, lat> of the imaged strip, centred on the area if agile, else slid onto the ground track; null past the limb."""
    df = df.withColumns({"rise": dot(F.col("moving"), F.col("up")), "sub": ecef_to_geodetic(F.col("sat"))})
    df = df.withColumns({"flat": minus(F.col("moving"), scaled(F.col("up"), F.col("rise"))), "below": geodetic_to_ecef(F.col("sub.lat"), F.col("sub.lon"), F.lit(0.0))})
    df = df.withColumn("track", scaled(F.col("flat"), 1 / norm(F.col("flat")))).withColumn("side", cross(F.col("up"), F.col("track")))
    across = F.lit(swath_km / 2) if agile else ground_half_swath_km(norm(minus(F.col("sat"), F.col("below"))), F.lit(half_deg))
    slide = F.lit(0.0) if agile else dot(minus(F.col("site"), F.col("below")), F.col("side"))
    df = df.withColumns({"half_along": F.greatest(bbox_km(F.col("ring_ecef")), F.lit(6.0)) / 2, "half_across": across, "slide": slide})
    signs = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1))])
    point = lambda s: vec(*[F.col(f"site.{k}") + s["a"] * F.col("half_along") * F.col(f"track.{k}") + (s["b"] * F.col("half_across") - F.col("slide")) * F.col(f"side.{k}") for k in "xyz"])
    df = df.withColumn("points", F.transform(signs, point)).withColumn("places", F.transform("points", ecef_to_geodetic))
    corners = F.transform("places", lambda g: F.struct(g["lon"].alias("lon"), g["lat"].alias("lat")))
    return df.withColumn("footprint", F.when(F.col("half_across").isNotNull(), corners)).drop("rise", "sub", "flat", "below", "track", "side", "half_along", "half_across", "slide", "points", "places")
