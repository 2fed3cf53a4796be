"""Deep-space terms for orbits of 225 minutes and more: pull of sun and moon, and resonance with the earth's turning.

After Hoots and Roehrich, "Models for Propagation of NORAD Element Sets" (1980), and Vallado et al., "Revisiting
Spacetrack Report #3" (2006). The pull of each body gives secular rates and periodic terms. Orbits of about a day, and
eccentric ones of about half a day, also resonate: their mean longitude and motion are integrated in steps of half a day.
The steps are kept as a table that grows outwards from the epoch, so an array of times is answered by one lookup, then a
Taylor step for all times together.
"""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace as Terms

import numpy as np

TURN = 2 * np.pi
MU, RE = 398600.8, 6378.135
XKE = 60.0 / np.sqrt(RE**3 / MU)
#: Turn of the earth in a minute (rad), step of the integrator (minutes), inclination below which the node is not moved secularly.
EARTH_RATE = 4.37526908801129966e-3
STEP_MIN = 720.0
FLAT_RAD = 5.2359877e-2
#: Fixed value: inclination (rad) below which periodic terms are applied by Lyddane's change of variables.
LYDDANE_RAD = 0.2
#: Phases (rad) of the day's and the half day's resonance, and strengths of the geopotential's terms.
DAY_PHASES = (0.13130908, 2.8843198, 0.37448087)
Q22, Q31, Q33 = 1.7891679e-6, 2.1460748e-6, 2.2123015e-7
HALF_DAY_PHASES = {"22": 5.7686396, "32": 0.95240898, "44": 1.8014998, "52": 1.0508330, "54": 4.4108898}
HALF_DAY_STRENGTHS = {"22": 1.7891679e-6, "32": 3.7393792e-7, "44": 7.3636953e-9, "52": 1.1428639e-7, "54": 2.1765803e-9}


@dataclass(frozen=True)
class Body:
    """Strength, eccentricity and mean motion (rad a minute) of a perturbing body."""

    strength: float
    e: float
    rate: float


#: Fixed values.
SUN = Body(2.9864797e-6, 0.01675, 1.19459e-5)
MOON = Body(4.7968065e-7, 0.05490, 1.5835218e-4)


def sidereal(days_1950: float) -> float:
    """Greenwich sidereal time (rad) at days since 1949-12-31, the 1982 expression."""
    t = (days_1950 + 2433281.5 - 2451545.0) / 36525
    seconds = 67310.54841 + (876600 * 3600 + 8640184.812866) * t + 0.093104 * t * t - 6.2e-6 * t**3
    return float(np.fmod(np.radians(seconds / 240), TURN) % TURN)


def pull(body: Body, orientation: tuple, anomaly: float, e: float, incl: float, argp: float, n: float) -> Terms:
    """Secular rates and coefficients of the periodic terms that a body gives an orbit.

    ``orientation``: cosine and sine of the body's argument of perigee, inclination, and node measured from the orbit's node.
    """
    cg, sg, ci, si, ch, sh = orientation
    cw, sw, cm, sm = np.cos(argp), np.sin(argp), np.cos(incl), np.sin(incl)
    e2 = e * e
    beta2 = 1 - e2
    # The body's perigee direction (p) and the one ahead of it (q), in axes of the orbit: node, in plane, across.
    p = (cg * ch + sg * ci * sh, cm * (-cg * sh + sg * ci * ch) + sm * sg * si, -sm * (-cg * sh + sg * ci * ch) + cm * sg * si)
    q = (-sg * ch + cg * ci * sh, cm * (sg * sh + cg * ci * ch) + sm * cg * si, -sm * (sg * sh + cg * ci * ch) + cm * cg * si)
    # The same turned to the orbit's perigee.
    x1, x2 = p[0] * cw + p[1] * sw, q[0] * cw + q[1] * sw
    x3, x4 = -p[0] * sw + p[1] * cw, -q[0] * sw + q[1] * cw
    x5, x6, x7, x8 = p[2] * sw, q[2] * sw, p[2] * cw, q[2] * cw
    z31, z32, z33 = 12 * x1 * x1 - 3 * x3 * x3, 24 * x1 * x2 - 6 * x3 * x4, 12 * x2 * x2 - 3 * x4 * x4
    z1 = 6 * (p[0] ** 2 + p[1] ** 2) + (1 + e2) * z31
    z2 = 12 * (p[0] * q[0] + p[1] * q[1]) + (1 + e2) * z32
    z3 = 6 * (q[0] ** 2 + q[1] ** 2) + (1 + e2) * z33
    z11 = -6 * p[0] * p[2] + e2 * (-24 * x1 * x7 - 6 * x3 * x5)
    z12 = -6 * (p[0] * q[2] + q[0] * p[2]) + e2 * (-24 * (x2 * x7 + x1 * x8) - 6 * (x3 * x6 + x4 * x5))
    z13 = -6 * q[0] * q[2] + e2 * (-24 * x2 * x8 - 6 * x4 * x6)
    z21 = 6 * p[1] * p[2] + e2 * (24 * x1 * x5 - 6 * x3 * x7)
    z22 = 6 * (q[1] * p[2] + p[1] * q[2]) + e2 * (24 * (x2 * x5 + x1 * x6) - 6 * (x4 * x7 + x3 * x8))
    z23 = 6 * q[1] * q[2] + e2 * (24 * x2 * x6 - 6 * x4 * x8)
    s3 = body.strength / n
    s2, s4 = -0.5 * s3 / np.sqrt(beta2), s3 * np.sqrt(beta2)
    s1 = -15 * e * s4
    flat = incl < FLAT_RAD or incl > np.pi - FLAT_RAD
    node = 0.0 if flat or sm == 0 else -body.rate * s2 * (z21 + z23) / sm
    return Terms(
        body=body,
        anomaly=anomaly,
        de=body.rate * s1 * (x1 * x3 + x2 * x4),
        di=body.rate * s2 * (z11 + z13),
        dm=-body.rate * s3 * (z1 + z3 - 14 - 6 * e2),
        dargp=body.rate * s4 * (z31 + z33 - 6) - cm * node,
        dnode=node,
        e=(2 * s1 * (x2 * x3 + x1 * x4), 2 * s1 * (x2 * x4 - x1 * x3), 0.0),
        i=(2 * s2 * z12, 2 * s2 * (z13 - z11), 0.0),
        l=(-2 * s3 * z2, -2 * s3 * (z3 - z1), 2 * s3 * (21 + 9 * e2) * body.e),
        g=(2 * s4 * z32, 2 * s4 * (z33 - z31), -18 * s4 * body.e),
        h=(-2 * s2 * z22, -2 * s2 * (z23 - z21), 0.0),
    )


def bodies(days_1950: float, e: float, incl: float, argp: float, node: float, n: float) -> tuple[Terms, Terms]:
    """The sun's and the moon's pull, with both bodies where they are at the epoch."""
    day = days_1950 + 18261.5
    cn, sn = np.cos(node), np.sin(node)
    sun = pull(SUN, (0.1945905, -0.98088458, 0.91744867, 0.39785416, cn, sn), np.fmod(6.2565837 + 0.017201977 * day, TURN), e, incl, argp, n)
    lunar_node = np.fmod(4.5236020 - 9.2422029e-4 * day, TURN)
    sl, cl = np.sin(lunar_node), np.cos(lunar_node)
    ci = 0.91375164 - 0.03568096 * cl
    si = np.sqrt(1 - ci * ci)
    sh = 0.089683511 * sl / si
    ch = np.sqrt(1 - sh * sh)
    perigee = 5.8351514 + 0.0019443680 * day
    g = perigee + np.arctan2(0.39785416 * sl / si, ch * cl + 0.91744867 * sh * sl) - lunar_node
    moon = pull(MOON, (np.cos(g), np.sin(g), ci, si, ch * cn + sh * sn, sn * ch - cn * sh), np.fmod(4.7199672 + 0.22997150 * day - perigee, TURN), e, incl, argp, n)
    return sun, moon


class DayResonance:
    """Orbits of about a day: mean longitude over the turning earth."""

    def __init__(self, o, a_inverse: float, rates: Terms, theta: float):
        c, s, e2 = np.cos(o.i), np.sin(o.i), o.e * o.e
        k = 3 * o.n**2 * a_inverse**2
        self.strength = (
            k * (0.9375 * s * s * (1 + 3 * c) - 0.75 * (1 + c)) * (1 + 2 * e2) * Q31 * a_inverse,
            2 * k * 0.75 * (1 + c) ** 2 * (1 + e2 * (-2.5 + 0.8125 * e2)) * Q22,
            3 * k * 1.875 * (1 + c) ** 3 * (1 + e2 * (-6 + 6.60937 * e2)) * Q33 * a_inverse,
        )
        self.start = np.fmod(o.m + o.node + o.argp - theta, TURN)
        self.drift = o.mdot + o.argpdot + o.nodedot - EARTH_RATE + rates.m + rates.argp + rates.node - o.n

    def slopes(self, long, atime):
        """Change of the mean motion, and its change by longitude."""
        turns = [(k + 1) * (long - phase) for k, phase in enumerate(DAY_PHASES)]
        first = sum(d * np.sin(x) for d, x in zip(self.strength, turns, strict=True))
        return first, sum((k + 1) * d * np.cos(x) for k, (d, x) in enumerate(zip(self.strength, turns, strict=True)))

    def anomaly(self, long, argp, node, theta):
        return long - node - argp + theta


def _cubic(e: float, *k: float) -> float:
    return sum(c * e**p for p, c in enumerate(k))


def eccentricity_functions(e: float) -> dict[str, float]:
    """Fixed polynomials in the eccentricity, by their usual numbers; the pieces meet at 0.65, 0.7 and 0.715."""
    g = {"201": -0.306 - (e - 0.64) * 0.440}
    if e <= 0.65:
        g["211"] = _cubic(e, 3.616, -13.2470, 16.2900)
        g["310"] = _cubic(e, -19.302, 117.3900, -228.4190, 156.5910)
        g["322"] = _cubic(e, -18.9068, 109.7927, -214.6334, 146.5816)
        g["410"] = _cubic(e, -41.122, 242.6940, -471.0940, 313.9530)
        g["422"] = _cubic(e, -146.407, 841.8800, -1629.014, 1083.4350)
        g["520"] = _cubic(e, -532.114, 3017.977, -5740.032, 3708.2760)
    else:
        g["211"] = _cubic(e, -72.099, 331.819, -508.738, 266.724)
        g["310"] = _cubic(e, -346.844, 1582.851, -2415.925, 1246.113)
        g["322"] = _cubic(e, -342.585, 1554.908, -2366.899, 1215.972)
        g["410"] = _cubic(e, -1052.797, 4758.686, -7193.992, 3651.957)
        g["422"] = _cubic(e, -3581.690, 16178.110, -24462.770, 12422.520)
        g["520"] = _cubic(e, -5149.66, 29936.92, -54087.36, 31324.56) if e > 0.715 else _cubic(e, 1464.74, -4664.75, 3763.64)
    if e < 0.7:
        g["533"] = _cubic(e, -919.22770, 4988.6100, -9064.7700, 5542.21)
        g["521"] = _cubic(e, -822.71072, 4568.6173, -8491.4146, 5337.524)
        g["532"] = _cubic(e, -853.66600, 4690.2500, -8624.7700, 5341.4)
    else:
        g["533"] = _cubic(e, -37995.780, 161616.52, -229838.20, 109377.94)
        g["521"] = _cubic(e, -51752.104, 218913.95, -309468.16, 146349.42)
        g["532"] = _cubic(e, -40023.880, 170470.89, -242699.48, 115605.82)
    return g


class HalfDayResonance:
    """Eccentric orbits of about half a day."""

    def __init__(self, o, a_inverse: float, rates: Terms, theta: float):
        c, s = np.cos(o.i), np.sin(o.i)
        c2, s2 = c * c, s * s
        g = eccentricity_functions(o.e)
        f220 = 0.75 * (1 + 2 * c + c2)
        f = {
            "220": f220,
            "221": 1.5 * s2,
            "321": 1.875 * s * (1 - 2 * c - 3 * c2),
            "322": -1.875 * s * (1 + 2 * c - 3 * c2),
            "441": 35 * s2 * f220,
            "442": 39.3750 * s2 * s2,
            "522": 9.84375 * s * (s2 * (1 - 2 * c - 5 * c2) + 0.33333333 * (-2 + 4 * c + 6 * c2)),
            "523": s * (4.92187512 * s2 * (-2 - 4 * c + 10 * c2) + 6.56250012 * (1 + 2 * c - 3 * c2)),
            "542": 29.53125 * s * (2 - 8 * c + c2 * (-12 + 8 * c + 10 * c2)),
            "543": 29.53125 * s * (-2 - 8 * c + c2 * (12 + 8 * c - 10 * c2)),
        }
        # Each term: multiples of the argument of perigee and of the longitude, the geopotential's term, inclination and eccentricity functions.
        rows = [(2, 1, "22", "220", "201"), (0, 1, "22", "221", "211"), (1, 1, "32", "321", "310"), (-1, 1, "32", "322", "322"), (2, 2, "44", "441", "410"), (0, 2, "44", "442", "422"), (1, 1, "52", "522", "520"), (-1, 1, "52", "523", "532"), (1, 2, "54", "542", "521"), (-1, 2, "54", "543", "533")]
        base = 3 * o.n**2
        self.terms = [(w, l, HALF_DAY_PHASES[k], l * base * a_inverse ** int(k[0]) * HALF_DAY_STRENGTHS[k] * f[fi] * g[gi]) for w, l, k, fi, gi in rows]
        self.argp, self.argpdot = o.argp, o.argpdot
        self.start = np.fmod(o.m + 2 * o.node - 2 * theta, TURN)
        self.drift = o.mdot + rates.m + 2 * (o.nodedot + rates.node - EARTH_RATE) - o.n

    def slopes(self, long, atime):
        w = self.argp + self.argpdot * atime
        turns = [(a * w + l * long - phase, l, d) for a, l, phase, d in self.terms]
        return sum(d * np.sin(x) for x, _, d in turns), sum(l * d * np.cos(x) for x, l, d in turns)

    def anomaly(self, long, argp, node, theta):
        return long - 2 * node + 2 * theta


class DeepSpace:
    """What sun, moon and resonance do to an orbit; made from a prepared ``Orbit``."""

    def __init__(self, o):
        days = o.epoch_us / 86_400e6 + 7306
        self.pulls = bodies(days, o.e, o.i, o.argp, o.node, o.n)
        self.rates = Terms(**{k: sum(getattr(p, f"d{k}") for p in self.pulls) for k in ("e", "i", "m", "argp", "node")})
        self.n, self.theta = o.n, sidereal(days)
        self.resonance = None
        kind = DayResonance if 0.0034906585 < o.n < 0.0052359877 else HalfDayResonance if 8.26e-3 <= o.n <= 9.24e-3 and o.e >= 0.5 else None
        if kind:
            self.resonance = kind(o, (o.n / XKE) ** (2 / 3), self.rates, self.theta)
            # Tables of longitude and mean motion at whole steps after and before the epoch.
            self.steps = {sign: [(self.resonance.start, o.n)] for sign in (1, -1)}

    def _table(self, sign: int, last: int) -> np.ndarray:
        table, r = self.steps[sign], self.resonance
        while len(table) <= last:
            long, n = table[-1]
            first, second = r.slopes(long, sign * STEP_MIN * (len(table) - 1))
            ldot, half = n + r.drift, STEP_MIN**2 / 2
            table.append((long + sign * STEP_MIN * ldot + half * first, n + sign * STEP_MIN * first + half * second * ldot))
        return np.array(table)

    def secular(self, t, m, argp, node):
        """Mean anomaly, perigee, node, eccentricity's and inclination's change and mean motion after t minutes."""
        r = self.rates
        m, argp, node = m + r.m * t, argp + r.argp * t, node + r.node * t
        n = np.full(t.shape, self.n)
        if self.resonance is not None:
            k = np.trunc(np.where(np.isfinite(t), t, 0) / STEP_MIN).astype(np.int64)
            after, before = self._table(1, int(k.max(initial=0))), self._table(-1, int(-k.min(initial=0)))
            long, n0 = np.where((k >= 0)[..., None], after[np.maximum(k, 0)], before[np.maximum(-k, 0)]).transpose(-1, *range(t.ndim))
            at = k * STEP_MIN
            first, second = self.resonance.slopes(long, at)
            rest, ldot = t - at, n0 + self.resonance.drift
            n = n0 + first * rest + second * ldot * rest**2 / 2
            long = long + ldot * rest + first * rest**2 / 2
            m = self.resonance.anomaly(long, argp, node, np.fmod(self.theta + t * EARTH_RATE, TURN))
        return m, argp, node, r.e * t, r.i * t, n

    def periodic(self, t, e, incl, argp, node, m):
        """Elements with the periodic terms of sun and moon."""
        add = dict.fromkeys("eilgh", 0.0)
        for p in self.pulls:
            z = p.anomaly + p.body.rate * t
            z = z + 2 * p.body.e * np.sin(z)
            s = np.sin(z)
            f = (0.5 * s * s - 0.25, -0.5 * s * np.cos(z), s)
            for k in add:
                add[k] = add[k] + sum(c * x for c, x in zip(getattr(p, k), f, strict=True))
        incl, e = incl + add["i"], e + add["e"]
        s, c = np.sin(incl), np.cos(incl)
        steep = incl >= LYDDANE_RAD
        turned = add["h"] / np.where(steep, s, 1.0)
        node = np.where(steep, node, np.fmod(node, TURN))
        # Near the equator the node is ill defined: the pole's direction moves instead.
        sn, cn = np.sin(node), np.cos(node)
        east = s * sn + add["h"] * cn + add["i"] * c * sn
        north = s * cn - add["h"] * sn + add["i"] * c * cn
        near = np.arctan2(east, north)
        near = near + TURN * np.round((node - near) / TURN)
        sums = m + argp + c * node + add["l"] + add["g"] - add["i"] * node * s
        m = m + add["l"]
        argp = np.where(steep, argp + add["g"] - c * turned, sums - m - c * near)
        node = np.where(steep, node + turned, near)
        return e, incl, argp, node, m
