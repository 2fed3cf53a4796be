"""SGP4 over arrays of times; orbits of 225 minutes and more have the terms of ``deepspace``.

After Hoots and Roehrich, "Models for Propagation of NORAD Element Sets" (1980), and Vallado et al., "Revisiting
Spacetrack Report #3" (2006), with WGS-72 constants. Error codes are the paper's: 1 eccentricity, 2 mean motion,
3 eccentricity with periodic terms, 4 semi-latus rectum, 6 decayed; 7 is this module's for elements that are no orbit.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from skyloom.functions.deepspace import MU, RE, TURN, XKE, DeepSpace

J2, J3, J4 = 0.001082616, -0.00000253881, -0.00000165597
DEEP_MINUTES = 225.0


def exponent_field(text: str) -> float:
    """A field such as ' 28098-4': an implied decimal point, then a power of ten."""
    text = text.strip() or "00000-0"
    sign = -1 if text[0] == "-" else 1
    body = text.lstrip("+-")
    cut = max(body.rfind("-"), body.rfind("+"))
    return sign * float("0." + body[:cut].strip()) * 10.0 ** int(body[cut:])


def _long_period(c, s):
    """Coefficients of the long-period terms from cosine and sine of the inclination."""
    return -0.25 * (J3 / J2) * s * (3 + 5 * c) / np.where(np.abs(c + 1) > 1.5e-12, 1 + c, 1.5e-12), -0.5 * (J3 / J2) * s


class Orbit:
    """Elements of one set, with everything that doesn't depend on time."""

    def __init__(self, line1: str, line2: str):
        year = int(line1[18:20])
        self.epoch_us = (np.datetime64(f"{year + (1900 if year >= 57 else 2000)}-01-01T00:00:00", "us").astype(np.int64)) + round((float(line1[20:32]) - 1) * 86_400e6)
        self.bstar = exponent_field(line1[53:61])
        deg = np.pi / 180
        self.i, self.node, self.e = float(line2[8:16]) * deg, float(line2[17:25]) * deg, float("0." + line2[26:33].strip())
        self.argp, self.m = float(line2[34:42]) * deg, float(line2[43:51]) * deg
        kozai = float(line2[52:63]) * TURN / 1440
        self.kozai = kozai
        self.refused = kozai <= 0 or not 0 <= self.e < 1
        if not self.refused:
            self._prepare(kozai)

    def _prepare(self, kozai: float) -> None:
        e, bstar = self.e, self.bstar
        c, s = np.cos(self.i), np.sin(self.i)
        c2 = c * c
        beta2 = 1 - e * e
        beta = np.sqrt(beta2)
        a1 = (XKE / kozai) ** (2 / 3)
        d1 = 0.75 * J2 * (3 * c2 - 1) / (beta * beta2)
        d = d1 / a1**2
        a0 = a1 * (1 - d * d - d * (1 / 3 + 134 * d * d / 81))
        n = kozai / (1 + d1 / a0**2)
        a = (XKE / n) ** (2 / 3)
        self.n = n
        p2 = (a * beta2) ** 2
        low = a * (1 - e)
        self.simple = low < 220 / RE + 1
        height = (low - 1) * RE
        edge = 78.0 if height >= 156 else max(20.0, height - 78)
        q = ((120 - edge) / RE) ** 4
        edge = edge / RE + 1
        xi = 1 / (a - edge)
        eta = a * e * xi
        eta2, ee = eta * eta, e * eta
        psi2 = abs(1 - eta2)
        k = q * xi**4
        k1 = k / psi2**3.5
        con = 3 * c2 - 1
        inc2 = 1 - c2
        cc2 = k1 * n * (a * (1 + 1.5 * eta2 + ee * (4 + eta2)) + 0.375 * J2 * xi / psi2 * con * (8 + 3 * eta2 * (8 + eta2)))
        c1 = bstar * cc2
        c3 = -2 * k * xi * (J3 / J2) * n * s / e if e > 1e-4 else 0.0
        self.c4 = 2 * n * k1 * a * beta2 * (eta * (2 + 0.5 * eta2) + e * (0.5 + 2 * eta2) - J2 * xi / (a * psi2) * (-3 * con * (1 - 2 * ee + eta2 * (1.5 - 0.5 * ee)) + 0.75 * inc2 * (2 * eta2 - ee * (1 + eta2)) * np.cos(2 * self.argp)))
        self.c5 = 2 * k1 * a * beta2 * (1 + 2.75 * (eta2 + ee) + ee * eta2)
        t1 = 1.5 * J2 / p2 * n
        t2 = 0.5 * t1 * J2 / p2
        t3 = -0.46875 * J4 / p2**2 * n
        c4 = c2 * c2
        self.mdot = n + 0.5 * t1 * beta * con + 0.0625 * t2 * beta * (13 - 78 * c2 + 137 * c4)
        self.argpdot = -0.5 * t1 * (1 - 5 * c2) + 0.0625 * t2 * (7 - 114 * c2 + 395 * c4) + t3 * (3 - 36 * c2 + 49 * c4)
        self.nodedot = -t1 * c + (0.5 * t2 * (4 - 19 * c2) + 2 * t3 * (3 - 7 * c2)) * c
        self.omgcof = bstar * c3 * np.cos(self.argp)
        self.xmcof = -2 / 3 * k * bstar / ee if e > 1e-4 else 0.0
        self.nodecf = 3.5 * beta2 * -t1 * c * c1
        self.t2cof = 1.5 * c1
        self.xlcof, self.aycof = _long_period(c, s)
        self.delmo, self.sinmo = (1 + eta * np.cos(self.m)) ** 3, np.sin(self.m)
        self.c1, self.eta, self.con, self.inc2, self.c7 = c1, eta, con, inc2, 7 * c2 - 1
        d2 = 4 * a * xi * c1 * c1
        t = d2 * xi * c1 / 3
        d3 = (17 * a + edge) * t
        d4 = 0.5 * t * a * xi * (221 * a + 31 * edge) * c1
        self.d = (d2, d3, d4)
        self.tcof = (d2 + 2 * c1 * c1, 0.25 * (3 * d3 + c1 * (12 * d2 + 10 * c1 * c1)), 0.2 * (3 * d4 + 12 * c1 * d3 + 6 * d2 * d2 + 15 * c1 * c1 * (2 * d2 + c1 * c1)))
        self.deep = None
        if TURN / n >= DEEP_MINUTES:
            self.simple, self.deep = True, DeepSpace(self)

    def at(self, us: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Error codes, positions (km) and velocities (km/s) in TEME at microseconds since 1970."""
        return self.after((np.asarray(us, np.float64) - self.epoch_us) / 60e6)

    def after(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same at minutes after the epoch."""
        t = np.asarray(t, np.float64)
        if self.refused:
            return np.full(t.shape, 7), np.full((*t.shape, 3), np.nan), np.full((*t.shape, 3), np.nan)
        with np.errstate(all="ignore"):
            return self._after(t)

    def _after(self, t):
        m = self.m + self.mdot * t
        argp = self.argp + self.argpdot * t
        node = self.node + self.nodedot * t + self.nodecf * t * t
        shrink, less, along = 1 - self.c1 * t, self.bstar * self.c4 * t, self.t2cof * t * t
        if not self.simple:
            turn = self.omgcof * t + self.xmcof * ((1 + self.eta * np.cos(m)) ** 3 - self.delmo)
            m, argp = m + turn, argp - turn
            d2, d3, d4 = self.d
            k3, k4, k5 = self.tcof
            shrink = shrink - d2 * t**2 - d3 * t**3 - d4 * t**4
            less = less + self.bstar * self.c5 * (np.sin(m) - self.sinmo)
            along = along + k3 * t**3 + t**4 * (k4 + t * k5)
        n0, e, incl = self.n, self.e, self.i
        if self.deep:
            m, argp, node, de, di, n0 = self.deep.secular(t, m, argp, node)
            e, incl = e + de, incl + di
        a = (XKE / n0) ** (2 / 3) * shrink * shrink
        n = XKE / a**1.5
        e = e - less
        error = np.where((e >= 1) | (e < -0.001), 1, np.where(~(n > 0), 2, 0))
        e = np.maximum(e, 1e-6)
        m = m + self.n * along
        long = m + argp + node
        node, argp, long = np.fmod(node, TURN), np.fmod(argp, TURN), np.fmod(long, TURN)
        m = np.fmod(long - argp - node, TURN)
        con, inc2, c7, xlcof, aycof = self.con, self.inc2, self.c7, self.xlcof, self.aycof
        if self.deep:
            e, incl, argp, node, m = self.deep.periodic(t, e, incl, argp, node, m)
            over = incl < 0
            incl, node, argp = np.abs(incl), np.where(over, node + np.pi, node), np.where(over, argp - np.pi, argp)
            error = np.where((error == 0) & ((e < 0) | (e > 1)), 3, error)
            c, s = np.cos(incl), np.sin(incl)
            con, inc2, c7, xlcof, aycof = 3 * c * c - 1, 1 - c * c, 7 * c * c - 1, *_long_period(c, s)
        ax = e * np.cos(argp)
        k = 1 / (a * (1 - e * e))
        ay = e * np.sin(argp) + k * aycof
        u = np.fmod(m + argp + k * xlcof * ax, TURN)
        eo = u.copy()
        for _ in range(10):
            so, co = np.sin(eo), np.cos(eo)
            move = np.clip((u - ay * co + ax * so - eo) / (1 - co * ax - so * ay), -0.95, 0.95)
            eo = eo + move
            if np.nanmax(np.abs(move), initial=0) < 1e-12:
                break
        so, co = np.sin(eo), np.cos(eo)
        ecos, esin, el2 = ax * co + ay * so, ax * so - ay * co, ax * ax + ay * ay
        p = a * (1 - el2)
        error = np.where((error == 0) & (p < 0), 4, error)
        r = a * (1 - ecos)
        rdot, rvdot, beta = np.sqrt(a) * esin / r, np.sqrt(p) / r, np.sqrt(1 - el2)
        k = esin / (1 + beta)
        sinu, cosu = a / r * (so - ay - ax * k), a / r * (co - ax + ay * k)
        su = np.arctan2(sinu, cosu)
        sin2, cos2 = 2 * cosu * sinu, 1 - 2 * sinu * sinu
        k1 = 0.5 * J2 / p
        k2 = k1 / p
        ci, si = np.cos(incl), np.sin(incl)
        rk = r * (1 - 1.5 * k2 * beta * con) + 0.5 * k1 * inc2 * cos2
        su = su - 0.25 * k2 * c7 * sin2
        nk = node + 1.5 * k2 * ci * sin2
        ik = incl + 1.5 * k2 * ci * si * cos2
        vr = rdot - n * k1 * inc2 * sin2 / XKE
        vt = rvdot + n * k1 * (inc2 * cos2 + 1.5 * con) / XKE
        error = np.where((error == 0) & (rk < 1), 6, error)
        ss, cs, sn, cn, si, ci = np.sin(su), np.cos(su), np.sin(nk), np.cos(nk), np.sin(ik), np.cos(ik)
        mx, my = -sn * ci, cn * ci
        ux = np.stack([mx * ss + cn * cs, my * ss + sn * cs, si * ss], axis=-1)
        vx = np.stack([mx * cs - cn * ss, my * cs - sn * ss, si * cs], axis=-1)
        return error, rk[..., None] * ux * RE, (vr[..., None] * ux + vt[..., None] * vx) * (RE * XKE / 60)


@lru_cache(maxsize=256)
def orbit(line1: str, line2: str) -> Orbit:
    return Orbit(line1, line2)
