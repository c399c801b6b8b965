"""Distances on the WGS84 ellipsoid, over arrays (Vincenty 1975, inverse and direct)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from geoanswers.functions.geom import INV_F, MEAN_R
from geoanswers.functions.geom import A as MAJOR

ROUNDS, CLOSE = 50, 1e-12


def _bearing(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.degrees(np.arctan2(y, x)) % 360


def inverse(lon1, lat1, lon2, lat2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Metres, azimuth, azimuth back, and whether the series converged (not for points almost opposite each other: they get
    the sphere's answer). Equal points are 0 apart at azimuth 0."""
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(x, float)) for x in (lon1, lat1, lon2, lat2))
    f = 1 / INV_F
    u1, u2 = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    gap = (lon2 - lon1 + np.pi) % (2 * np.pi) - np.pi
    turn, moved = gap.copy(), np.full(gap.shape, np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(ROUNDS):
            sl, cl = np.sin(turn), np.cos(turn)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            arc = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * sl / ss, 0.0)
            ca2 = 1 - sa * sa
            cm = np.where(ca2 > 0, cs - 2 * s1 * s2 / ca2, 0.0)
            c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            new = gap + (1 - c) * f * sa * (arc + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
            moved = np.abs(new - turn)
            turn = new
            if not (moved > CLOSE).any():
                break
        b = MAJOR * (1 - f)
        k = ca2 * (MAJOR**2 - b**2) / b**2
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        change = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        metres = b * big * (arc - change)
        good = (moved <= CLOSE) & (np.abs(turn) <= np.pi)
        there = _bearing(c2 * np.sin(turn), c1 * s2 - s1 * c2 * np.cos(turn))
        back = _bearing(-c1 * np.sin(turn), s2 * c1 * -np.cos(turn) + s1 * c2)
        h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(gap / 2) ** 2
        sphere = 2 * MEAN_R * np.arcsin(np.sqrt(np.minimum(1.0, h)))
        there = np.where(good, there, _bearing(np.sin(gap) * np.cos(lat2), np.cos(lat1) * np.sin(lat2) - np.sin(lat1) * np.cos(lat2) * np.cos(gap)))
        back = np.where(good, back, _bearing(-np.sin(gap) * np.cos(lat1), np.cos(lat2) * np.sin(lat1) - np.sin(lat2) * np.cos(lat1) * np.cos(gap)))
    return np.where(good, metres, sphere), there, back, good


def direct(lon1, lat1, azimuth, metres) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lon, lat (degrees) and the azimuth there, this far from a position in this direction."""
    lon1, lat1, azimuth = (np.radians(np.asarray(x, float)) for x in (lon1, lat1, azimuth))
    metres, f = np.asarray(metres, float), 1 / INV_F
    b = MAJOR * (1 - f)
    u1 = np.arctan((1 - f) * np.tan(lat1))
    s1, c1, sin, cos = np.sin(u1), np.cos(u1), np.sin(azimuth), np.cos(azimuth)
    begin, sa = np.arctan2(s1, c1 * cos), c1 * sin
    ca2 = 1 - sa * sa
    k = ca2 * (MAJOR**2 - b**2) / b**2
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    arc = plain = metres / (b * big)
    for _ in range(ROUNDS):
        cm, ss, cs = np.cos(2 * begin + arc), np.sin(arc), np.cos(arc)
        change = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        arc, last = plain + change, arc
        if not (np.abs(arc - last) > CLOSE).any():
            break
    cm, ss, cs = np.cos(2 * begin + arc), np.sin(arc), np.cos(arc)
    flat = s1 * ss - c1 * cs * cos
    lat2 = np.arctan2(s1 * cs + c1 * ss * cos, (1 - f) * np.hypot(sa, flat))
    turn = np.arctan2(ss * sin, c1 * cs - s1 * ss * cos)
    c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
    lon2 = lon1 + turn - (1 - c) * f * sa * (arc + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
    return (np.degrees(lon2) + 540) % 360 - 180, np.degrees(lat2), _bearing(sa, -flat)


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """struct(distance_m, azimuth_deg, back_azimuth_deg, converged) of two positions in degrees; NULLs give NULLs."""

    def solve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        metres, there, back, good = inverse(a, b, c, d)
        known = np.isfinite(metres)
        out = {"distance_m": metres, "azimuth_deg": there, "back_azimuth_deg": back}
        return pd.DataFrame({k: pd.Series(v).where(known) for k, v in out.items()} | {"converged": good & known})

    solved = F.pandas_udf(solve, "distance_m double, azimuth_deg double, back_azimuth_deg double, converged boolean")
    return solved(lon1.cast("double"), lat1.cast("double"), lon2.cast("double"), lat2.cast("double"))
