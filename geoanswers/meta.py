"""What a table's geometry is measured in, and the refusals that come before any job."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres in a unit.
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048}
#: Degrees of longitude beyond which one UTM zone no longer serves.
WIDEST = 6.0


class Refused(ValueError):
    """A question that can't be answered correctly as asked."""


@dataclass(frozen=True)
class LayerMeta:
    crs: str | None = None
    unit: str = "unknown"
    geographic: bool = False
    id_col: str = "id"
    label_col: str | None = None


def need_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise Refused(f"unknown column: {', '.join(missing)}")


def to_metres(value: float, unit: str) -> float:
    if unit not in UNITS:
        raise Refused(f"unknown unit: {unit}")
    return value * UNITS[unit]


def need_metric(meta: LayerMeta, what: str) -> None:
    if meta.geographic or meta.unit == "degrees":
        raise Refused(f"{what} on a layer in degrees")
    if meta.unit not in UNITS:
        raise Refused(f"{what} on a layer of unknown unit")


def need_crs(code: str | None) -> str:
    if not code or not re.fullmatch(r"[A-Za-z]+:\d+", code):
        raise Refused(f"not a CRS code: {code}")
    return code.upper()


def utm_zone(west: float, south: float, east: float, north: float) -> str | None:
    """The UTM CRS of a WGS84 box; None if it is polar, malformed or too wide."""
    box = (west, south, east, north)
    if not all(map(math.isfinite, box)) or west > east or south > north or east - west > WIDEST or south < -80 or north > 84 or west < -180 or east > 180:
        return None
    zone = min(60, int(((west + east) / 2 + 180) // 6) + 1)
    return f"EPSG:32{6 if south + north >= 0 else 7}{zone:02d}"


def utm_zone_column(west: Column, south: Column, east: Column, north: Column) -> Column:
    """``utm_zone`` of boxes given as columns; NULL where there is none."""
    sound = (west <= east) & (south <= north) & (east - west <= WIDEST) & (south >= -80) & (north <= 84) & (west >= -180) & (east <= 180)
    zone = F.least(F.lit(60), (F.floor(((west + east) / 2 + 180) / 6) + 1).cast("int"))
    code = F.concat(F.lit("EPSG:32"), F.when(south + north >= 0, "6").otherwise("7"), F.lpad(zone.cast("string"), 2, "0"))
    return F.when(sound, code)


def metric_plan(meta: LayerMeta, box: tuple[float, float, float, float] | None, length: float | None) -> tuple[str, str | None]:
    """How a length in metres applies to a layer: none, map_units, reproject (with the UTM CRS) or a refusal."""
    if length is None:
        return "none", None
    if not meta.geographic and meta.unit in UNITS:
        return "map_units", None
    zone = utm_zone(*box) if meta.geographic and box else None
    if zone is None:
        raise Refused("no metric frame for this layer")
    return "reproject", zone


def area_frame(meta: LayerMeta, box: tuple[float, float, float, float] | None) -> str:
    """The frame of an area: map_units, project (one UTM zone), ellipsoidal (too wide for one) or unsupported."""
    if not meta.geographic:
        return "map_units" if meta.unit in UNITS else "unsupported"
    if box is None:
        return "unsupported"
    return "project" if utm_zone(*box) else "ellipsoidal"
