"""Screen geometry: visual angle, distances and rectangles."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Screen:
    """Viewing setup in millimetres and pixels."""

    distance_mm: float = 650.0
    width_mm: float = 520.0
    width_px: int = 1920
    height_px: int = 1200

    @property
    def px_mm(self) -> float:
        """Size of a pixel."""
        return self.width_mm / self.width_px

    @property
    def px_per_degree(self) -> float:
        """Pixels in one degree of visual angle at the screen centre."""
        return self.distance_mm * math.tan(math.radians(1.0)) * self.width_px / self.width_mm


# Nominal width for lengths on the screen, data-sheet width for degrees.
NOMINAL = Screen()
MEASURED = Screen(width_mm=518.4)


def deg_to_cm(angle: Column, distance: float) -> Column:
    """Extent on the screen of a visual angle, in the unit of the distance."""
    return F.tan(angle * F.lit(math.pi) / F.lit(180.0)) * F.lit(float(distance))


def cm_to_px(extent: Column, resolution: float, size: float) -> Column:
    """Extent in pixels on a screen of that resolution and size."""
    return extent * F.lit(float(resolution)) / F.lit(float(size))


def deg_to_px(angle: Column, distance: float, resolution: float, size: float) -> Column:
    """Pixels covered by a visual angle."""
    return cm_to_px(deg_to_cm(angle, distance), resolution, size)


def cm_to_deg(extent: Column, distance: float) -> Column:
    """Visual angle of an extent: the inverse of `deg_to_cm`."""
    return F.atan(extent / F.lit(float(distance))) * F.lit(180.0) / F.lit(math.pi)


def point_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Straight distance in the plane."""
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def viewing_distance(x: Column, y: Column, distance: float) -> Column:
    """Distance from the eye to a point off the screen centre."""
    return F.sqrt(x * x + y * y + F.lit(float(distance) ** 2))


def vector_angle(first: tuple[Column, Column, Column], second: tuple[Column, Column, Column]) -> Column:
    """Angle in degrees between two vectors in space."""
    dot = sum((a * b for a, b in zip(first[1:], second[1:])), first[0] * second[0])
    norms = [F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) for v in (first, second)]
    ratio = dot / (norms[0] * norms[1])
    # rounding may lift the cosine of equal vectors just above one
    return F.acos(F.when(ratio > 1.0, 1.0).otherwise(ratio)) / F.lit(math.pi) * F.lit(180.0)


def in_bounds(x: Column, y: Column, x_bounds: tuple[float, float], y_bounds: tuple[float, float]) -> Column:
    """Point in a closed rectangle; a missing coordinate is outside."""
    inside = x.between(float(min(x_bounds)), float(max(x_bounds))) & y.between(
        float(min(y_bounds)), float(max(y_bounds))
    )
    return F.coalesce(inside, F.lit(False))
