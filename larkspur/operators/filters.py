"""Catalogue predicates: every function gives a boolean Column or filters a DataFrame; missing values never match unless said so."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(a, values) -> Column:
    """Arrays share a value; false, not null, where either holds a null or is null."""
    other = F.array(*map(F.lit, values)) if isinstance(values, (list, tuple)) else values
    return F.coalesce(F.arrays_overlap(a, other), F.lit(False))


def contains_all(a, values: list) -> Column:
    """Array a holds every one of the values."""
    return F.coalesce(F.forall(F.array(*map(F.lit, values)), lambda x: F.array_contains(a, x)), F.lit(False))


def date_floor(day, stated: str | None, default: str) -> Column:
    """day >= stated date, or >= default where none is stated; a date that can't be read filters nothing."""
    if stated is None:
        return F.col(day) >= F.lit(default).cast("date")
    return F.coalesce(F.col(day) >= F.try_to_date(F.lit(stated), "yyyy-MM-dd"), F.lit(True))


def in_box(lat, lng, south: float, west: float, north: float, east: float) -> Column:
    """Inclusive box; rows without a place are out."""
    return F.coalesce(F.col(lat).between(south, north) & F.col(lng).between(west, east), F.lit(False))


def in_polygon(lat, lng, ring: list[tuple[float, float]]) -> Column:
    """Ray casting over a ring of (lng, lat), closed where it isn't; 3 to 500 corners."""
    if not 3 <= len(ring) <= 500:
        raise ValueError("a polygon has 3 to 500 corners")
    corners = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners[:-1], corners[1:], strict=True):
        if y1 != y2:
            at = F.lit(x1) + (F.col(lat) - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when(((F.col(lat) < y1) != (F.col(lat) < y2)) & (F.col(lng) < at), 1).otherwise(0)
    return F.coalesce(crossings % 2 == 1, F.lit(False))


def three_valued(stated, wanted: list, umbrella: list, guessed) -> Column:
    """match / possible / no: nothing wanted matches; nothing stated or only guessed may; stated lists decide, umbrellas may."""
    if not wanted:
        return F.lit("match")
    return (
        F.when(F.coalesce(F.size(stated), F.lit(0)) <= 0, "possible").when(guessed, "possible")
        .when(overlaps(stated, wanted), "match").when(overlaps(stated, umbrella) if umbrella else F.lit(False), "possible").otherwise("no")
    )


def missing_fields(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))


def at_least(level, order: list[str], least: str) -> Column:
    """Position of a level in an ascending order is that of `least` or above; unknown levels are lowest."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(level)), F.lit(0))
    return place >= order.index(least) + 1


@dataclass
class Spec:
    """What a catalogue query asks for; empty fields ask for nothing."""

    regions: list[str] = field(default_factory=list)
    segments: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    date_from: str | None = None
    low: float | None = None
    high: float | None = None
    name_like: str | None = None


def catalogue(facts: DataFrame, dims: DataFrame, on: str, spec: Spec, today: str) -> DataFrame:
    """The catalogue query: facts joined with their dimension, all predicates in one plan, so they reach the scans."""
    out = facts.join(dims, on)
    if spec.regions:
        out = out.where(F.col("region").isin(spec.regions))
    if spec.segments:
        out = out.where(F.col("segment").isin(spec.segments))
    if spec.statuses:
        out = out.where(F.col("status").isin(spec.statuses))
    out = out.where(date_floor("day", spec.date_from, today))
    if spec.low is not None or spec.high is not None:
        out = out.where(F.col("amount").between(spec.low if spec.low is not None else -1e300, spec.high if spec.high is not None else 1e300))
    if spec.name_like is not None:
        out = out.where(F.col("name").ilike(f"%{spec.name_like.replace('%', '').replace('_', '')}%"))
    return out
