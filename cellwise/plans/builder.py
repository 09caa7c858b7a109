"""Fluent builders: ``Hist.reg(100, 0, 1).reg(10, 0, 5).weight().fill(df, "x", "y", weight="w")``."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame

from ..functions.axis import Axis
from ..operators import hist, profile

KINDS = ("double", "float", "int64", "int32", "int16", "int8")


@dataclass(frozen=True)
class Builder:
    """Axes and options of a histogram that is yet to be filled."""

    axes: tuple[Axis, ...] = ()
    kind: str = "double"
    tracked: bool = False
    is_profile: bool = False
    key: str = ""
    heading: str = ""

    def _with(self, axis: Axis) -> Builder:
        if len(self.axes) == 3:
            raise ValueError("a histogram has at most three axes")
        return replace(self, axes=(*self.axes, axis))

    def reg(self, n: int, lo: float, hi: float) -> Builder:
        return self._with(Axis.reg(n, lo, hi))

    def var(self, edges: list[float]) -> Builder:
        return self._with(Axis.var(edges))

    def labels(self, names: list[str]) -> Builder:
        return self._with(Axis.labelled(names))

    def name(self, key: str) -> Builder:
        return replace(self, key=key)

    def title(self, heading: str) -> Builder:
        return replace(self, heading=heading)

    def label(self, text: str) -> Builder:
        """The title of the axis added last."""
        return replace(self, axes=(*self.axes[:-1], replace(self.axes[-1], title=text)))

    def storage(self, kind: str) -> Builder:
        if kind not in KINDS:
            raise ValueError(f"storage is one of {KINDS}")
        return replace(self, kind=kind)

    def weight(self) -> Builder:
        return replace(self, tracked=True)

    def profile(self) -> Builder:
        return replace(self, is_profile=True)

    def fill(self, df: DataFrame, *coords: Column | str, weight: Column | str | None = None, by: tuple[str, ...] = ()):
        """A histogram of the coordinates; for a profile the last one is the value."""
        if len(coords) != len(self.axes) + self.is_profile:
            raise ValueError("one coordinate for each axis, and a value for a profile")
        if self.is_profile:
            return profile.profile(df, list(self.axes), list(coords[:-1]), coords[-1], weight, by, track=self.tracked)
        return hist.fill(df, list(self.axes), list(coords), weight, by, self.tracked, self.key).stored_as(self.kind)


class Hist:
    """Where a builder begins."""

    @staticmethod
    def reg(n: int, lo: float, hi: float) -> Builder:
        return Builder().reg(n, lo, hi)

    @staticmethod
    def var(edges: list[float]) -> Builder:
        return Builder().var(edges)

    @staticmethod
    def labels(names: list[str]) -> Builder:
        return Builder().labels(names)
