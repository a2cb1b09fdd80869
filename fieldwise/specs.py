"""Declarative descriptions of models and ordered categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Levels:
    """A category column with an explicit level order; the first is the reference."""

    name: str
    values: tuple[str, ...]

    def sort_key(self) -> Column:
        """Position of the row's level in the level order (0 when not a level)."""
        return F.array_position(F.array(*[F.lit(v) for v in self.values]), F.col(self.name))


@dataclass(frozen=True)
class Coordinate:
    """One position of the model's full effect vector."""

    kind: str  # intercept, level, numeric, pair
    names: tuple[str, ...] = ()
    levels: tuple[str, ...] = ()

    @property
    def term(self) -> str:
        if self.kind == "intercept":
            return "(Intercept)"
        if self.kind == "numeric":
            return self.names[0]
        return ":".join(f"{n}[{v}]" for n, v in zip(self.names, self.levels))


@dataclass(frozen=True)
class ModelSpec:
    """Additive categorical and numeric terms plus two-way interactions.

    Effects are kept for *every* level, reference included, so the layout of the
    effect vector is the same in every group whichever levels a group contains.
    """

    main: tuple[Levels, ...]
    interactions: tuple[tuple[str, str], ...] = ()
    numeric: tuple[str, ...] = ()

    @property
    def covariates(self) -> list[str]:
        return [m.name for m in self.main] + list(self.numeric)

    @property
    def factors(self) -> list[str]:
        return [m.name for m in self.main]

    def levels(self, name: str) -> Levels:
        return next(m for m in self.main if m.name == name)

    def coordinates(self) -> list[Coordinate]:
        out = [Coordinate("intercept")]
        for m in self.main:
            out += [Coordinate("level", (m.name,), (v,)) for v in m.values]
        out += [Coordinate("numeric", (n,)) for n in self.numeric]
        for a, b in self.interactions:
            out += [
                Coordinate("pair", (a, b), (u, v))
                for u in self.levels(a).values
                for v in self.levels(b).values
            ]
        return out

    def with_numeric(self, *names: str) -> "ModelSpec":
        return ModelSpec(self.main, self.interactions, self.numeric + names)
