"""The container that analysis steps read and extend: configuration plus named DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from contactmill.genome import Genome
from contactmill.sources.tables import check_grouping


@dataclass(frozen=True)
class Study:
    """Immutable; each step returns a new one. No table is held on the driver."""

    genome: Genome
    resolutions: tuple[int, ...]
    cells: DataFrame
    contacts: DataFrame | None = None
    pixels: dict[int, DataFrame] = field(default_factory=dict)
    views: dict[int, DataFrame] = field(default_factory=dict)
    insulation: dict[int, DataFrame] = field(default_factory=dict)
    metacells: DataFrame | None = None
    maps: dict[tuple[str, int], DataFrame] = field(default_factory=dict)
    weights: dict[int, DataFrame] = field(default_factory=dict)
    notes: dict[str, Any] = field(default_factory=dict)

    def having(self, **changes: Any) -> Study:
        return replace(self, **changes)

    @property
    def n_cells(self) -> int:
        return self.cells.count()

    @property
    def n_metacells(self) -> int:
        return 0 if self.metacells is None else self.metacells.count()


def study_from_tables(
    cells: DataFrame, views: dict[int, DataFrame], genome: Genome, resolutions: list[int]
) -> Study:
    """Import an external grouping: cells with labels and metacells, and at least one view."""
    check_grouping(cells, views)
    if not resolutions:
        raise ValueError("resolutions must not be empty")
    return Study(genome, tuple(sorted(resolutions)), cells, views=dict(views))
