"""The lattice that travels beside a DataFrame of cells."""

from __future__ import annotations

from dataclasses import dataclass

AXES = ("x", "y", "z")
PERIODIC, NEUMANN, DIRICHLET = "periodic", "neumann", "dirichlet"


@dataclass(frozen=True)
class Grid:
    """Cells per axis, side lengths and boundary conditions; spacing is L / N."""

    dims: tuple[int, ...]
    length: tuple[float, ...] | float = 1.0
    bcs: tuple[str, ...] | str = PERIODIC

    @property
    def axes(self) -> tuple[str, ...]:
        return AXES[: len(self.dims)]

    def side(self, axis: int) -> float:
        return float(self.length[axis] if isinstance(self.length, (tuple, list)) else self.length)

    def bc(self, axis: int) -> str:
        return self.bcs if isinstance(self.bcs, str) else self.bcs[axis]

    def spacing(self, axis: int) -> float:
        return self.side(axis) / self.dims[axis]

    @property
    def cells(self) -> int:
        n = 1
        for d in self.dims:
            n *= d
        return n
