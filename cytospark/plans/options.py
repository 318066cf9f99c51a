"""Options of the analyses."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.reads import STRANDS
from ..operators.filters import ReadFilter


def parse_bounds(text: str) -> tuple[int, int, int, int]:
    """Four whole numbers, parted by commas."""
    parts = text.split(",")
    if len(parts) != 4 or not all(p.isascii() and p.isdigit() for p in parts):
        raise ValueError(f"expected four whole numbers, not {text}")
    a, b, c, d = map(int, parts)
    return a, b, c, d


@dataclass(frozen=True)
class Trimming:
    """Inclusive 1-based bounds and fixed numbers of bases at the ends, by strand: read 1 left, right, read 2 left, right."""

    inclusion: dict[str, tuple[int, int, int, int]] = field(default_factory=dict)
    fixed: dict[str, tuple[int, int, int, int]] = field(default_factory=dict)

    def __post_init__(self):
        for strand, (a, b, c, d) in self.inclusion.items():
            if (b and a > b) or (d and c > d):
                raise ValueError(f"{strand}: a bound's start lies behind its end")
        if unknown := {*self.inclusion, *self.fixed} - {*STRANDS}:
            raise ValueError(f"unknown strand {sorted(unknown)[0]}")


@dataclass(frozen=True)
class PileupOptions:
    reads: ReadFilter = ReadFilter()
    minimum_base_quality: int = 5
    minimum_conversion_efficiency: float = 0.0
    contexts: tuple[str, ...] = ("CG",)
    trimming: Trimming = Trimming()
    region: str | None = None
    keep_bed_strand: bool = False

    def __post_init__(self):
        if not self.contexts:
            raise ValueError("no context is enabled")
        if self.minimum_base_quality < 1:
            raise ValueError("the minimum base quality must be positive")
        if not 0 <= self.minimum_conversion_efficiency <= 1:
            raise ValueError("the minimum conversion efficiency must lie within 0 and 1")


@dataclass(frozen=True)
class ExtractOptions(PileupOptions):
    minimum_depth: int = 1
    minimum_opposite_depth: int = 0
    maximum_variant_fraction: float = 0.0
    #: Whether mates may overlap; single reads only need less work.
    paired: bool = True
    #: Reads in a cell beyond which it is split over tasks; None: reads aren't counted by cell for that.
    deep: int | None = None

    def __post_init__(self):
        super().__post_init__()
        if self.deep is not None and self.deep < 1:
            raise ValueError("a cell can't be split below one piece")
        if not 0 <= self.maximum_variant_fraction <= 1:
            raise ValueError("the maximum variant fraction must lie within 0 and 1")
