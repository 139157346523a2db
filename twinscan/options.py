"""Options of an analysis, validated once."""

from __future__ import annotations

from dataclasses import dataclass, field

# Mode names, file extensions and folders left out by default; the defaults of the options below likewise.
MODES = ("functions", "types", "classes", "overlap")
EXTENSIONS = ("ts", "tsx", "mts", "cts")
EXCLUDES = ("node_modules/**", "dist/**", "coverage/**")


@dataclass(frozen=True)
class Options:
    modes: tuple[str, ...] = MODES
    threshold: float = 0.8
    min_lines: int = 3
    min_tokens: int | None = None  # replaces the line gate when set
    size_penalty: bool = True
    same_file_only: bool = False
    cross_file_only: bool = False
    extensions: tuple[str, ...] = EXTENSIONS
    exclude: tuple[str, ...] = field(default_factory=tuple)
    types_only: str = "all"  # all, interface or type
    allow_cross_kind: bool = True
    type_literals: bool = False
    overlap_min_window: int = 8
    overlap_max_window: int = 30
    overlap_size_tolerance: float = 0.2

    def __post_init__(self) -> None:
        unknown = [m for m in self.modes if m not in MODES]
        if unknown:
            raise ValueError(f"unknown modes: {', '.join(unknown)}")
        if not self.modes:
            raise ValueError("at least one mode is needed")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must lie between 0 and 1")
        if self.min_lines < 1 or self.min_tokens is not None and self.min_tokens < 1:
            raise ValueError("least sizes must be at least 1")
        if self.same_file_only and self.cross_file_only:
            raise ValueError("same_file_only and cross_file_only exclude each other")
        if self.types_only not in ("all", "interface", "type"):
            raise ValueError("types_only must be all, interface or type")
        if not 1 <= self.overlap_min_window <= self.overlap_max_window:
            raise ValueError("overlap windows must satisfy 1 <= min <= max")
        if not 0 <= self.overlap_size_tolerance <= 1:
            raise ValueError("overlap_size_tolerance must lie between 0 and 1")
        object.__setattr__(self, "modes", tuple(m for m in MODES if m in self.modes))
        object.__setattr__(self, "extensions", tuple(dict.fromkeys(e.lstrip(".").lower() for e in self.extensions)))

    @property
    def scope(self) -> str:
        return "same_file" if self.same_file_only else "cross_file" if self.cross_file_only else "all"
