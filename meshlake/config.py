"""Parameters of the engine. They must be as here for the results to agree with the data's origin."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    accuracy: int = 4  # decimals of a coordinate; one grid unit is 10**-accuracy
    normal_angle: float = 25.0  # degrees between normals, at most, of a contact
    snap_gap: float = 0.01  # of the shorter edge: a smaller gap is none
    most_gap: float = 0.5  # of the shorter edge: a larger gap is no contact
    overlap: float = 0.01  # of a triangle's area: least overlap of a contact
    shape_grades: tuple[float, ...] = (12, 50, 400, 1000)
    error_grades: tuple[float, ...] = (0.1, 1, 2, 10)
    cover_thresholds: dict[int, float] = field(default_factory=lambda: {4: 0.10, 3: 0.03})
    cover_threshold: float = 0.01
    min_loop_area: float = 10_000.0
    close_points: float = 50.0


DEFAULT = Config()
