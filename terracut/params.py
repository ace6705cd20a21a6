"""Every threshold of the plan-sheet operators, in one place. Lengths are page pixels unless a name says feet."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Elevation callouts
    min_elev: float = 800.0
    max_elev: float = 1200.0
    context_radius: float = 70.0
    same_place: float = 12.0
    same_value_ft: float = 0.05
    pad_level_count: int = 5
    outlier_ft: float = 25.0
    outlier_least: int = 5
    ocr_below: int = 8
    # Scale
    scale_reach: float = 160.0
    scale_merge: int = 12
    scale_range: tuple[float, float] = (1.0, 200.0)
    default_scale: float = 10.0
    # Associations
    max_dist: float = 48.0
    loose_dist: float = 280.0
    # Polylines
    redundant_reach: float = 10.0
    redundant_share: float = 0.45
    redundant_samples: int = 20
    # Surfaces
    grid_n: int = 120
    fused_grid_n: int = 140
    pad_share: float = 0.05
    fused_pad_share: float = 0.04
    least_points: int = 3
    fallback_drop_ft: float = 0.25
    unknown_drop_ft: float = 0.15
    tolerance_pct: float = 5.0


DEFAULTS = Params()
