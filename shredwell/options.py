"""What a user can set."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Options of inference, layout and load. Thresholds of 0 switch their rule off."""

    root: str = "root"
    prefix: str = "j2s_"
    text_threshold: int = 256
    array_columns: bool = False  # scalar arrays become array columns, not child tables
    wide_threshold: int = 100
    sibling_threshold: int = 3
    sibling_jaccard: float = 0.5
    stable_threshold: float = 0.10
    rare_threshold: float = 0.001
    max_columns: int = 1600
    depth_limit: int | None = None
    max_anomaly_rate: float | None = None
    schema: str = "public"
    drop_existing: bool = False
    examples: int = 5
