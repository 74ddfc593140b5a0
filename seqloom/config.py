"""Settings of a run, read once on the driver and carried into plans as literals."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


def flag(text: str | None, default: bool) -> bool:
    """1, true and yes are true, case ignored; nothing keeps the default."""
    return default if text is None or not text.strip() else text.strip().lower() in ("1", "true", "yes")


def number(text: str | None, default: int) -> int:
    """The default for anything that is no whole number."""
    try:
        return int(text)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default


def real(text: str | None, default: float | None) -> float | None:
    try:
        return float(text)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default


@dataclass(frozen=True)
class MiningConfig:
    """Limits of the mining filters; from_env reads the upper-case names."""

    min_orf: int = 600
    max_orf: int = 1400
    require_start_m: bool = True
    min_cterm_tail: int = 15
    contig_boundary_margin: int = 30
    require_crispr: bool = True
    require_full_structure: bool = False
    min_repeat_count: int = 1
    crispr_flank_bp: int = 10000
    filter_motifs: bool = False
    min_motifs: int = 2
    max_motifs: int = 3
    score_threshold: float | None = 0.75
    similarity_floor: float | None = None
    similarity_ceiling: float | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> MiningConfig:
        read = {"bool": flag, "int": number, "float | None": real}
        return cls(**{f.name: read[str(f.type)](env.get(f.name.upper()), f.default) for f in fields(cls)})
