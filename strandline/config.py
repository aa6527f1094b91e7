"""Thresholds of the detection engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConf:
    min_mapq: int = 10
    min_span: int = 50
    max_span: int = 200_000
    linear_range: int = 50_000
    #: 0, 1 or 2: how strict the result filter is.
    stringency: int = 0
    #: Largest difference of clip lengths, and of a site from its candidate.
    clip_slack: int = 6
    site_slack: int = 6
    #: Largest shift of one site when the clips do not meet.
    max_shift: int = 4
    #: span: any read over a site; strong: with an anchor on both sides; direct: only by matched blocks.
    linear_mode: str = "span"
    #: Bases on either side for strong and direct evidence.
    anchor: int = 19
    #: Adds direct evidence to the others, with this anchor; none if null.
    rescue_anchor: int | None = None
    #: Also count sites strictly between the end buckets of a long alignment.
    full_span: bool = False
    #: primary, supplementary, filtered or relaxed: which alignments may show outward pairs.
    outward_mode: str = "relaxed"
    #: Judge a group that has only records of the first mate, too.
    judge_first_mate_alone: bool = False
    max_segment_span: int = 200_000
    min_outward_offset: int = 19

    def __post_init__(self) -> None:
        if self.linear_mode not in ("span", "strong", "direct"):
            raise ValueError(f"linear_mode {self.linear_mode!r}")
        if not 0 < self.min_span <= self.max_span:
            raise ValueError("spans")
