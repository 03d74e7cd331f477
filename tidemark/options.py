"""Constants of the interval and text operators, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Times in seconds, probabilities in 0..1."""

    #: shorter pieces vanish when intervals are clamped
    shortest: float = 0.05
    #: cuts that are nearer are one cut
    merge_gap: float = 2.0
    #: label segments that are nearer are one block
    block_gap: float = 3.0
    #: runs of one rule that are nearer are one run
    bridge_gap: float = 90.0
    pad_before: float = 0.25
    pad_after: float = 0.25
    min_keep: float = 1.0
    anchor_threshold: float = 0.85
    weak_lead: float = 0.5
    localize_threshold: float = 0.95
    window_target: float = 30.0
    window_max: float = 45.0
    rolling_gap: float = 1.0
    sentence_min_bytes: int = 40
    min_region: float = 8.0
    min_localized_region: float = 3.0
    end_first: int = 11
    end_step: float = 0.3
    end_never: float = 0.3
    extend_while: float = 0.6
    start_reach: float = 75.0
    start_inside: float = 0.5
    #: a step of a localized run's start curve that may take its start earlier
    localized_min_step: float = 0.3
    outro_from: float = 0.9
    tail_min: float = 5.0
    snap_reach: float = 1.0
    candidate_cap: int = 100
    batch: int = 24
    worst_cut: float = 5.0


DEFAULTS = Options()
