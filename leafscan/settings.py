"""The thresholds that the operators take by default, as one value."""

from __future__ import annotations

from dataclasses import dataclass

from .operators import decode, evaluate, layout, mask


@dataclass(frozen=True)
class Thresholds:
    """Pass a field to the operator that has a parameter for it; the defaults are the operators' own."""

    assign: float = layout.ASSIGN
    mask_density: float = mask.DENSITY
    binary: float = mask.BINARY
    prediction_score: float = evaluate.SCORE
    beams: int = decode.BEAMS
    max_length: int = decode.MAX_LENGTH
    ngram: int = decode.NGRAM
