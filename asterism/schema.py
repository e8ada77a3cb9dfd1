"""The data model: signed coordinates on eight fixed dimensions (banks), weighted labels (anchors), typed edges."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the data model.
BANKS = ("ARCHITECTURE", "CAPABILITY", "EFFICIENCY", "COMPATIBILITY", "LINEAGE", "DOMAIN", "QUALITY", "TRAINING")
LINEAGE_RELATIONS = ("fine_tuned_from", "quantized_from", "merged_from")
MISSING_BANK, OPPOSED_BANK, AVOID_DECAY, CONTEXT_BOOST, EPA_HALF_LIFE = 0.3, 0.05, 0.5, 0.5, 0.6
STANDARD_SHARE, SUBMODULAR_DECAY, TIE_GAP, TIE_LIMIT = 0.40, 0.7, 0.05, 20

TABLES = {
    "models": "model_id string, author string, source string, display_name string",
    "positions": "model_id string, bank string, path_sign int, path_depth int",
    "anchors": "anchor_id string, label string, bank string, category string",
    "model_anchors": "model_id string, anchor_id string, label string, bank string, confidence double",
    "links": "source_id string, target_id string, relation string, weight bigint",
    "metadata": "model_id string, key string, value string, value_type string",
}


@dataclass(frozen=True)
class Query:
    """A navigational query: directions by bank (-1, 0, 1), label sets, depth limits and ranking options."""

    directions: dict[str, int] = field(default_factory=dict)
    require: tuple[str, ...] = ()
    prefer: tuple[str, ...] = ()
    avoid: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    similar_to: str | None = None
    min_depth: dict[str, int] = field(default_factory=dict)
    max_depth: dict[str, int] = field(default_factory=dict)
    bank_weights: dict[str, float] | None = None
    vibe: tuple[float | None, float | None, float | None] = (None, None, None)
    mode: str = "auto"
    limit: int = 20
