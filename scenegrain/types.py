"""Vocabulary, schemas and thresholds of the scene model."""

from __future__ import annotations

from dataclasses import dataclass


# Predicate names in emission order, with the ids that annotation files use.
PREDICATE_IDS = {
    "on": 10,
    "under": 17,
    "to the left of": 15,
    "to the right of": 16,
    "in front of": 6,
    "behind": 2,
    "near": 9,
}
PREDICATES = tuple(PREDICATE_IDS)
# Object labels with their ids.
LABEL_IDS = {"book": 1, "bottle": 2, "box": 3, "cube": 4, "human": 5, "remote": 6}
INVERSE = {"on": "under", "under": "on", "to the left of": "to the right of", "to the right of": "to the left of", "in front of": "behind", "behind": "in front of", "near": "near"}
TRAIN_GROUPS = (0, 1, 2, 3, 4, 5)
HELD_OUT_GROUPS = (6, 7, 8)


@dataclass(frozen=True)
class Thresholds:
    """What the seven rules compare with. The default is the profile that is shipped."""

    # Names as in configuration files, and the numbers of the shipped profile.
    near_T: float = 1.372
    on_vertical_gap: float = 0.05
    on_horizontal_overlap: float = 0.20
    on_depth_eps: float = 0.06
    on_contact_min: float = 0.85
    lateral_center_eps: float = 0.02
    depth_eps: float = 0.03
    plane_band: float = 0.005
    flag_near_band: float = 0.15
    no_support_classes: tuple[str, ...] = ("human",)

    @classmethod
    def profile(cls, name: str = "shipped") -> Thresholds:
        """shipped, or test: the profile of the worked examples, with less contact for support."""
        return cls() if name == "shipped" else cls(on_contact_min=0.60)

    @classmethod
    def from_config(cls, config: dict) -> Thresholds:
        """From a nested configuration; what is absent has its default, on_contact_min then 0.60."""
        p, c = config.get("predicates", {}), config.get("confidence", {})
        plain = {k: float(p[k]) for k in ("near_T", "on_vertical_gap", "on_horizontal_overlap", "on_depth_eps", "lateral_center_eps", "depth_eps", "plane_band") if k in p}
        return cls(**plain, on_contact_min=float(p.get("on_contact_min", 0.60)), flag_near_band=float(c.get("flag_near_band", 0.15)), no_support_classes=tuple(p.get("no_support_classes", ("human",))))


# Declared, never inferred: what files hold.
ANNOTATION = "width INT, height INT, boxes_1024 ARRAY<ARRAY<INT>>, boxes_512 ARRAY<ARRAY<INT>>, attribute ARRAY<ARRAY<INT>>, labels ARRAY<INT>, relationships ARRAY<ARRAY<INT>>, predicates ARRAY<INT>"
PAIRS_CSV = "image_id STRING, subj INT, obj INT, near_metric DOUBLE, dist3d DOUBLE, gold_near INT, gold_any INT, gold_contact INT, pred STRING, gold STRING"
FRAMES = "frame INT, time DOUBLE, tracks MAP<STRING,INT>, detections ARRAY<STRUCT<label STRING, score DOUBLE, box_px ARRAY<DOUBLE>>>, triplets_raw ARRAY<ARRAY<STRING>>, triplets_smoothed ARRAY<ARRAY<STRING>>, triplets_named ARRAY<STRING>"
DETECTION = "box_px ARRAY<DOUBLE>, label STRING, score DOUBLE"
REPLIES = "image_id STRING, model STRING, relations ARRAY<ARRAY<STRING>>, problems ARRAY<STRING>, reply STRING"
