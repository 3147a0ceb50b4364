"""The boundary to models: a detector's contract, masks in closed form, contact and depth on arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@runtime_checkable
class Detector(Protocol):
    """Anything that finds boxes: detect(rgb) gives dictionaries with box_px, label and score."""

    def detect(self, rgb: np.ndarray) -> list[dict]: ...


KINDS: dict[str, Callable[[dict], Detector]] = {}


def register(kind: str, make: Callable[[dict], Detector]) -> None:
    KINDS[kind] = make


# What older configuration files call detectors and their settings, and the kind of files that name none.
BACKENDS = {"yolov10m": "yolo", "yolov8m": "yolo", "groundingdino": "grounding_dino"}
RENAMED = {"conf_threshold": "threshold"}
UNUSED = {"iou_nms"}
DEFAULT_KIND = "grounding_dino"


def detector_from(config: dict) -> Detector:
    """A registered detector by its kind, made from the `detector` block of a configuration, or from the block itself.

    Where `kind` is absent `type` is read, then `backend` in its older spelling. Settings have their present
    names and come without the kind. An unknown kind is an error.
    """
    block = dict(config.get("detector") or config)
    named = [block.pop("kind", None), block.pop("type", None), BACKENDS.get(block.pop("backend", None))]
    kind = next(filter(None, named), DEFAULT_KIND)
    if kind not in KINDS:
        raise ValueError(f"unknown detector {kind!r}; known: {', '.join(sorted(KINDS)) or 'none'}")
    return KINDS[kind]({RENAMED.get(k, k): v for k, v in block.items() if k not in UNUSED})


DETECTIONS = "path string, det int, label string, score double, x1 double, y1 double, x2 double, y2 double"


def detect(images: DataFrame, make: Callable[[], Detector], decode: Callable[[bytes], np.ndarray], labels: dict[str, str] | None = None) -> DataFrame:
    """Runs a detector over binary images (path, content): one model per task, labels renamed, boxes clipped.

    Labels that the renaming doesn't know are dropped, where one is given.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rgb = decode(content)
                h, w = rgb.shape[:2]
                for i, d in enumerate(model.detect(rgb)):
                    label = d["label"] if labels is None else labels.get(d["label"])
                    if label is not None:
                        x1, y1, x2, y2 = d["box_px"]
                        clip = lambda v, most: float(min(max(v, 0), most))
                        rows.append((path, i, label, round(float(d.get("score", 1.0)), 4), clip(x1, w), clip(y1, h), clip(x2, w), clip(y2, h)))
            yield pd.DataFrame(rows, columns=["path", "det", "label", "score", "x1", "y1", "x2", "y2"])

    return images.select("path", "content").mapInPandas(run, DETECTIONS)


def rect_mask(box, height: int, width: int) -> np.ndarray:
    """A box (shares of the image) filled in, its sides rounded half to even."""
    x1, y1, x2, y2 = (int(np.rint(v)) for v in (box[0] * width, box[1] * height, box[2] * width, box[3] * height))
    out = np.zeros((height, width), bool)
    out[y1:y2, x1:x2] = True
    return out


def nearness_to_depth(raw: np.ndarray) -> np.ndarray:
    """Inverted and scaled to 0..1, so that small is near; a constant map is only inverted."""
    d = raw.max() - raw.astype(float)
    return (d - d.min()) / (d.max() - d.min()) if d.max() > d.min() else d


def best_mask(masks: np.ndarray, scores: np.ndarray) -> np.ndarray:
    return masks[int(np.argmax(scores))]


def bottom_contact(a: np.ndarray, b: np.ndarray, band: int = 5) -> float:
    """Share of a's columns whose lowest pixel has b within `band` rows below it."""
    columns = np.flatnonzero(a.any(0))
    if not len(columns):
        return 0.0
    rows = a.shape[0] - 1 - np.argmax(a[::-1, columns], 0)
    below = np.minimum(rows[:, None] + np.arange(1, band + 1), a.shape[0] - 1)
    return float(b[below, columns[:, None]].any(1).mean())


def pair_contacts(masks: list[np.ndarray], least: float = 0.05) -> dict[tuple[int, int], float]:
    """Contact of every ordered pair from `least` up, judged before it is rounded to four places."""
    found = {(i, j): bottom_contact(a, b) for i, a in enumerate(masks) for j, b in enumerate(masks) if i != j}
    return {k: round(v, 4) for k, v in found.items() if v >= least}


def lift(mask: np.ndarray, depth: np.ndarray, box, z_scale: float = 1.0) -> tuple[float, float, float, tuple[float, float, float]]:
    """Centre (shares of the image), median depth and position of a mask; an empty one is its box, of a pixel at least."""
    h, w = mask.shape
    if not mask.any():
        x1, y1, x2, y2 = box
        mask = np.zeros_like(mask)
        mask[int(y1 * h) : max(int(y2 * h), int(y1 * h) + 1), int(x1 * w) : max(int(x2 * w), int(x1 * w) + 1)] = True
    if not mask.any():
        return 0.5, 0.5, float(np.median(depth)), (0.5, 0.5, float(np.median(depth)) * z_scale)
    ys, xs = np.nonzero(mask)
    cx, cy, z = float(xs.mean() / w), float(ys.mean() / h), float(np.median(depth[mask]))
    return cx, cy, z, (cx, cy, z * z_scale)


def thumbnail(image: np.ndarray, width: int = 64, height: int = 48) -> np.ndarray:
    """A grey signature: channels averaged, rows and columns sampled at even steps, the mean taken off."""
    grey = image.mean(2) if image.ndim == 3 else image
    rows, cols = (np.linspace(0, n - 1, k).astype(int) for n, k in zip(grey.shape, (height, width), strict=True))
    small = grey[rows][:, cols].astype(np.float32)
    return small - small.mean()
