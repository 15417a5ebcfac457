"""Run options: defaults, deep merge, coercion."""

from __future__ import annotations

import math
import os
from collections.abc import Callable

from spanloom.functions import scoring
from spanloom.operators import camera

#: Fixed values.
DEFAULTS = {
    "clips": {"min_duration": 20.0, "max_duration": 90.0, "target_count": 12, "ideal_duration": 45.0, "block_seconds": 420.0, "block_overlap_seconds": 45.0, "max_candidates": 60, "iou": 0.4, "merge_ceiling": 0.75, "lambda": 0.7, "min_gap": 5.0},
    "weights": dict(scoring.CATEGORY_MAX),
    "backend": {"name": "offline", "url": "", "model": ""},
    "reframe": {"formats": ["9:16"], "layout": "crop"},
    "watermark": {"enabled": False, "path": "", "opacity": 0.85, "scale": 0.18, "margin": 0.04, "position": "top_right"},
    "tightening": {"enabled": False, "remove_fillers": True, "min_gap": 0.6, "keep_pause": 0.35},
    "thumbnail": {"enabled": False, "text_color": "#FFFFFF", "outline_color": "#000000", "uppercase": True},
    "music": {"enabled": False, "path": "", "volume": 0.15, "fade_seconds": 0.6},
}
#: The least and the most of each number, and what texts with a choice may be.
BOUNDS = {
    "watermark": {"opacity": (0.05, 1.0), "scale": (0.02, 0.9), "margin": (0.0, 0.4)},
    "tightening": {"min_gap": (0.15, 5.0), "keep_pause": (0.0, 3.0)},
    "music": {"volume": (0.0, 1.0), "fade_seconds": (0.0, 2.0)},
}
CHOICES = {("watermark", "position"): ("top_left", "top_right", "bottom_left", "bottom_right", "center"), ("reframe", "layout"): ("crop", "fit_blur")}


def merged(base: dict, over: dict) -> dict:
    """base with over laid on it, level by level; the right wins."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def number(value, default: float, low: float, high: float) -> float:
    """value within its bounds; the default where it is no number."""
    try:
        v = float(value)
    except (TypeError, ValueError):
        return default
    return default if math.isnan(v) else min(high, max(low, v))


def load(over: dict | None = None) -> dict:
    """Options with numbers coerced and clamped; unknown weights, formats and choices give way to the defaults."""
    c = merged(DEFAULTS, over or {})
    k = c["clips"]
    k["min_duration"] = max(1.0, float(k["min_duration"]))
    k["max_duration"] = max(k["min_duration"], float(k["max_duration"]))
    k["target_count"] = max(1, int(k["target_count"]))
    k["lambda"] = min(1.0, max(0.0, float(k["lambda"])))
    c["weights"] = {w: number(c["weights"].get(w), cap, 0.0, math.inf) for w, cap in scoring.CATEGORY_MAX.items()}
    for section, bounds in BOUNDS.items():
        c[section] |= {name: number(c[section][name], DEFAULTS[section][name], *b) for name, b in bounds.items()}
    for (section, name), allowed in CHOICES.items():
        if c[section][name] not in allowed:
            c[section][name] = DEFAULTS[section][name]
    t, f = c["tightening"], c["reframe"]["formats"]
    if t["keep_pause"] >= t["min_gap"]:  # a pause kept whole would never be cut
        t["keep_pause"] = max(0.0, t["min_gap"] - 0.1)
    known = dict.fromkeys(str(x).strip() for x in (f if isinstance(f, list) else [f]))
    c["reframe"]["formats"] = [x for x in known if x in camera.FORMATS] or list(DEFAULTS["reframe"]["formats"])
    return c


def usable(options: dict, section: str, exists: Callable[[str], bool] = os.path.isfile) -> dict | None:
    """A section of loaded options if it is switched on and the file it names, if it names one, is there; else None.

    `exists` tells that of a path; give another for paths in a store.
    """
    o = {k: v for k, v in options[section].items() if k != "enabled"}
    if not options[section].get("enabled"):
        return None
    if "path" in o:
        o["path"] = str(o["path"] or "").strip()
        if not o["path"] or not exists(o["path"]):
            return None
    return o
