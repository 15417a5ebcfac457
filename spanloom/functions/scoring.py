"""Column functions that score clips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SCORE_KEYS = ("hook", "payoff", "emotion", "curiosity", "standalone", "editability")
CATEGORY_MAX = {"hook": 25.0, "payoff": 25.0, "emotion": 15.0, "curiosity": 15.0, "standalone": 10.0, "editability": 10.0}
VIRALITY_SHARE = {"hook": 0.30, "payoff": 0.20, "emotion": 0.28, "curiosity": 0.22}
VIRALITY_BONUS = {"controversial": 12.0, "confrontation": 12.0, "reveal": 8.0, "surprising": 8.0, "emotional": 5.0, "funny": 4.0}
ENGAGEMENT = {"views": 1.0, "likes": 3.0, "comments": 5.0, "shares": 8.0}
CLIP_TYPES = ("funny", "educational", "story", "emotional", "controversial", "surprising", "practical_advice", "opinion", "reveal", "confrontation", "inspirational", "other")
TYPE_ALIASES = {
    "humor": "funny", "humour": "funny", "comedy": "funny", "joke": "funny", "drole": "funny", "education": "educational", "educative": "educational",
    "informative": "educational", "tip": "practical_advice", "tips": "practical_advice", "advice": "practical_advice", "conseil": "practical_advice",
    "controversial_opinion": "controversial", "hot_take": "controversial", "debate": "confrontation", "argument": "confrontation", "clash": "confrontation",
    "personal_story": "story", "anecdote": "story", "histoire": "story", "emotion": "emotional", "inspiring": "inspirational", "motivation": "inspirational",
    "surprise": "surprising", "shocking": "surprising", "twist": "reveal", "revelation": "reveal", "insight": "educational",
}


def overall(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Category values, clipped to their caps, rescaled to the weights, out of 100; not rounded."""
    weights = weights or CATEGORY_MAX
    total = F.lit(0.0)
    for k, cap in CATEGORY_MAX.items():
        total = total + F.least(F.lit(cap), F.greatest(F.lit(0.0), scores[k])) / cap * float(weights.get(k, cap))
    return total * 100.0 / (sum(weights.values()) or 100.0)


def blend(llm: Column, heuristic: Column, share: float) -> Column:
    share = max(0.0, min(1.0, share))
    return llm * (1.0 - share) + heuristic * share


def virality(scores: dict[str, Column], clip_type: Column) -> Column:
    """Weighted shares of the caps plus a bonus by type, 100 at most; not rounded."""
    base = F.lit(0.0)
    for k, share in VIRALITY_SHARE.items():
        base = base + scores[k] / CATEGORY_MAX[k] * 100 * share
    bonus = F.lit(0.0)
    for t, b in VIRALITY_BONUS.items():
        bonus = F.when(clip_type == t, b).otherwise(bonus)
    return F.least(F.lit(100.0), base + bonus)


def normalise_type(value: Column) -> Column:
    """A known type, else the type of the first alias that the value contains, else other."""
    t = F.translate(F.lower(F.trim(F.coalesce(F.when(value != "", value), F.lit("other")))), " -", "__")
    out = F.lit("other")
    for alias, of in reversed(TYPE_ALIASES.items()):
        out = F.when(t.contains(alias), F.lit(of)).otherwise(out)
    return F.when(t.isin(list(CLIP_TYPES)), t).otherwise(out)


def engagement(row: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for k, w in ENGAGEMENT.items():
        total = total + F.coalesce(row[k].cast("double"), F.lit(0.0)) * w
    return total


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over hull of two intervals, 0 if they do not overlap."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / hull).otherwise(F.lit(0.0))


def padding(start: Column, end: Column, pause_before: Column, pause_after: Column, lead: float = 0.25, tail: float = 0.40) -> Column:
    """Struct of start and end, moved outwards into the pauses: by 0.6 of each at most, never before zero."""
    first = F.greatest(F.lit(0.0), start - F.least(F.lit(lead), 0.6 * pause_before))
    last = end + F.least(F.lit(tail), 0.6 * F.greatest(F.lit(0.0), pause_after))
    return F.struct(first.alias("start"), last.alias("end"))
