"""Scores, weights and severities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUS_WEIGHTS = {"EXTRACTED": 1.0, "INFERRED": 0.6, "TAG": 0.3}
SEVERITIES = {"CRITICAL": 1.0, "HIGH": 0.7, "MEDIUM": 0.4, "LOW": 0.1}
#: Colours of communities, of note types, of other nodes and of a root (fixed values).
PALETTE = "#6366f1 #ec4899 #14b8a6 #f59e0b #8b5cf6 #06b6d4 #10b981 #f43f5e #3b82f6 #84cc16 #d946ef #eab308".split()
TYPE_COLORS = {"decision": "#f43f5e", "adr": "#f43f5e", "concept": "#3b82f6", "guide": "#10b981", "howto": "#10b981", "tutorial": "#10b981", "reference": "#a855f7", "doc": "#a855f7", "docs": "#a855f7", "synthesis": "#ec4899", "compiled": "#ec4899", "hub": "#eab308", "god_node": "#eab308"}
NEUTRAL, ROOT = "#64748b", "#f59e0b"
#: Parts of a node's name that tell its type, the first that is found (fixed values).
NOTE_TYPES = {"decision": "decision", "adr": "decision", "concept": "concept", "guide": "guide", "howto": "guide", "tutorial": "guide", "synthes": "synthesis", "compiled": "synthesis", "reference": "reference", "doc": "reference"}


def edge_weight(weight="weight", status="status") -> Column:
    out = F.when(F.col(weight) > 0, F.col(weight))
    for s, w in STATUS_WEIGHTS.items():
        out = out.when(F.col(status) == s, F.lit(w))
    return out.otherwise(1.0)


def edge_cost(mode: str = "epistemic") -> Column:
    return F.lit(1.0) if mode == "hops" else 1 / edge_weight()


def time_decay(updated_at, now: int, half_life: float = 30.0, weight: float = 0.3, unset: bool = True) -> Column:
    """unset: times of 0 and below mean that none is known, and don't decay; else they are times before 1970, which decay as any."""
    half, w = half_life if half_life > 0 else 30.0, min(1.0, max(0.0, weight))
    age = F.greatest(F.lit(now) - F.col(updated_at), F.lit(0))
    damped = (1 - w) + w * F.pow(F.lit(2.0), -age / (half * 86400))
    return F.when(F.col(updated_at) <= 0, 1.0).otherwise(damped) if unset else damped


def severity(relation, depth) -> Column:
    r = F.lower(F.col(relation))
    strong = r.rlike("implement|depend|contradict|block|supersede")
    weak = r.rlike("link|refer|relate")
    near = F.col(depth) <= 1
    return F.when(strong & near, "CRITICAL").when(strong, "HIGH").when(weak & near, "MEDIUM").otherwise("LOW")


def severity_weight(s) -> Column:
    out = F.when(F.col(s) == "CRITICAL", 1.0)
    for k, w in list(SEVERITIES.items())[1:]:
        out = out.when(F.col(s) == k, F.lit(w))
    return out.otherwise(0.2)


def risk_score(raw) -> Column:
    return F.round(100 * (1 - 1 / (1 + raw / 5)), 1)


def risk_level(score) -> Column:
    return F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")


def drift_score(commits, pagerank, lines) -> Column:
    raw = F.least(F.lit(40.0), 12.0 * commits) + F.least(F.lit(15.0), 30.0 * pagerank) + F.least(F.lit(25.0), 5.0 * F.log1p(lines))
    return F.round(F.least(F.lit(100.0), raw), 1)


def drift_severity(score) -> Column:
    return F.when(score >= 75, "CRITICAL").when(score >= 55, "HIGH").when(score >= 30, "MEDIUM").otherwise("LOW")


def note_type(node) -> Column:
    n = F.lower(F.col(node))
    out = F.when(F.lit(False), "other")
    for part, kind in NOTE_TYPES.items():
        out = out.when(n.contains(part), kind)
    return out.otherwise("other")


def type_color(t) -> Column:
    out = F.when(F.lit(False), NEUTRAL)
    for kind, color in TYPE_COLORS.items():
        out = out.when(F.col(t) == kind, color)
    return out.otherwise(NEUTRAL)


def community_color(c) -> Column:
    place = ((F.col(c) - 1) % len(PALETTE) + 1).cast("int")
    return F.when(F.col(c) > 0, F.element_at(F.array(*map(F.lit, PALETTE)), F.greatest(place, F.lit(1)))).otherwise(NEUTRAL)


def cosine(a, b) -> Column:
    """Double accumulation; 0 for empty vectors, other lengths or no norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0) & (norm > 0), dot(x, y) / norm).otherwise(0.0)


def l2(a, b) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v))


def backoff(attempt, jitter) -> Column:
    """Seconds before a retry: doubling from 0.1, at most 30, plus or minus a fifth."""
    return F.least(F.lit(0.1) * F.pow(F.lit(2.0), F.col(attempt) - 1), F.lit(30.0)) * (1 + jitter)
