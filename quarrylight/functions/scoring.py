"""Scores, weights, ranks and severities as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of occurrence kinds.
KIND_WEIGHTS = {"def": 1.0, "decl": 0.8, "impl": 0.7, "modifier": 0.6, "event": 0.55, "assign": 0.5, "use": 0.3}
# Path patterns of third-party and generated code with their weights; the first match counts.
TIER_PATTERNS = [
    ("node_modules/", 0.1),
    ("vendor/", 0.1),
    (r"\.venv/", 0.1),
    ("site-packages/", 0.1),
    ("__pycache__/", 0.05),
    ("dist/", 0.15),
    ("build/", 0.15),
    ("target/", 0.15),
    (r"\.gradle/", 0.1),
]
# Severities, worst first.
SEVERITIES = ("critical", "high", "medium", "low", "informational")


def hotspot_score(complexity: Column, churn: Column) -> Column:
    return F.log1p(complexity) * F.log1p(churn)


def hotspot_severity(score: Column) -> Column:
    return F.when(score >= 5, "critical").when(score >= 3, "high").when(score >= 1.5, "medium").when(score > 0, "low").otherwise("informational")


def half_life_decay(days: Column, half_life: float = 30.0) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * days / half_life)


def recency_weight(age_seconds: Column, decay_days: float) -> Column:
    return F.exp(-age_seconds / (decay_days * 86400.0))


def tier_weight(path: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for pattern, weight in TIER_PATTERNS:
        out = out.when(path.rlike(pattern), weight)
    return out.otherwise(1.0)


def kind_weight(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in KIND_WEIGHTS.items() for x in pair))[kind]


def language_weight(language: Column, primary: str | None) -> Column:
    out = F.when(F.coalesce(language, F.lit("unknown")) == "unknown", 0.1)
    return (out.when(language == primary, 1.0) if primary else out).otherwise(0.5)


def importance(in_degree: Column, tier: Column, kind: Column, days: Column, language: Column, half_life: float = 30.0) -> Column:
    """0.35 centrality, 0.30 tier, 0.20 kind, 0.10 recency, 0.05 language, within 0 and 1."""
    centrality = F.log1p(in_degree) / F.log1p(F.lit(100.0))
    raw = 0.35 * centrality + 0.30 * tier + 0.20 * kind + 0.10 * half_life_decay(F.greatest(days, F.lit(0.0)), half_life) + 0.05 * language
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def ownership_weight(blame_share: Column, churn_share: Column, alpha: float = 0.5) -> Column:
    return alpha * blame_share + (1 - alpha) * churn_share


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for informational; what is unknown ranks last."""
    out = F.when(F.lit(False), 0)
    for k, name in enumerate(SEVERITIES):
        out = out.when(F.lower(severity) == name, k)
    return out.otherwise(len(SEVERITIES) - 1)


def parsed_severity(severity: Column) -> Column:
    """A known severity in lower case, else informational."""
    return F.when(F.lower(severity).isin(*SEVERITIES), F.lower(severity)).otherwise("informational")


def removed_severity(removed: Column) -> Column:
    """Of an API delta, by how many symbols went: over 10 high, over 3 medium, any low."""
    return F.when(removed > 10, "high").when(removed > 3, "medium").when(removed > 0, "low").otherwise("informational")


def hot_path_severity(share: Column) -> Column:
    return F.when(share >= 0.20, "high").when(share >= 0.10, "medium").when(share > 0, "low").otherwise("informational")


def ownership_severity(top_weight: Column) -> Column:
    """A file whose best owner holds little: below 0.1 high, below 0.2 medium."""
    return F.when(top_weight < 0.1, "high").when(top_weight < 0.2, "medium").otherwise("informational")


def skew_severity(level: Column) -> Column:
    return F.when(level == "major", "high").when(level == "minor", "medium").when(level == "patch", "low").otherwise("informational")


def coverage_pct(found: Column, evicted: Column) -> Column:
    """Whole percent of found among found and evicted; 100 if there is nothing."""
    total = found + evicted
    return F.when(total == 0, F.lit(100)).otherwise(F.floor(100 * found / total).cast("int"))


def share(part: Column, total: Column) -> Column:
    """part / total, 0 where the total is 0 or null."""
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


# Paths where a swallowed error matters more, kinds of swallowed errors, and paths that need tests most.
CRITICAL_PATH = r"(?i)\b(signer|crypto|hd[-_]?wallet|hmac|sign|auth|mnemonic|seed|pubkey|keystore|secp256k1|ed25519|ripemd160)\b"
SWALLOWED = ("try_optional_swallow", "try_optional_in_crypto_path", "nil_coalesce_swallows_error")
DELICATE = ("wallet", "crypto", "seed", "key", "payment", "transaction")


def critical_path_severity(severity: Column, kind: Column, path: Column, context: Column) -> Column:
    """Swallowed errors are of medium severity on a critical path, else low; in examples and tests low; suppressed ones stay."""
    tuned = F.when(~context.isin("example", "test") & path.rlike(CRITICAL_PATH), "medium").otherwise("low")
    return F.when((severity == "informational") | ~kind.isin(*SWALLOWED), severity).otherwise(tuned)


def untestable_severity(path: Column) -> Column:
    return F.when(F.lower(path).rlike("|".join(DELICATE)), "high").otherwise("medium")


def node_confidence(kind: Column, resolution: Column, weak: Sequence[str], partly: Sequence[str]) -> Column:
    """low for weak kinds, medium for those that are resolved in part, else high."""
    return F.when(kind.isin(*weak), "low").when(resolution.isin(*partly), "medium").otherwise("high")


def edge_confidence(kind: Column, resolution: Column, trigger: Column, partly: Sequence[str]) -> Column:
    """medium for edges resolved in part and effects whose trigger is unknown, else high."""
    return F.when(resolution.isin(*partly) | ((kind == "triggers_effect") & trigger.isNull()), "medium").otherwise("high")


def control_kind(context: Column) -> Column:
    """button, image, icon, textfield, tappable_view or other."""
    return F.when(F.lower(context).isin("button", "image", "icon", "textfield", "tappable_view"), F.lower(context)).otherwise("other")


def surface_of(rule: Column) -> Column:
    """android for rules that name it or its toolkit, else ios."""
    return F.when(F.lower(rule).rlike("compose|android"), "android").otherwise("ios")
