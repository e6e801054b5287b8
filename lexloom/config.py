"""Engine settings, passed explicitly, and the fixed values that results depend on."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from typing import Any

# Issue types with their default severity.
ISSUE_SEVERITY = {
    "parameter_name_mismatch": "critical",
    "parameter_missing": "critical",
    "parameter_type_mismatch": "high",
    "return_type_mismatch": "high",
    "missing_raises": "medium",
    "parameter_order_different": "medium",
    "description_outdated": "medium",
    "example_invalid": "low",
    "missing_examples": "medium",
    "example_outdated": "low",
    "example_incomplete": "low",
    "missing_params": "critical",
    "missing_returns": "high",
    "undocumented_kwargs": "medium",
    "type_mismatches": "high",
    "default_mismatches": "medium",
    "parameter_count_mismatch": "critical",
}
# Weights by severity (sorting; ranking), ranking priority by issue type.
SEVERITY_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1}
RANK_SEVERITY = {"critical": 10.0, "high": 7.0, "medium": 4.0, "low": 1.0}
RANK_TYPE = {
    "parameter_name_mismatch": 10.0,
    "parameter_missing": 9.0,
    "parameter_type_mismatch": 8.0,
    "return_type_mismatch": 7.0,
    "missing_raises": 6.0,
    "parameter_order_different": 5.0,
    "description_outdated": 4.0,
    "example_invalid": 3.0,
}
# Weights of the seven features of example retrieval.
RETRIEVAL_WEIGHT = {"name": 0.25, "signature": 0.20, "types": 0.15, "complexity": 0.10, "module": 0.10, "recency": 0.10, "quality": 0.10}


@dataclass(frozen=True)
class EngineConfig:
    """One immutable record of settings; profiles and layers make others from it."""

    enabled_rules: tuple[str, ...] = ()
    disabled_rules: tuple[str, ...] = ()
    severity_overrides: dict[str, str] = field(default_factory=dict)
    min_confidence: float = 0.5
    llm_below: float = 0.9
    analysis_types: tuple[str, ...] = ()
    complexity_above: int = 10
    strategy: str = "balanced"
    top_n: int = 3
    min_similarity: float = 0.3
    #: What names must match, by the kind of name: regular expressions of the caller.
    name_patterns: dict[str, str] = field(default_factory=dict)

    def layered(self, *layers: dict[str, Any] | None) -> EngineConfig:
        """Later layers win; nested maps merge; unknown keys are an error."""
        out = self
        known = {f.name for f in fields(self)}
        for layer in layers:
            if unknown := set(layer or {}) - known:
                raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
            for k, v in (layer or {}).items():
                old = getattr(out, k)
                out = replace(out, **{k: deep_merge(old, v) if isinstance(old, dict) and isinstance(v, dict) else tuple(v) if isinstance(old, tuple) else v})
        return out


def deep_merge(low: dict, high: dict) -> dict:
    return {**low, **{k: deep_merge(low[k], v) if isinstance(low.get(k), dict) and isinstance(v, dict) else v for k, v in high.items()}}


PROFILES = {
    "fast": EngineConfig(min_confidence=0.8, llm_below=0.7),
    "thorough": EngineConfig(llm_below=1.0, analysis_types=("behavior", "examples", "edge_cases")),
    "strict": EngineConfig(min_confidence=0.8, strategy="severity_first"),
    "permissive": EngineConfig(min_confidence=0.3),
    "development": EngineConfig(min_confidence=0.6, strategy="impact_first"),
}

# How strict a ranking is.
RANKERS = {
    "strict": {"least": 0.8, "severities": ("critical", "high"), "ready": "only"},
    "balanced": {"least": 0.6, "severities": None, "ready": None},
    "permissive": {"least": 0.3, "severities": None, "ready": None},
}


def problems(config: EngineConfig) -> list[str]:
    """What is wrong with settings."""
    out = [f"{n} is not between 0 and 1" for n in ("min_confidence", "llm_below", "min_similarity") if not 0 <= getattr(config, n) <= 1]
    out += [f"unknown severity {v}" for v in config.severity_overrides.values() if v not in SEVERITY_WEIGHT]
    for kind, pattern in config.name_patterns.items():
        try:
            re.compile(pattern)
        except re.error as e:
            out.append(f"the pattern of {kind} is not a regular expression: {e}")
    out += ["top_n is not positive"] if config.top_n < 1 else []
    return out
