"""Parameters of matching."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class MatchConfig:
    """How candidates are found, scored and accepted."""

    shortlist_limit: int = 50
    return_limit: int = 5
    exact_limit: int = 500
    active_only: bool = True
    lexical_gate: float = 0.80
    auto_match_threshold: float = 0.86
    min_margin: float = 0.03
    country_boost: float = 0.04
    country_penalty: float = 0.03
    city_boost: float = 0.03
    city_penalty: float = 0.02
    min_scoring_token_len: int = 3
    token_coverage_threshold: float = 0.84
    compactness_exponent: float = 0.35
    use_fts: bool = True
    use_trigram: bool = True
    use_coverage: bool = True
    use_country: bool = True
    use_city: bool = True
    use_margin: bool = True
    require_multi_token_fuzzy_signal: bool = True


def ablations(full: MatchConfig = MatchConfig()) -> dict[str, MatchConfig]:
    """Six configurations, each adding to the one before; the last is `full`."""
    steps = [
        ("normalized_exact", dict(use_fts=False, use_trigram=False, use_coverage=False, use_country=False, use_city=False, use_margin=False, require_multi_token_fuzzy_signal=False)),
        ("lexical", dict(use_fts=True)),
        ("coverage", dict(use_coverage=True)),
        ("properties", dict(use_country=True, use_city=True)),
        ("margin_and_guard", dict(use_margin=True, require_multi_token_fuzzy_signal=True)),
    ]
    out, now = {}, full
    for name, changes in steps:
        now = replace(now, **changes)
        out[name] = now
    return out | {"full_with_trigram": full}


def grid(thresholds=(0.80, 0.82, 0.84, 0.86, 0.88, 0.90, 0.92), gates=(0.76, 0.78, 0.80, 0.82), base: MatchConfig = MatchConfig()) -> dict[tuple[float, float], MatchConfig]:
    """Configurations by (gate, threshold)."""
    return {(g, t): replace(base, lexical_gate=g, auto_match_threshold=t) for g in gates for t in thresholds}
