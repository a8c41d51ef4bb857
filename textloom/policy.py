"""Reservation policy: defaults, per-pair overrides, validation that lists every problem."""

from __future__ import annotations

from copy import deepcopy
from typing import Any

DEFAULT: dict[str, Any] = {
    "selection": {"selector": "heuristic", "share_percent": 2.0, "max_rows": 5000, "dev_share": 0.5, "gold_size": 120, "seed": 42, "diversity": "random"},
    "candidates": {"limit": 50_000, "multiple": 10},
    "dedup": {"minhash_threshold": 0.85, "embedding_threshold": 0.95},
    "documents": {"most": 200, "budget_share": 0.01, "budget_rows": None, "namespace": "source"},
    "quotas": {"domain_alpha": 0.5, "domain_floor": 50, "length_edges": [0, 15, 40, 80, 999_999], "bucket_shares": [0.20, 0.35, 0.30, 0.15]},
    "contamination": {"comparison_scope": "pair", "contamination_scope": "registry", "shingle_size": 3, "least_shingles": 2, "near_duplicate": 0.92},
}
SCOPES = {"comparison_scope": ("pair", "source", "target", "any"), "contamination_scope": ("registry", "dataset")}


def merged(base: dict[str, Any], over: dict[str, Any] | None) -> dict[str, Any]:
    """Nested update of a copy; lists are replaced."""
    out = deepcopy(base)
    for k, v in (over or {}).items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def for_pair(policy: dict[str, Any], pair: str) -> dict[str, Any]:
    """The policy of one language pair: its entry under 'pairs' over the rest."""
    rest = {k: v for k, v in policy.items() if k != "pairs"}
    return merged(rest, policy.get("pairs", {}).get(pair))


def problems(policy: dict[str, Any]) -> list[str]:
    """Everything that is wrong with a policy."""
    out = [f"unknown section {k}" for k in policy if k not in DEFAULT and k != "pairs"]
    for name, section in DEFAULT.items():
        given = policy.get(name, {})
        if not isinstance(given, dict):
            out.append(f"{name} must be a mapping")
            continue
        out += [f"unknown key {name}.{k}" for k in given if k not in section]
    full = merged(DEFAULT, {k: v for k, v in policy.items() if isinstance(v, dict) and k != "pairs"})
    s, q, c = full["selection"], full["quotas"], full["contamination"]
    if not 0 < s["share_percent"] <= 100:
        out.append("selection.share_percent must be in (0, 100]")
    if not 0 <= s["dev_share"] <= 1:
        out.append("selection.dev_share must be in [0, 1]")
    edges = q["length_edges"]
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:])):
        out.append("quotas.length_edges must ascend")
    if len(q["bucket_shares"]) != len(edges) - 1:
        out.append("quotas.bucket_shares must have a share for each bucket")
    if s["selector"] not in ("heuristic", "random"):
        out.append("selection.selector must be heuristic or random")
    if s["diversity"] not in ("random", "kcenter"):
        out.append("selection.diversity must be random or kcenter")
    for k, allowed in SCOPES.items():
        if c[k] not in allowed:
            out.append(f"contamination.{k} must be one of {', '.join(allowed)}")
    for a, b in (("dedup", "minhash_threshold"), ("dedup", "embedding_threshold"), ("contamination", "near_duplicate")):
        if not 0 < full[a][b] <= 1:
            out.append(f"{a}.{b} must be in (0, 1]")
    for pair, over in policy.get("pairs", {}).items():
        out += [f"pairs.{pair}: {p}" for p in problems(over)]
    return out


def validated(policy: dict[str, Any] | None) -> dict[str, Any]:
    """The whole policy; a ValueError that lists all problems."""
    wrong = problems(policy or {})
    if wrong:
        raise ValueError("; ".join(wrong))
    return merged(DEFAULT, policy)
