"""Audit cards and experiment records on the driver: checks, scores, summaries and their text."""

from __future__ import annotations

from collections.abc import Sequence

# What a benchmark card must state, each worth one point, and the rubric's items, worth up to two each.
REQUIRED = ("dataset", "similarity_definition", "split", "metric", "curve", "area", "limitations")
RUBRIC = ("leakage_control", "axis_measured", "monotone_contract", "uncertainty", "reproducible")


def check(card: dict) -> dict:
    """Missing and empty fields of a card, and ``valid``."""
    missing = [f for f in REQUIRED if f not in card]
    empty = [f for f in REQUIRED if f in card and card[f] in (None, "", [], {})]
    return {"valid": not missing and not empty, "missing": missing, "empty": empty}


def score(card: dict) -> dict:
    """One point for each stated field less one for each missing or empty one, plus 0 to 2 for each item of the rubric."""
    found = check(card)
    stated = len(REQUIRED) - len(found["missing"]) - len(found["empty"])
    rubric = {r: max(0, min(2, int(card.get("rubric", {}).get(r, 0)))) for r in RUBRIC}
    return {"score": stated - len(found["missing"]) - len(found["empty"]) + sum(rubric.values()), "stated": stated, "rubric": rubric}


def summarise(results: Sequence[dict], metric: str, baseline: str, key: str = "name") -> list[dict]:
    """Difference and ratio of every result to the baseline; the ratio is None for a baseline of 0."""
    base = next((r[metric] for r in results if r[key] == baseline), None)
    if base is None:
        raise ValueError(f"no result named {baseline}")
    return [{key: r[key], metric: r[metric], "delta": r[metric] - base, "ratio": r[metric] / base if base else None} for r in results]


def render(card: dict) -> str:
    """A card as Markdown."""
    lines = [f"# {card.get('dataset', 'card')}"]
    for f in REQUIRED[1:]:
        value = card.get(f)
        lines += [f"\n## {f.replace('_', ' ')}", "\n".join(f"- {v}" for v in value) if isinstance(value, (list, tuple)) else str(value if value is not None else "not stated")]
    return "\n".join(lines) + "\n"


def sections(markdown: str) -> dict[str, str]:
    """Sections of a Markdown text by their lower-case heading."""
    out, name = {}, ""
    for line in markdown.splitlines():
        if line.startswith("#"):
            name = line.lstrip("#").strip().lower()
            out[name] = ""
        elif name:
            out[name] += line + "\n"
    return {k: v.strip() for k, v in out.items()}


def check_submission(text: str, required: Sequence[str]) -> dict:
    """Errors for missing or empty sections of a submission, warnings for very short ones."""
    found = sections(text)
    errors = [f"missing {r}" for r in required if not found.get(r.lower())]
    warnings = [f"short {k}" for k, v in found.items() if v and len(v.split()) < 3]
    return {"ok": not errors, "errors": errors, "warnings": warnings}
