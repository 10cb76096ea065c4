"""The canonical form of a model's rules and scenarios: interned names, whole numbers, fixed key order."""

from __future__ import annotations

import json
from pathlib import Path

from ..errors import ModelError
from .model import Model

HORIZON_UNITS = {"s": 1, "min": 60, "h": 3600}


def whole(value: float, what: str) -> int:
    n = round(value)
    if abs(value - n) > 1e-9:
        raise ModelError(f"{what} is not a whole number: {value}")
    return n


def lower(model: Model) -> dict:
    rules = [r.name for r in model.rules]
    others = {s for r in model.rules for s in (r.subject, r.region, r.from_state, r.to_state)}
    for s in model.scenarios.values():
        others |= {s.name, *(n for subject, p in s.moves for n in (subject, p.crs))}
    symbols = rules + sorted(others - set(rules))
    number = {s: i for i, s in enumerate(symbols)}

    def rule(r) -> dict:
        out = {"name": number[r.name], "trigger": r.kind, "subject": number[r.subject], "region": number[r.region], "fromState": number[r.from_state], "toState": number[r.to_state]}
        return out if r.duration_us is None else out | {"durationSeconds": whole(r.duration_us / 1e6, f"duration of {r.name}")}

    scenarios = []
    for s in model.scenarios.values():
        actions = []
        for subject, p in s.moves:
            x, y = whole(p.x * 1e6, f"x of {subject}"), whole(p.y * 1e6, f"y of {subject}")
            actions.append({"kind": "move", "subject": number[subject], "position": {"xMicrodegrees": x, "yMicrodegrees": y, "crs": number[p.crs]}, "time": 0})
        if s.run_unit is not None:
            if s.run_unit not in HORIZON_UNITS:
                raise ModelError(f"scenario {s.name!r}: unit {s.run_unit!r} has no canonical form")
            actions.append({"kind": "advance", "time": whole(s.run_amount * HORIZON_UNITS[s.run_unit], f"horizon of {s.name}")})
        scenarios.append({"name": number[s.name], "actions": actions})
    return {
        "schemaVersion": 1,
        "symbols": symbols,
        "durationRules": [rule(r) for r in model.rules if r.duration_us is not None],
        "immediateRules": [rule(r) for r in model.rules if r.duration_us is None],
        "scenarios": scenarios,
    }


def dumps(model: Model) -> str:
    return json.dumps(lower(model), ensure_ascii=False, separators=(",", ":")) + "\n"


def write(model: Model, path: str) -> Path:
    out = Path(path)
    out.write_text(dumps(model), encoding="utf-8", newline="\n")
    return out
