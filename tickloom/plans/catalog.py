"""What operators there are, and calls of them by id or from JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from .series import Series, pair
from .spec import REGISTRY, REQUIRED, Operator, need

STYLES = ("series", "buffer", "stream")


@dataclass(frozen=True)
class Listing:
    """One operator in one style."""

    operator: Operator
    style: str

    @property
    def id(self) -> str:
        return self.operator.id

    def as_dict(self) -> dict[str, Any]:
        op = self.operator
        params = [{"name": _camel(p.name), "type": p.kind, "required": p.default is REQUIRED, "default": p.shown if p.default is REQUIRED or p.default is None else p.default, "minimum": p.low, "maximum": p.high} for p in op.params]
        return {"id": op.id, "name": op.name, "style": self.style, "category": op.category, "parameters": params, "results": [{"name": x, "chainable": x == op.value} for x in op.outputs]}


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def _snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def listings(style: str | None = None, category: str | None = None) -> list[Listing]:
    need(style is None or style in STYLES, f"style is one of {STYLES}")
    found = [Listing(op, s) for op in sorted(REGISTRY.values(), key=lambda o: o.id) for s in op.styles]
    return [x for x in found if style in (None, x.style) and category in (None, x.operator.category)]


def get(id: str, style: str | None = None) -> Listing | None:
    """The listing of an id, whatever its case; the series style unless another is asked for."""
    return next((x for x in listings(style or "series") if x.id == id.upper()), None)


def search(text: str, style: str | None = None, category: str | None = None) -> list[Listing]:
    """Listings whose id or name holds the text, whatever its case."""
    low = text.lower()
    return [x for x in listings(style, category) if low in x.id.lower() or low in x.operator.name.lower()]


def _saved(text: str, path: str | Path | None) -> str:
    if path is not None:
        Path(path).write_text(text)
    return text


def to_json(path: str | Path | None = None) -> str:
    return _saved(json.dumps([x.as_dict() for x in listings()], indent=2), path)


def to_markdown_table(path: str | Path | None = None) -> str:
    rows = [f"| {op.id} | {op.name} | {op.category} | {', '.join(op.styles)} |" for op in sorted(REGISTRY.values(), key=lambda o: o.id)]
    return _saved("\n".join(["| ID | Name | Category | Styles |", "|-|-|-|-|", *rows]), path)


def to_markdown_checklist(path: str | Path | None = None) -> str:
    return _saved("\n".join(f"- [ ] {x.id}: {x.operator.name} ({x.style})" for x in listings()), path)


def execute(series: Series, id: str, params: dict[str, Any] | None = None, other: Series | None = None) -> Series:
    """Run an operator by id; names of parameters may be in either spelling."""
    given = {_snake(k): v for k, v in (params or {}).items()}
    given = {{"smoothing_periods": "smooth_periods"}.get(k, k) if id.upper() == "PMO" else k: v for k, v in given.items()}
    op = REGISTRY.get(id.upper())
    if op is None:
        raise KeyError(f"no operator {id!r}")
    if op.tier == "pair":
        need(other is not None, f"{id} takes two series")
        return pair(id, series, other, **given)
    return series.indicator(id, **given)


def execute_json(series: Series, config: str, other: Series | None = None) -> Series:
    """Run {"id": ..., "parameters": {...}}, or a chain: a list of such."""
    steps = json.loads(config)
    for step in steps if isinstance(steps, list) else [steps]:
        series = execute(series, step["id"], step.get("parameters"), other)
    return series
