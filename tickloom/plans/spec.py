"""What an operator is, and the table of all operators."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

#: Stands for a parameter that has no default.
REQUIRED = object()


@dataclass(frozen=True)
class Param:
    """A parameter with its default and the range a user interface may offer; rules are the operator's own."""

    name: str
    default: Any = REQUIRED
    low: Any = None
    high: Any = None
    #: What a catalog shows as default where the call itself has none.
    shown: Any = None
    kind: str = "int"


@dataclass(frozen=True)
class Operator:
    id: str
    name: str
    category: str
    params: tuple[Param, ...]
    outputs: tuple[str, ...]
    #: Output that the next operator of a chain reads, or an expression over outputs; None: it ends a chain.
    value: str | None
    build: Callable
    check: Callable[..., None] | None = None
    #: "bars" needs open, high, low, close and volume; "value" takes any value column.
    needs: str = "value"
    #: Price that bars stand for, where it is not close.
    price: str = "close"
    #: native: window expressions; fold: one pass in order; whole: needs the end of the series; pair: two series.
    tier: str = "native"
    #: Rows to drop while results are still converging: f(first row with a result, params); None: up to that row.
    warmup: Callable[[int, dict], int] | None = None
    #: Output whose first non-null row counts for warmup; None: the chain value or the first output.
    warmup_on: str | None = None
    styles: tuple[str, ...] = ("series", "buffer", "stream")
    #: Whether later rows can change earlier results.
    repaints: bool = False
    #: Whether there may be more or fewer result rows than bars.
    reshapes: bool = False


REGISTRY: dict[str, Operator] = {}


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def operator(id: str, name: str, category: str, params: list[Param] | None = None, **rest: Any) -> Callable:
    """Register the decorated build function under an id."""

    need(re.fullmatch(r"[A-Za-z0-9._-]+", id) is not None, f"an id has letters, digits and . _ - only, not {id!r}")

    def put(build: Callable) -> Callable:
        REGISTRY[id] = Operator(id=id, name=name, category=category, params=tuple(params or ()), build=build, **{k: tuple(v) if k in ("outputs", "styles") else v for k, v in rest.items()})
        return build

    return put


@dataclass
class Bound:
    """An operator with its parameters, checked."""

    operator: Operator
    params: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, id: str, *args: Any, **params: Any) -> Bound:
        found = REGISTRY.get(id.upper().replace("_", "-"))
        if found is None:
            raise KeyError(f"no operator {id!r}")
        names = [p.name for p in found.params]
        need(len(args) <= len(names), f"{id} takes at most {len(names)} parameters")
        given = dict(zip(names, args, strict=False))
        need(not given.keys() & params.keys(), f"{id}: a parameter is given twice")
        given |= params
        need(not given.keys() - set(names), f"{id} has no parameter {sorted(given.keys() - set(names))}")
        whole = {p.name: given.get(p.name, p.default) for p in found.params}
        missing = [k for k, v in whole.items() if v is REQUIRED]
        need(not missing, f"{id} needs {missing}")
        if found.check:
            found.check(**whole)
        return cls(found, whole)
