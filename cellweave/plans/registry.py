"""Operators by name: declared parameters with defaults, validation and lookup."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

REGISTRY: dict[str, Operator] = {}


@dataclass(frozen=True)
class Operator:
    """inputs: names of grids or tables. params: a default, or a tuple of named options of which the first is the default."""

    name: str
    group: str
    inputs: tuple[str, ...]
    run: Callable
    params: dict = field(default_factory=dict)

    def arguments(self, given: dict) -> dict:
        """Declared defaults overlaid with what is given; options by name or index; unknown names and options raise."""
        if unknown := set(given) - set(self.params):
            raise ValueError(f"{self.name} has no parameter {sorted(unknown)}")
        out = {}
        for key, declared in self.params.items():
            choice = isinstance(declared, tuple) and bool(declared) and all(isinstance(x, str) for x in declared)
            value = given.get(key, declared[0] if choice else declared)
            if choice:
                value = declared[value] if isinstance(value, int) and 0 <= value < len(declared) else value
                if value not in declared:
                    raise ValueError(f"{self.name}: {key} is none of {declared}")
            out[key] = value
        return out

    def __call__(self, *inputs, **params):
        return self.run(*inputs, **self.arguments(params))


def operator(name: str, group: str, inputs: str, **params) -> Callable:
    """Register a function; a later registration of a name wins."""

    def keep(run: Callable) -> Callable:
        REGISTRY[name] = Operator(name, group, tuple(inputs.split()), run, params)
        return run

    return keep


def create(name: str) -> Operator:
    _load()
    if name not in REGISTRY:
        raise ValueError(f"no operator {name}")
    return REGISTRY[name]


def names(group: str | None = None) -> list[str]:
    _load()
    return sorted(k for k, v in REGISTRY.items() if group in (None, v.group))


def groups() -> list[str]:
    _load()
    return sorted({v.group for v in REGISTRY.values()})


def _load() -> None:
    from ..operators import focal, iterate, learn, local, regrid, segments, series, spectral, terrain, zonal  # noqa: F401
    from ..sources import converters, files  # noqa: F401
    from . import pipeline  # noqa: F401
