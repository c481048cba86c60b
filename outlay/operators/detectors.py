"""Registry of detectors: functions from relations to findings that every report then contains.

A detector names the relations it reads and returns a findings relation.  Registering one is all it takes to
have it in the union of checks, the rollups, the sinks and the run summary:

    @detectors.register("idle_gpus", relations=("instances",))
    def idle_gpus(instances, context):
        return finding(instances.filter(…), "idle_gpu", …)

Detectors run in the order of their registration; a name registers once.  Findings are checked by schema
before they are united, so a wrong detector is named instead of breaking the union.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

# Columns of a finding and their types.
FINDING = {
    "category": "string",
    "resource": "string",
    "severity": "string",
    "monthly_cost_estimate": "double",
    "recommendation": "string",
    "excluded": "boolean",
    "details": "string",
}


@dataclass(frozen=True)
class Context:
    """What detectors share: the price book, the as-of moment and options by name."""

    prices: dict
    now: Column
    options: dict[str, Any] = field(default_factory=dict)

    def option(self, name: str, default: Any) -> Any:
        return self.options.get(name, default)


@dataclass(frozen=True)
class Detector:
    name: str
    relations: tuple[str, ...]
    run: Callable[..., DataFrame]

    def findings(self, relations: dict[str, DataFrame], context: Context) -> DataFrame:
        missing = [r for r in self.relations if r not in relations]
        if missing:
            raise ValueError(f"detector {self.name}: no relation {', '.join(missing)}")
        return checked(self.name, self.run(*[relations[r] for r in self.relations], context))


_REGISTRY: dict[str, Detector] = {}


def register(name: str, relations: tuple[str, ...]) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Add the decorated function; it takes its relations in order and then the context."""

    def add(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _REGISTRY:
            raise ValueError(f"detector {name} is registered already")
        _REGISTRY[name] = Detector(name, tuple(relations), run)
        return run

    return add


def unregister(name: str) -> None:
    _REGISTRY.pop(name)


@contextmanager
def registered(name: str, relations: tuple[str, ...], run: Callable[..., DataFrame]) -> Iterator[None]:
    """A detector for the length of a ``with`` block."""
    register(name, relations)(run)
    try:
        yield
    finally:
        unregister(name)


def names() -> list[str]:
    return list(_REGISTRY)


def checked(name: str, found: DataFrame) -> DataFrame:
    """``found`` in the column order of a finding, or an error that names the detector and its columns."""
    types = {f.name: f.dataType.simpleString() for f in found.schema}
    if types != FINDING:
        wrong = sorted(set(types.items()) ^ set(FINDING.items()))
        raise ValueError(f"detector {name}: columns differ from those of a finding: {wrong}")
    return found.select(*FINDING)


def run_all(relations: dict[str, DataFrame], context: Context) -> list[DataFrame]:
    """The findings of every detector."""
    return [d.findings(relations, context) for d in list(_REGISTRY.values())]
