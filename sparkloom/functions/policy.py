"""Which exact rules apply: a project may ask for Spark's own behaviour for some of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

#: Rules without which a query's type or error behaviour changes; they can't be switched off.
REQUIRED = frozenset({"series-direction", "null-order", "list-keeps-null"})


@dataclass(frozen=True)
class FidelityPolicy:
    mode: str = "exact"
    disable: frozenset[str] = frozenset()
    enable: frozenset[str] = frozenset()

    def __post_init__(self):
        if self.mode not in ("exact", "native"):
            raise ValueError(f"unknown fidelity mode: {self.mode}")
        if bad := REQUIRED & self.disable:
            raise ValueError(f"required rules can't be disabled: {', '.join(sorted(bad))}")

    def active(self, rule: str) -> bool:
        if rule in REQUIRED or rule in self.enable:
            return True
        return self.mode == "exact" and rule not in self.disable

    def choose(self, rule: str, exact: Callable[[], Column], native: Callable[[], Column]) -> Column:
        return exact() if self.active(rule) else native()
