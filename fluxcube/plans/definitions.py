"""Which source comes first, and how the gaps of one are filled from the next."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np

from fluxcube.meta import CubeError
from fluxcube.operators.select import Not


class StrategyUnableToProcess(Exception):
    """A strategy can't fill this series from that one; the next strategy is tried."""

    def __init__(self, reason: str) -> None:
        super().__init__(reason)
        self.reason = reason


def fits(selector: Any, value: Any) -> bool:
    """Equality, membership in a list, or not for `Not`."""
    if isinstance(selector, Not):
        return not fits(selector.value, value)
    if isinstance(selector, (list, tuple, set, frozenset)):
        return value in selector
    return selector == value


def matches(selector: Mapping[str, Any], labels: Mapping[str, Any]) -> bool:
    """Whether labels fit a selector; `entity` and `variable` are labels, too. Unknown labels don't fit."""
    return all(k in labels and fits(v, labels[k]) for k, v in selector.items())


@dataclass(frozen=True)
class PriorityDefinition:
    """Selections in order of priority. Each gives every priority dimension one value and may restrict other dimensions.

    Series that fit `exclude_input` are never used, those that fit `exclude_result` are not composed.
    """

    priority_dimensions: Sequence[str]
    priorities: Sequence[Mapping[str, Any]]
    exclude_input: Sequence[Mapping[str, Any]] = ()
    exclude_result: Sequence[Mapping[str, Any]] = ()

    def check(self) -> None:
        for p in self.priorities:
            for d in self.priority_dimensions:
                if d not in p:
                    raise CubeError(f"In priority {dict(p)!r}: missing dimension {d!r}.")
                if not isinstance(p[d], str):
                    raise CubeError(f"In priority {dict(p)!r}: {d!r} must be one value, not {p[d]!r}.")

    def fixed_part(self, priority: Mapping[str, Any]) -> dict[str, Any]:
        return {k: v for k, v in priority.items() if k not in self.priority_dimensions}


class FillingStrategy(Protocol):
    """What a strategy of one's own must offer: a name, and `fill`, which may raise `StrategyUnableToProcess`.

    `fill(days, series, other, label)` gets arrays over the same times (NaN is missing) and returns the filled series and its
    steps, dicts with `time` (list of ISO dates or ["all"]), `function`, `description` and `source`.
    """

    type: str

    def fill(self, days: np.ndarray, series: np.ndarray, other: np.ndarray, label: str) -> tuple[np.ndarray, list[dict]]: ...


@dataclass(frozen=True)
class StrategyDefinition:
    """Pairs (selector, strategy); all that fit a source are tried in order."""

    strategies: Sequence[tuple[Mapping[str, Any], FillingStrategy]] = field(default_factory=list)

    def find(self, labels: Mapping[str, Any]) -> list[FillingStrategy]:
        found = [s for selector, s in self.strategies if matches(selector, labels)]
        if not found:
            raise KeyError(f"no strategy for {dict(labels)!r}")
        return found
