"""Factors by name. A name may carry whole-number arguments: momentum_20, ma_slope_20_5, ewma_vol_hl10."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..plans.expression import Expression

_FACTORS: dict[str, tuple[Callable[..., Expression], tuple[str, ...], str]] = {}


def register(name: str, kinds: str, family: str):
    """kinds: space-separated types such as "momentum time_series"."""

    def add(build: Callable[..., Expression]) -> Callable[..., Expression]:
        if name in _FACTORS:
            raise ValueError(f"factor {name} is registered already")
        _FACTORS[name] = (build, tuple(kinds.split()), family)
        return build

    return add


def names(family: str | None = None, kinds: set[str] | None = None, every: bool = False) -> list[str]:
    """Registered names, of one family, with any (or every one) of the kinds."""
    fits = lambda own: not kinds or (kinds <= own if every else bool(kinds & own))
    return [n for n, (_, own, of) in _FACTORS.items() if (family is None or of == family) and fits(set(own))]


def make(name: str) -> Expression:
    """The expression of a name, the longest registered name that fits with the numbers behind it as arguments."""
    for known in sorted(_FACTORS, key=len, reverse=True):
        if name == known or name.startswith(f"{known}_"):
            rest = name[len(known) + 1 :].removeprefix("hl")
            numbers = rest.split("_") if rest else []
            if all(re.fullmatch(r"\d+", n) for n in numbers):
                return _FACTORS[known][0](*map(int, numbers))
    raise KeyError(f"no factor is named {name}")


def describe() -> list[tuple[str, str, str]]:
    return [(n, of, " ".join(own)) for n, (_, own, of) in sorted(_FACTORS.items())]
