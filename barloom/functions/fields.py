"""The fields of a bar and what follows from one bar alone."""

from __future__ import annotations

import numpy as np

from ..operators.series import pct_change
from ..plans import blocks
from ..plans.expression import column, element, places

open_, high, low, close, volume = (column(c) for c in ("open", "high", "low", "close", "volume"))
#: Rounded, so that a bar without a range has its own price and none beside it.
vwap = element(places("{0}", 8), (high + low + close) / 3, do=lambda v: blocks.places(v, 8))
ret = pct_change(close)
spread = high - low


def position():
    """Where the close stands between low and high, from -1 to 1."""
    return ((close - low) - (high - close)) / spread


def true_range():
    from ..operators.series import absolute, delay

    before = delay(close, 1)
    return element("greatest({0}, {1}, {2})", spread, absolute(high - before), absolute(low - before), do=lambda *v: np.fmax.reduce(v))
