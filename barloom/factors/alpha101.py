"""The 101 formulaic alphas of the published paper, as this system's conventions read them, and their window variants.

Weights and windows are the formulas' fixed values. A variant is the same formula with its windows rewritten by a rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from ..functions.fields import close, high, low, open_, ret, spread, volume, vwap
from ..operators import series as s
from ..operators.cross import industry_neutral, rank, scale
from ..operators.series import absolute, filled, flag, largest, log, only, sign, signed_power, smallest, where
from ..plans.expression import Expression, lift
from .registry import register

RULES: dict[str, Callable[[int], int]] = {
    "compress": lambda w: max(2, math.ceil(w / 2)),
    "rev_short": lambda w: max(2, math.ceil(w / 2)) if w <= 10 else w,
    "expand_long": lambda w: math.ceil(w * 1.5) if w >= 60 else w,
}
#: Formulas that have variants.
VARIED = ("005 008 009 010 017 018 019 024 025 029 033 037 038 039 040 041 042 047 049 051 052 054 057 060 073 083 088 090 094 101").split()
mid = (high + low) / 2


class Windows:
    """The window operators with every window put through a rule."""

    def __init__(self, rule: Callable[[int], int] = lambda w: w):
        self.rule = rule

    def __getattr__(self, name: str):
        of = {"sum": s.ts_sum, "mean": s.ts_mean, "min": s.ts_min, "max": s.ts_max, "argmin": s.ts_argmin, "argmax": s.ts_argmax, "ranked": s.ts_rank, "std": s.ts_std, "product": s.ts_product, "delta": s.delta, "delay": s.delay, "decay": s.decay_linear}[name]
        return lambda x, d: of(x, self.rule(d))

    def corr(self, x, y, d):
        return s.correlation(x, y, self.rule(d))

    def cov(self, x, y, d):
        return s.covariance(x, y, self.rule(d))

    def adv(self, d):
        return s.adv(volume, self.rule(d))


def blend(x, y, share):
    """share of x and the rest of y."""
    return x * share + y * (1 - share)


def power_of(a, b):
    return signed_power(filled(largest(a, 0.0), 0.0), b)


def trend(w):
    c = close
    return (w.delay(c, 20) - w.delay(c, 10)) / 10 - (w.delay(c, 10) - c) / 10


def steps(w):
    c = close
    return sign(c - w.delay(c, 1)) + sign(w.delay(c, 1) - w.delay(c, 2)) + sign(w.delay(c, 2) - w.delay(c, 3))


def centred():
    """(close - low) - (high - close) over the range, with the volume."""
    return (close - low - (high - close)) / spread * volume


def turning(w, d):
    """The last change, kept where all of d changes have one sign, else turned round."""
    change = w.delta(close, 1)
    return where(w.min(change, d) > 0, change, where(w.max(change, d) < 0, change, -change))


def alpha_029(w):
    x = rank(rank(-rank(w.delta(close - 1, 5))))
    x = w.sum(w.min(x, 2), 1)
    x = rank(rank(scale(log(x))))
    return w.min(w.product(x, 1), 5) + w.ranked(w.delay(-ret, 6), 5)


def alpha_021(w):
    m8, m2, sd = w.sum(close, 8) / 8, w.sum(close, 2) / 2, w.std(close, 8)
    return where(m8 + sd < m2, -1.0, where(m2 < m8 - sd, 1.0, where(volume / w.adv(20) >= 1, 1.0, -1.0)))


def alpha_036(w):
    a = 2.21 * rank(w.corr(close - open_, w.delay(volume, 1), 15)) + 0.7 * rank(open_ - close) + 0.73 * rank(w.ranked(w.delay(-ret, 6), 5))
    return a + rank(absolute(w.corr(vwap, w.adv(20), 6))) + 0.6 * rank((w.sum(close, 200) / 200 - open_) * (close - open_))


def alpha_047(w):
    return rank(1 / close) * volume / w.adv(20) * (high * rank(high - close) / (w.sum(high, 5) / 5)) - rank(vwap - w.delay(vwap, 5))


def alpha_048(w):
    d1 = w.delta(close, 1)
    top = industry_neutral(w.corr(d1, w.delta(w.delay(close, 1), 1), 250) * d1 / close)
    return top / w.sum((d1 / w.delay(close, 1)) ** 2, 250)


def alpha_071(w):
    a = w.ranked(w.decay(w.corr(w.ranked(close, 3), w.ranked(w.adv(180), 12), 18), 4), 15)
    return largest(a, w.ranked(w.decay(rank(low + open_ - (vwap + vwap)) ** 2, 16), 4))


def alpha_081(w):
    inner = w.product(rank(rank(w.corr(vwap, w.sum(w.adv(10), 50), 8)) ** 4), 15)
    return -flag(rank(log(inner)) < rank(w.corr(rank(vwap), rank(volume), 5)))


def alpha_083(w):
    ratio = spread / (w.sum(close, 5) / 5)
    return rank(w.delay(ratio, 2)) * rank(rank(volume)) / (ratio / (vwap - close))


def alpha_100(w):
    b = scale(industry_neutral(w.corr(close, rank(w.adv(20)), 5) - rank(w.argmin(close, 30))))
    return -(1.5 * scale(industry_neutral(industry_neutral(rank(centred())))) - b) * (volume / w.adv(20))


FORMULAS: dict[str, Callable[[Windows], Expression]] = {
    "001": lambda w: rank(w.argmax(signed_power(where(ret < 0, w.std(ret, 20), close), 2), 5)) - 0.5,
    "002": lambda w: -w.corr(rank(w.delta(log(volume), 2)), rank((close - open_) / open_), 6),
    "003": lambda w: -w.corr(rank(open_), rank(volume), 10),
    "004": lambda w: -w.ranked(rank(low), 9),
    "005": lambda w: rank(open_ - w.sum(vwap, 10) / 10) * -absolute(rank(close - vwap)),
    "006": lambda w: -w.corr(open_, volume, 10),
    "007": lambda w: where(w.adv(20) < volume, -w.ranked(absolute(w.delta(close, 7)), 60) * sign(w.delta(close, 7)), -1.0),
    "008": lambda w: -rank(w.sum(open_, 5) * w.sum(ret, 5) - w.delay(w.sum(open_, 5) * w.sum(ret, 5), 10)),
    "009": lambda w: turning(w, 5),
    "010": lambda w: rank(turning(w, 4)),
    "011": lambda w: (rank(w.max(vwap - close, 3)) + rank(w.min(vwap - close, 3))) * rank(w.delta(volume, 3)),
    "012": lambda w: sign(w.delta(volume, 1)) * -w.delta(close, 1),
    "013": lambda w: -rank(w.cov(rank(close), rank(volume), 5)),
    "014": lambda w: -rank(w.delta(ret, 3)) * w.corr(open_, volume, 10),
    "015": lambda w: -w.sum(rank(w.corr(rank(high), rank(volume), 3)), 3),
    "016": lambda w: -rank(w.cov(rank(high), rank(volume), 5)),
    "017": lambda w: -rank(w.ranked(close, 10)) * rank(w.delta(w.delta(close, 1), 1)) * rank(w.ranked(volume / w.adv(20), 5)),
    "018": lambda w: -rank(w.std(absolute(close - open_), 5) + (close - open_) + w.corr(close, open_, 10)),
    "019": lambda w: -sign(close - w.delay(close, 7) + w.delta(close, 7)) * (1 + rank(1 + w.sum(ret, 250))),
    "020": lambda w: -rank(open_ - w.delay(high, 1)) * rank(open_ - w.delay(close, 1)) * rank(open_ - w.delay(low, 1)),
    "021": alpha_021,
    "022": lambda w: -w.delta(w.corr(high, volume, 5), 5) * rank(w.std(close, 20)),
    "023": lambda w: where(w.sum(high, 20) / 20 < high, -w.delta(high, 2), 0.0),
    "024": lambda w: where(w.delta(w.sum(close, 100) / 100, 100) / w.delay(close, 100) <= 0.05, -(close - w.min(close, 100)), -w.delta(close, 3)),
    "025": lambda w: rank(-ret * w.adv(20) * vwap * (high - close)),
    "026": lambda w: -w.max(w.corr(w.ranked(volume, 5), w.ranked(high, 5), 5), 3),
    "027": lambda w: where(rank(w.sum(w.corr(rank(volume), rank(vwap), 6), 2) / 2) > 0.5, -1.0, 1.0),
    "028": lambda w: scale(w.corr(w.adv(20), low, 5) + mid - close),
    "029": alpha_029,
    "030": lambda w: (1 - rank(steps(w))) * w.sum(volume, 5) / w.sum(volume, 20),
    "031": lambda w: rank(rank(rank(w.decay(-rank(rank(w.delta(close, 10))), 10)))) + rank(-w.delta(close, 3)) + sign(scale(w.corr(w.adv(20), low, 12))),
    "032": lambda w: scale(w.sum(close, 7) / 7 - close) + 20 * scale(w.corr(vwap, w.delay(close, 5), 230)),
    "033": lambda w: rank(-(1 - open_ / close)),
    "034": lambda w: rank(1 - rank(w.std(ret, 2) / w.std(ret, 5)) + (1 - rank(w.delta(close, 1)))),
    "035": lambda w: w.ranked(volume, 32) * (1 - w.ranked(close + high - low, 16)) * (1 - w.ranked(ret, 32)),
    "036": alpha_036,
    "037": lambda w: rank(w.corr(w.delay(open_ - close, 1), close, 200)) + rank(open_ - close),
    "038": lambda w: -rank(w.ranked(close, 10)) * rank(close / open_),
    "039": lambda w: -rank(w.delta(close, 7) * (1 - rank(w.decay(volume / w.adv(20), 9)))) * (1 + rank(w.sum(ret, 250))),
    "040": lambda w: -rank(w.std(high, 10)) * w.corr(high, volume, 10),
    "041": lambda w: (high * low) ** 0.5 - vwap,
    "042": lambda w: rank(vwap - close) / rank(vwap + close),
    "043": lambda w: w.ranked(volume / w.adv(20), 20) * w.ranked(-w.delta(close, 7), 8),
    "044": lambda w: -w.corr(high, rank(volume), 5),
    "045": lambda w: -rank(w.sum(w.delay(close, 5), 20) / 20) * w.corr(close, volume, 2) * rank(w.corr(w.sum(close, 5), w.sum(close, 20), 2)),
    "046": lambda w: where(trend(w) > 0.25, -1.0, where(trend(w) < 0, 1.0, -(close - w.delay(close, 1)))),
    "047": alpha_047,
    "048": alpha_048,
    "049": lambda w: where(trend(w) < -0.1, 1.0, -(close - w.delay(close, 1))),
    "050": lambda w: -w.max(rank(w.corr(rank(volume), rank(vwap), 5)), 5),
    "051": lambda w: where(trend(w) < -0.05, 1.0, -(close - w.delay(close, 1))),
    "052": lambda w: (-w.min(low, 5) + w.delay(w.min(low, 5), 5)) * rank((w.sum(ret, 240) - w.sum(ret, 20)) / 220) * w.ranked(volume, 5),
    "053": lambda w: -w.delta((close - low - (high - close)) / (close - low), 9),
    "054": lambda w: -((low - close) * open_**5) / ((low - high) * close**5),
    "055": lambda w: -w.corr(rank((close - w.min(low, 12)) / (w.max(high, 12) - w.min(low, 12))), rank(volume), 6),
    "056": lambda w: only(close < close, close),
    "057": lambda w: -((close - vwap) / w.decay(rank(w.argmax(close, 30)), 2)),
    "058": lambda w: -w.ranked(w.decay(w.corr(industry_neutral(vwap), volume, 4), 8), 6),
    "059": lambda w: -w.ranked(w.decay(w.corr(industry_neutral(blend(vwap, vwap, 0.728317)), volume, 4), 16), 8),
    "060": lambda w: -(2 * scale(rank(centred())) - scale(rank(w.argmax(close, 10)))),
    "061": lambda w: flag(rank(vwap - w.min(vwap, 16)) < rank(w.corr(vwap, w.adv(180), 18))),
    "062": lambda w: -flag(rank(w.corr(vwap, w.sum(w.adv(20), 22), 10)) < rank(flag(rank(open_) + rank(open_) < rank(mid) + rank(high)))),
    "063": lambda w: -(rank(w.decay(w.delta(industry_neutral(close), 2), 8)) - rank(w.decay(w.corr(blend(vwap, open_, 0.318108), w.sum(w.adv(180), 37), 13), 12))),
    "064": lambda w: -flag(rank(w.corr(w.sum(blend(open_, low, 0.178404), 12), w.sum(w.adv(120), 12), 16)) < rank(w.delta(blend(mid, vwap, 0.178404), 3))),
    "065": lambda w: -flag(rank(w.corr(blend(open_, vwap, 0.00817205), w.sum(w.adv(60), 8), 6)) < rank(open_ - w.min(open_, 13))),
    "066": lambda w: -(rank(w.decay(w.delta(vwap, 3), 7)) + w.ranked(w.decay((low - vwap) / (open_ - mid), 11), 6)),
    "067": lambda w: -power_of(rank(high - w.min(high, 2)), rank(w.corr(industry_neutral(vwap), industry_neutral(w.adv(20)), 6))),
    "068": lambda w: -flag(w.ranked(w.corr(rank(high), rank(w.adv(15)), 9), 14) < rank(w.delta(blend(close, low, 0.518371), 1))),
    "069": lambda w: -power_of(rank(w.max(w.delta(industry_neutral(vwap), 3), 5)), w.ranked(w.corr(blend(close, vwap, 0.490655), w.adv(20), 5), 9)),
    "070": lambda w: -power_of(rank(w.delta(vwap, 1)), w.ranked(w.corr(industry_neutral(close), w.adv(50), 18), 18)),
    "071": alpha_071,
    "072": lambda w: rank(w.decay(w.corr(mid, w.adv(40), 9), 10)) / rank(w.decay(w.corr(w.ranked(vwap, 4), w.ranked(volume, 19), 7), 3)),
    "073": lambda w: -largest(rank(w.decay(w.delta(vwap, 5), 3)), w.ranked(w.decay(-(w.delta(blend(open_, low, 0.147155), 2) / blend(open_, low, 0.147155)), 3), 17)),
    "074": lambda w: -flag(rank(w.corr(close, w.sum(w.adv(30), 37), 15)) < rank(w.corr(rank(blend(high, vwap, 0.0261661)), rank(volume), 11))),
    "075": lambda w: flag(rank(w.corr(vwap, volume, 4)) < rank(w.corr(rank(low), rank(w.adv(50)), 12))),
    "076": lambda w: -largest(rank(w.decay(w.delta(vwap, 1), 12)), w.ranked(w.decay(w.ranked(w.corr(industry_neutral(low), w.adv(81), 8), 20), 17), 19)),
    "077": lambda w: smallest(rank(w.decay(mid + high - (vwap + high), 20)), rank(w.decay(w.corr(mid, w.adv(40), 3), 6))),
    "078": lambda w: power_of(rank(w.corr(w.sum(blend(low, vwap, 0.352233), 20), w.sum(w.adv(40), 20), 7)), rank(w.corr(rank(vwap), rank(volume), 6))),
    "079": lambda w: flag(rank(w.delta(industry_neutral(blend(close, open_, 0.60733)), 1)) < rank(w.corr(w.ranked(vwap, 4), w.ranked(w.adv(150), 9), 15))),
    "080": lambda w: -power_of(rank(sign(w.delta(industry_neutral(blend(open_, high, 0.868128)), 4))), w.ranked(w.corr(high, w.adv(10), 5), 6)),
    "081": alpha_081,
    "082": lambda w: -smallest(rank(w.decay(w.delta(open_, 1), 15)), w.ranked(w.decay(w.corr(industry_neutral(volume), blend(open_, open_, 0.634196), 17), 7), 13)),
    "083": alpha_083,
    "084": lambda w: signed_power(w.ranked(vwap - w.max(vwap, 15), 21), w.delta(close, 5), exact=True),
    "085": lambda w: power_of(rank(w.corr(blend(high, close, 0.876703), w.adv(30), 10)), rank(w.corr(w.ranked(mid, 4), w.ranked(volume, 10), 7))),
    "086": lambda w: -flag(w.ranked(w.corr(close, w.sum(w.adv(20), 15), 6), 20) < rank(open_ + close - (vwap + open_))),
    "087": lambda w: -largest(rank(w.decay(w.delta(blend(close, vwap, 0.369701), 2), 3)), w.ranked(w.decay(absolute(w.corr(industry_neutral(w.adv(81)), close, 13)), 5), 14)),
    "088": lambda w: smallest(rank(w.decay(rank(open_) + rank(low) - (rank(high) + rank(close)), 8)), w.ranked(w.decay(w.corr(w.ranked(close, 8), w.ranked(w.adv(60), 21), 8), 7), 3)),
    "089": lambda w: w.ranked(w.decay(w.corr(blend(low, low, 0.967285), w.adv(10), 7), 6), 4) - w.ranked(w.decay(w.delta(industry_neutral(vwap), 3), 10), 15),
    "090": lambda w: -power_of(rank(close - w.max(close, 5)), w.ranked(w.corr(industry_neutral(w.adv(40)), low, 5), 3)),
    "091": lambda w: -(w.ranked(w.decay(w.decay(w.corr(industry_neutral(close), volume, 10), 16), 4), 5) - rank(w.decay(w.corr(vwap, w.adv(30), 4), 3))),
    "092": lambda w: smallest(w.ranked(w.decay(flag(mid + close < low + open_), 15), 19), w.ranked(w.decay(w.corr(rank(low), rank(w.adv(30)), 8), 7), 7)),
    "093": lambda w: w.ranked(w.decay(w.corr(industry_neutral(vwap), w.adv(81), 17), 20), 8) / rank(w.decay(w.delta(blend(close, vwap, 0.524434), 3), 16)),
    "094": lambda w: -power_of(rank(vwap - w.min(vwap, 12)), w.ranked(w.corr(w.ranked(vwap, 20), w.ranked(w.adv(60), 4), 18), 3)),
    "095": lambda w: flag(rank(open_ - w.min(open_, 12)) < w.ranked(rank(w.corr(w.sum(mid, 19), w.sum(w.adv(40), 19), 13)) ** 5, 12)),
    "096": lambda w: -largest(w.ranked(w.decay(w.corr(rank(vwap), rank(volume), 4), 4), 8), w.ranked(w.decay(w.argmax(w.corr(w.ranked(close, 7), w.ranked(w.adv(60), 4), 4), 13), 14), 13)),
    "097": lambda w: -(rank(w.decay(w.delta(industry_neutral(blend(low, vwap, 0.721001)), 3), 20)) - w.ranked(w.decay(w.ranked(w.corr(w.ranked(low, 8), w.ranked(w.adv(60), 17), 5), 19), 16), 7)),
    "098": lambda w: rank(w.decay(w.corr(vwap, w.sum(w.adv(5), 26), 5), 7)) - rank(w.decay(w.ranked(w.argmin(w.corr(rank(open_), rank(w.adv(15)), 21), 9), 7), 8)),
    "099": lambda w: -flag(rank(w.corr(w.sum(mid, 20), w.sum(w.adv(60), 20), 9)) < rank(w.corr(low, volume, 6))),
    "100": alpha_100,
    "101": lambda w: (close - open_) / (high - low + 0.001),
}


def _kinds(number: str) -> str:
    return "cross_sectional industry_neutral" if number in "048 058 059 063 067 069 070 076 079 080 082 087 089 090 091 093 097 100".split() else "cross_sectional"


def _add(name: str, number: str, family: str, rule: Callable[[int], int]) -> None:
    register(name, _kinds(number), family)(lambda: lift(FORMULAS[number](Windows(rule))))


for _number in FORMULAS:
    _add(f"alpha_{_number}", _number, "alpha101", lambda w: w)
for _number in VARIED:
    for _rule in RULES:
        _add(f"alpha_{_number}_{_rule}", _number, "alpha101_variants", RULES[_rule])


def window_inventory() -> list[tuple[str, str, int, int]]:
    """(formula, operator, window, how often) of every formula, by building it with windows that take notes."""
    out = []
    for number, build in FORMULAS.items():
        noted: dict[tuple[str, int], int] = {}

        class Noting(Windows):
            def __getattr__(self, name: str, noted=noted):
                of = super().__getattr__(name)

                def call(x, d):
                    noted[name, d] = noted.get((name, d), 0) + 1
                    return of(x, d)

                return call

            def corr(self, x, y, d, noted=noted):
                noted["corr", d] = noted.get(("corr", d), 0) + 1
                return super().corr(x, y, d)

            def cov(self, x, y, d, noted=noted):
                noted["cov", d] = noted.get(("cov", d), 0) + 1
                return super().cov(x, y, d)

            def adv(self, d, noted=noted):
                noted["adv", d] = noted.get(("adv", d), 0) + 1
                return super().adv(d)

        build(Noting())
        out += [(f"alpha_{number}", op, d, n) for (op, d), n in sorted(noted.items())]
    return out
