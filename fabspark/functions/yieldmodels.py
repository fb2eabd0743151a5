"""Analytical die-yield models as Column functions, plus their inverses.

* Poisson            Y = exp(-D0 A)
* Murphy             Y = ((1 - exp(-D0 A)) / (D0 A))^2, 1 when D0 A <= 1e-12
* Negative binomial  Y = (1 + D0 A / alpha)^(-alpha)

The registry is ordered (poisson, murphy, negative_binomial) and extensible:
``register_model`` adds a name with a Column function and parameter list.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fit defaults and bounds.
D0_INIT = 0.05
ALPHA_INIT = 2.0
D0_BOUNDS = (1e-9, math.inf)
ALPHA_BOUNDS = (1e-3, 1e6)
A_HI = 1e6                 # inverse search upper bound (unit-die areas)
MURPHY_EPS = 1e-12


def _c(x):
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def poisson(area, d0) -> Column:
    return F.exp(-_c(d0) * _c(area))


def murphy(area, d0) -> Column:
    lam = _c(d0) * _c(area)
    core = F.when(lam > MURPHY_EPS, (1.0 - F.exp(-lam)) / F.when(lam > MURPHY_EPS, lam)).otherwise(F.lit(1.0))
    return core * core


def negative_binomial(area, d0, alpha) -> Column:
    a = _c(alpha)
    return F.pow(1.0 + _c(d0) * _c(area) / a, -a)


@dataclass(frozen=True)
class YieldModel:
    name: str
    param_names: tuple[str, ...]
    fn: Callable[..., Column]
    initial: tuple[float, ...] = field(default=(D0_INIT,))
    bounds: tuple[tuple[float, float], ...] = field(default=(D0_BOUNDS,))

    @property
    def n_params(self) -> int:
        return len(self.param_names)

    def predict(self, area, d0, alpha=None) -> Column:
        return self.fn(area, d0) if self.n_params == 1 else self.fn(area, d0, alpha)


MODELS: dict[str, YieldModel] = {}


def register_model(m: YieldModel) -> YieldModel:
    MODELS[m.name] = m
    return m


register_model(YieldModel("poisson", ("D0",), poisson))
register_model(YieldModel("murphy", ("D0",), murphy))
register_model(YieldModel("negative_binomial", ("D0", "alpha"), negative_binomial,
                          (D0_INIT, ALPHA_INIT), (D0_BOUNDS, ALPHA_BOUNDS)))

MODEL_ORDER = ("poisson", "murphy", "negative_binomial")


def get_model(name: str) -> YieldModel:
    if name not in MODELS:
        raise KeyError(f"unknown yield model {name!r}; known: {sorted(MODELS)}")
    return MODELS[name]


def yield_by_name(model_col, area, d0, alpha) -> Column:
    """Per-row dispatch on a model-name column (one expression for all models)."""
    m = _c(model_col)
    expr = None
    for name, mdl in MODELS.items():
        v = mdl.predict(area, d0, alpha)
        expr = F.when(m == name, v) if expr is None else expr.when(m == name, v)
    return expr


NEWTON_STEPS = 8           # from the bound below, 6 reach double precision anywhere in (0, 1)


def _murphy_root(target: Column, d0: Column) -> Column:
    """Area where murphy(A) = target, for 0 < target < 1.

    With l = D0 A and s = sqrt(target) this is (1 - e^-l) / l = s. The left side is
    convex and falls, so Newton steps from a point left of the root rise to it
    without passing it; both 2 (1 - s) and 1 / s - 1 lie left of it."""
    s = F.sqrt(target)
    start = F.greatest(2.0 * (1.0 - s), F.try_divide(F.lit(1.0), s) - 1.0, F.lit(MURPHY_EPS))

    def step(lam, _):
        g = -F.expm1(-lam) / lam
        slope = F.when(lam < 1e-4, lam / 3.0 - 0.5).otherwise((F.exp(-lam) - g) / lam)
        return lam - (g - s) / slope
    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step) / d0


def max_area_for_yield(model: str, target, d0, alpha=None) -> Column:
    """Largest area whose predicted yield is still >= target.

    NULL unless 0 < target < 1; +inf when the yield at ``A_HI`` is still above
    the target. Poisson and negative binomial use closed forms, Murphy Newton steps.
    """
    t, d0c = _c(target), _c(d0)
    ok = (t > 0) & (t < 1)
    if model == "poisson":
        root = -F.log(t) / d0c
        beyond = poisson(A_HI, d0c) > t
    elif model == "negative_binomial":
        a = _c(alpha)
        root = a * (F.pow(t, -1.0 / a) - 1.0) / d0c
        beyond = negative_binomial(A_HI, d0c, a) > t
    elif model == "murphy":
        root = _murphy_root(F.when(ok, t), d0c)
        beyond = murphy(A_HI, d0c) > t
    else:
        raise KeyError(f"no inverse for model {model!r}")
    return F.when(~ok, F.lit(None).cast("double")).when(beyond, F.lit(float("inf"))).otherwise(root)


def inverse_by_name(model_col, target, d0, alpha) -> Column:
    m = _c(model_col)
    expr = None
    for name in MODELS:
        v = max_area_for_yield(name, target, d0, alpha)
        expr = F.when(m == name, v) if expr is None else expr.when(m == name, v)
    return expr
