"""Many rows at once give what single rows give, wherever a batch ends."""

from __future__ import annotations

import numpy as np
import pytest

from tickloom.functions import kernels as K

_rnd = np.random.default_rng(1)
N = 700
X = 100 + _rnd.normal(0, 1, N).cumsum()
H, L, V = X + _rnd.random(N), X - _rnd.random(N), _rnd.integers(0, 50, N).astype(float)

MAKES = {
    "ema": (lambda: K.ema(14), [X]),
    "ema 1": (lambda: K.ema(1), [X]),
    "smma": (lambda: K.smma(14), [X]),
    "dema": (lambda: K.dema(9), [X]),
    "tema": (lambda: K.tema(9), [X]),
    "macd": (lambda: K.macd(12, 26, 9), [X]),
    "macd without signal": (lambda: K.macd(12, 26, 0), [X]),
    "trix": (lambda: K.trix(9), [X]),
    "t3": (lambda: K.t3(5, 0.7), [X]),
    "pvo": (lambda: K.pvo(12, 26, 9), [V + 1]),
    "pmo": (lambda: K.pmo(35, 20, 10), [X]),
    "averages": (lambda: K.averages(3, 10), [X]),
    "tsi": (lambda: K.tsi(25, 13, 7), [X]),
    "rsi": (lambda: K.rsi(14), [X]),
    "atr": (lambda: K.atr(14), [H, L, X]),
    "force index": (lambda: K.force_index(2), [X, V]),
    "hurst": (lambda: K.hurst(100), [X]),
    "dynamic": (lambda: K.dynamic(14, 0.6), [X]),
    "kama": (lambda: K.kama(10, 2, 30), [X]),
    "kama of steps": (lambda: K.kama(4, 2, 30), [np.round(X)]),
    "connors rsi": (lambda: K.connors_rsi(3, 2, 100), [X]),
    "connors rsi of steps": (lambda: K.connors_rsi(3, 2, 20), [np.round(X)]),
    "smi": (lambda: K.smi(13, 25, 2, 3), [H, L, X]),
    "stoch smoothed": (lambda: K.stoch_smoothed(3, 4, 3.0, 2.0), [X]),
    "stoch smoothed once": (lambda: K.stoch_smoothed(1, 3, 3.0, 2.0), [X]),
    "fisher": (lambda: K.fisher(10), [X]),
    "fisher of steps": (lambda: K.fisher(3), [np.round(X)]),
    "adx": (lambda: K.adx(14), [H, L, X]),
    "alligator": (lambda: K.alligator(((13, 8), (8, 5), (5, 0))), [X]),
    "atr stop": (lambda: K.atr_stop(21, 1.0, False), [H, L, X]),
    "atr stop by range": (lambda: K.atr_stop(7, 1.0, True), [H, L, X]),
    "super trend": (lambda: K.super_trend(10, 1.0), [H, L, X]),
    "parabolic sar": (lambda: K.parabolic_sar(0.02, 0.2, 0.02), [H, L]),
    "volatility stop": (lambda: K.volatility_stop(7, 1.0), [H, L, X]),
    "heikin ashi": (lambda: K.heikin_ashi(), [X, H, L, X, V]),
    "kvo": (lambda: K.kvo(34, 55, 13), [H, L, X, V]),
}


@pytest.mark.parametrize("name", MAKES)
@pytest.mark.parametrize("cuts", [[0, N], [0, 1, 2, 7, 14, 15, 40, 300, 301, N], [0, 64, 128, 129, N]])
def test_many_is_one_by_one(name, cuts):
    make, inputs = MAKES[name]
    step = make()
    one = np.array([step(i, *r) for i, r in enumerate(zip(*(x.tolist() for x in inputs), strict=True))], float)
    step, parts = make(), []
    for a, b in zip(cuts, cuts[1:], strict=False):
        parts.append(np.array(step(a, *(float(x[a]) for x in inputs)), float)[None, :] if b - a == 1 else np.array([np.array(y, float) for y in step.many(a, *(x[a:b] for x in inputs))]).T)
    assert np.allclose(np.concatenate(parts), one, rtol=1e-10, atol=1e-10, equal_nan=True)


@pytest.mark.parametrize("name", MAKES)
def test_missing_values_between_clean_runs(name):
    """What a batch with gaps gives is what its rows give one by one."""
    from tickloom.plans.stage import _run

    make, inputs = MAKES[name]
    inputs = [x.copy() for x in inputs]
    for k, x in enumerate(inputs):
        x[[0, 41, 42, 200 + k, 333]] = np.nan
    step = make()
    one = np.array([[np.nan if v is None else v for v in step(i, *r)] for i, r in enumerate(zip(*(x.tolist() for x in inputs), strict=True))], float)
    step, parts = make(), []
    for a, b in ((0, 250), (250, 400), (400, N)):
        parts.append(np.array([[np.nan if v is None else v for v in y] for y in _run(step, [x[a:b] for x in inputs], a, b - a)], float).T)
    assert np.allclose(np.concatenate(parts), one, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_scan():
    x = _rnd.random(200)
    y, want = 3.0, []
    for v in x:
        y = 0.9 * y + 0.1 * v
        want.append(y)
    assert np.allclose(K.scan(x, 0.9, 0.1, 3.0), want)
