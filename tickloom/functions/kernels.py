"""Calculations that run along a series and keep a state.

Each function here returns a fresh step(i, *inputs) that takes the rows of one series in
order, i being the row number, and returns a tuple. A missing number is NaN. The same
steps serve whole tables and single new rows. Linear rules also have step.many(i, *arrays),
which takes many rows at once and leaves the same state behind.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np

NAN = float("nan")
Step = Callable[..., tuple]

#: Rows that one matrix product covers.
BLOCK = 64
_DECAYS: dict[float, tuple[np.ndarray, np.ndarray]] = {}


def scan(x: np.ndarray, keep: float, take: float, last: float) -> np.ndarray:
    """y[t] = keep * y[t-1] + take * x[t], from y[-1] = last on: blocks of rows as matrix products, linked one by one."""
    n = len(x)
    if keep not in _DECAYS:
        away = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None, :]
        _DECAYS[keep] = (np.where(away >= 0, keep ** np.maximum(away, 0), 0.0), keep ** np.arange(1, BLOCK + 1))
    inside, decay = _DECAYS[keep]
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK)
    padded[:n] = x
    out = take * (padded.reshape(rows, BLOCK) @ inside.T)
    carry, ends, fall = np.empty(rows), out[:, -1].tolist(), float(decay[-1])
    for k in range(rows):
        carry[k] = last
        last = ends[k] + fall * last
    return (out + carry[:, None] * decay[None, :]).ravel()[:n]


def with_many(step: Step, many: Callable[..., tuple]) -> Step:
    step.many = many  # type: ignore[attr-defined]
    return step


def changes(x: np.ndarray, last: float) -> np.ndarray:
    return np.diff(x, prepend=last)


class Recent:
    """The last n values."""

    def __init__(self, n: int):
        self.n, self.values = n, deque(maxlen=n)

    def push(self, x: float) -> None:
        self.values.append(x)

    def mean(self) -> float:
        return sum(self.values) / self.n if len(self.values) == self.n else NAN

    def push_many(self, x: np.ndarray) -> None:
        self.values.extend(x[-self.n :].tolist())


class Smooth:
    """Exponential smoothing that starts with the plain mean of n values, anew after each NaN result.

    first: the earliest row number for a start. factor: share of the new value.
    """

    def __init__(self, n: int, factor: float | None = None, first: int | None = None):
        self.recent = Recent(n)
        self.factor = 2 / (n + 1) if factor is None else factor
        self.first = n - 1 if first is None else first
        self.value = NAN

    def push(self, i: int, x: float) -> float:
        self.recent.push(x)
        if i < self.first:
            return NAN
        if self.value != self.value:
            self.value = self.recent.mean()
        else:
            self.value += self.factor * (x - self.value)
        return self.value

    def push_many(self, i: int, x: np.ndarray) -> np.ndarray:
        """The same for the rows from i on; rows before the start, and any with missing values, go one by one."""
        out = np.empty(len(x))
        head = 0
        while head < len(x) and self.value != self.value:
            out[head] = self.push(i + head, float(x[head]))
            head += 1
        rest = x[head:]
        if np.isnan(rest).any():
            out[head:] = [self.push(i + head + k, v) for k, v in enumerate(rest.tolist())]
        elif len(rest):
            self.recent.push_many(rest)
            out[head:] = scan(rest, 1 - self.factor, self.factor, self.value)
            self.value = float(out[-1])
        return out


class Wilder(Smooth):
    """Smoothing with 1/n as the share of the new value."""

    def __init__(self, n: int, first: int | None = None):
        super().__init__(n, 1 / n, first)

    def push(self, i: int, x: float) -> float:
        self.recent.push(x)
        if i < self.first:
            return NAN
        n = self.recent.n
        self.value = self.recent.mean() if self.value != self.value else (self.value * (n - 1) + x) / n
        return self.value


class Cascade:
    """Several exponential stages fed by each other, all started with one plain mean."""

    def __init__(self, n: int, stages: int):
        self.recent, self.k, self.n = Recent(n), 2 / (n + 1), n
        self.e = [NAN] * stages
        self.started = False

    def push(self, i: int, x: float) -> list[float] | None:
        """The stages, or None on rows before the start. started is true on the row of the start."""
        self.recent.push(x)
        if i < self.n - 1:
            return None
        self.started = self.e[-1] != self.e[-1]
        if self.started:
            self.e = [self.recent.mean()] * len(self.e)
        else:
            into = x
            for j, e in enumerate(self.e):
                self.e[j] = into = e + self.k * (into - e)
        return self.e

    def push_many(self, i: int, x: np.ndarray) -> tuple[np.ndarray, int]:
        """(stages, rows) and the row of a start among them, -1 if there is none or there are several."""
        out = np.full((len(self.e), len(x)), NAN)
        head, start = 0, -1
        while head < len(x) and self.e[-1] != self.e[-1]:
            e = self.push(i + head, float(x[head]))
            if e:
                out[:, head] = e
                start = head if e[-1] == e[-1] else -1
            head += 1
        rest = x[head:]
        if np.isnan(rest).any():
            raise ValueError("missing values go one by one")
        if len(rest):
            self.recent.push_many(rest)
            into = rest
            for j, e in enumerate(self.e):
                into = out[j, head:] = scan(into, 1 - self.k, self.k, e)
                self.e[j] = float(into[-1])
        return out, start


def by_rows(step: Callable[..., tuple], i: int, arrays: tuple, until: int, width: int) -> tuple[np.ndarray, int]:
    """(outputs, rows) of the rows before row `until`, one by one; the other outputs are still to be filled."""
    n = len(arrays[0])
    head = min(max(until - i, 0), n)
    out = np.full((width, n), NAN)
    for k, row in enumerate(zip(*(x[:head].tolist() for x in arrays), strict=True)):
        out[:, k] = [NAN if v is None else v for v in step(i + k, *row)]
    return out, head


def unclean(values: deque) -> int:
    """Rows after which a window holds no missing value that it holds now."""
    return max((k + 1 for k, v in enumerate(values) if v != v), default=0) + (values.maxlen or 0) - len(values)


def moving(before: deque, x: np.ndarray, n: int) -> np.ndarray:
    """Windows of n values that end at each of x, whose first ones reach back into the values before."""
    whole = np.concatenate((np.array(list(before)[len(before) - n + 1 :] if n > 1 else [], float), x))
    return np.lib.stride_tricks.sliding_window_view(whole, n)


def true_ranges(high: np.ndarray, low: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))


def true_range(high: float, low: float, before: float) -> float:
    return max(high - low, abs(high - before), abs(low - before)) if before == before else NAN


# ---------------------------------------------------------------- moving averages


def ema(n: int) -> Step:
    s = Smooth(n)
    return with_many(lambda i, x: (s.push(i, x),), lambda i, x: (s.push_many(i, x),))


def smma(n: int) -> Step:
    s = Wilder(n)
    return with_many(lambda i, x: (s.push(i, x),), lambda i, x: (s.push_many(i, x),))


def dema(n: int) -> Step:
    c = Cascade(n, 2)

    def step(i: int, x: float) -> tuple:
        e = c.push(i, x)
        return (2 * e[0] - e[1],) if e else (NAN,)

    def many(i: int, x: np.ndarray) -> tuple:
        e, _ = c.push_many(i, x)
        return (2 * e[0] - e[1],)

    return with_many(step, many)


def tema(n: int) -> Step:
    c = Cascade(n, 3)

    def step(i: int, x: float) -> tuple:
        e = c.push(i, x)
        return (3 * e[0] - 3 * e[1] + e[2],) if e else (NAN,)

    def many(i: int, x: np.ndarray) -> tuple:
        e, _ = c.push_many(i, x)
        return (3 * e[0] - 3 * e[1] + e[2],)

    return with_many(step, many)


def trix(n: int) -> Step:
    c = Cascade(n, 3)

    def step(i: int, x: float) -> tuple:
        before = c.e[2]
        e = c.push(i, x)
        if not e:
            return NAN, NAN
        if c.started:
            return NAN, NAN
        return e[2], 100 * (e[2] - before) / before if before else NAN

    def many(i: int, x: np.ndarray) -> tuple:
        last = c.e[2]
        e, start = c.push_many(i, x)
        before = np.concatenate(([last], e[2][:-1]))
        with np.errstate(all="ignore"):
            change = np.where(before != 0, 100 * (e[2] - before) / before, NAN)
        third = e[2]
        if start >= 0:
            third[start] = NAN
        return third, change

    return with_many(step, many)


def t3(n: int, volume_factor: float) -> Step:
    a, k = volume_factor, 2 / (n + 1)
    weights = (-(a**3), 3 * a**2 + 3 * a**3, -6 * a**2 - 3 * a - 3 * a**3, 1 + 3 * a + a**3 + 3 * a**2)
    e = [NAN] * 6

    def step(i: int, x: float) -> tuple:
        if e[5] != e[5]:
            e[:] = [x] * 6
        else:
            into = x
            for j in range(6):
                e[j] = into = e[j] + k * (into - e[j])
        return (weights[0] * e[5] + weights[1] * e[4] + weights[2] * e[3] + weights[3] * e[2],)

    def many(i: int, x: np.ndarray) -> tuple:
        if e[5] != e[5]:
            e[:] = [float(x[0])] * 6
        into, stages = x, []
        for j in range(6):
            into = scan(into, 1 - k, k, e[j])
            e[j] = float(into[-1])
            stages.append(into)
        return (weights[0] * stages[5] + weights[1] * stages[4] + weights[2] * stages[3] + weights[3] * stages[2],)

    return with_many(step, many)


def dynamic(n: int, k_factor: float) -> Step:
    state = [NAN, NAN]  # last value, last result

    def step(i: int, x: float) -> tuple:
        last, result = state
        base = last if result != result else result
        now = NAN
        if i > 0 and base == base:
            ratio = (x / base) ** 4 if base else NAN
            now = base + (x - base) / (k_factor * n * ratio) if ratio else NAN
        state[:] = [x, now]
        return (now,)

    def many(i: int, x: np.ndarray) -> tuple:
        last, result = state
        out, share = [], k_factor * n
        for v in x.tolist():
            base = last if result != result else result
            result = NAN
            if i and base == base and base:
                ratio = v / base
                ratio *= ratio
                ratio *= ratio
                if ratio:
                    result = base + (v - base) / (share * ratio)
            last, i = v, i + 1
            out.append(result)
        state[:] = [last, result]
        return (np.array(out),)

    return with_many(step, many)


def kama(er_periods: int, fast_periods: int, slow_periods: int) -> Step:
    values = Recent(er_periods + 1)
    fast, slow = 2 / (fast_periods + 1), 2 / (slow_periods + 1)
    state = [NAN]

    def step(i: int, x: float) -> tuple:
        values.push(x)
        if i < er_periods - 1:
            return NAN, NAN
        before = state[0]
        if before != before:
            state[0] = x
            return NAN, x
        v = values.values
        change = abs(v[-1] - v[0])
        path = sum(abs(b - a) for a, b in zip(v, list(v)[1:], strict=False))
        if path == 0:
            state[0] = x
            return 0.0, x
        ratio = change / path
        share = (ratio * (fast - slow) + slow) ** 2
        state[0] = before + share * (x - before)
        return ratio, state[0]

    def many(i: int, x: np.ndarray) -> tuple:
        n = er_periods
        out, head = by_rows(step, i, (x,), max(n + 1, i + unclean(values.values) + (state[0] != state[0])), 2)
        rest = x[head:]
        if len(rest):
            v = moving(values.values, rest, n + 1)
            change, path = np.abs(v[:, -1] - v[:, 0]), np.abs(np.diff(v, axis=1)).sum(axis=1)
            values.push_many(rest)
            with np.errstate(all="ignore"):
                ratio = np.where(path == 0, 0.0, change / path)
            shares = np.where(path == 0, 1.0, (ratio * (fast - slow) + slow) ** 2)  # where nothing moves the average is the price
            now, made = state[0], []
            for y, share in zip(rest.tolist(), shares.tolist(), strict=True):
                now = y if share == 1.0 or now != now else now + share * (y - now)
                made.append(now)
            state[0] = now
            out[:, head:] = ratio, made
        return tuple(out)

    return with_many(step, many)


class _Hilbert:
    """The phase and period measurement that two of the adaptive averages share."""

    def __init__(self) -> None:
        self.price = deque([0.0] * 4, 4)
        self.smooth, self.trend, self.quad, self.phase = (deque([0.0] * 7, 7) for _ in range(4))
        self.i2 = self.q2 = self.re = self.im = self.period = 0.0

    @staticmethod
    def _filter(d: deque, gain: float) -> float:
        return (0.0962 * d[6] + 0.5769 * d[4] - 0.5769 * d[2] - 0.0962 * d[0]) * gain

    def push(self, x: float) -> None:
        """One row whose price history is complete."""
        p = self.price
        gain = 0.075 * self.period + 0.54
        self.smooth.append((4 * x + 3 * p[-1] + 2 * p[-2] + p[-3]) / 10)
        self.trend.append(self._filter(self.smooth, gain))
        self.quad.append(self._filter(self.trend, gain))
        self.phase.append(self.trend[3])
        i2 = 0.2 * (self.phase[6] - self._filter(self.quad, gain)) + 0.8 * self.i2
        q2 = 0.2 * (self.quad[6] + self._filter(self.phase, gain)) + 0.8 * self.q2
        self.re = 0.2 * (i2 * self.i2 + q2 * self.q2) + 0.8 * self.re
        self.im = 0.2 * (i2 * self.q2 - q2 * self.i2) + 0.8 * self.im
        self.i2, self.q2 = i2, q2
        before = self.period
        now = 2 * math.pi / math.atan(self.im / self.re) if self.im and self.re else 0.0
        now = min(now, 1.5 * before) if now > 1.5 * before else now
        now = max(now, 0.67 * before) if now < 0.67 * before else now
        now = 6.0 if now < 6 else 50.0 if now > 50 else now
        self.period = 0.2 * now + 0.8 * before
        self.price.append(x)

    def quiet(self, x: float) -> None:
        """One row before the measurement starts."""
        self.price.append(x)
        for d in (self.smooth, self.trend, self.quad, self.phase):
            d.append(0.0)
        self.i2 = self.q2 = self.re = self.im = self.period = 0.0


def mama(fast_limit: float, slow_limit: float) -> Step:
    h = _Hilbert()
    first = Recent(6)
    state = [NAN, NAN, 0.0]  # both averages, phase

    def step(i: int, x: float) -> tuple:
        first.push(x)
        fast, follow, angle = state
        if i < 5 or fast != fast:
            h.quiet(x)
            if i < 5:
                return NAN, NAN
            state[:] = [first.mean(), first.mean(), 0.0]
            return state[0], state[1]
        h.push(x)
        now = math.degrees(math.atan(h.quad[6] / h.phase[6])) if h.phase[6] else 0.0
        alpha = max(fast_limit / max(angle - now, 1), slow_limit)
        fast = alpha * x + (1 - alpha) * fast
        follow = 0.5 * alpha * fast + (1 - 0.5 * alpha) * follow
        state[:] = [fast, follow, now]
        return fast, follow

    return step


def ht_trendline() -> Step:
    h = _Hilbert()
    prices = deque(maxlen=64)  # a cycle has 50 rows at most
    trend = deque([NAN] * 4, 4)
    state = [0.0]

    def step(i: int, x: float) -> tuple:
        prices.append(x)
        if i <= 5:
            h.quiet(x)
            trend.append(0.0)
            return None, x, NAN
        h.push(x)
        state[0] = 0.33 * h.period + 0.67 * state[0]
        cycle = int(state[0] + 0.5) if state[0] == state[0] else 0
        cycle = min(cycle, i + 1)
        trend.append(sum(list(prices)[-cycle:]) / cycle if cycle > 0 else x)
        line = (4 * trend[3] + 3 * trend[2] + 2 * trend[1] + trend[0]) / 10 if i >= 11 else x
        return (cycle if cycle > 0 else None), line, h.smooth[6]

    return step


# ---------------------------------------------------------------- momentum


class Rsi:
    """Relative strength: Wilder averages of gains and losses."""

    def __init__(self, n: int):
        self.n, self.last = n, NAN
        self.gains, self.losses = Recent(n), Recent(n)
        self.gain = self.loss = NAN

    def push(self, i: int, x: float) -> float:
        last, self.last = self.last, x
        change = x - last
        up = NAN if change != change else max(change, 0.0)
        down = NAN if change != change else max(-change, 0.0)
        self.gains.push(up)
        self.losses.push(down)
        if i < self.n:
            return NAN
        if self.gain != self.gain or self.loss != self.loss:
            self.gain, self.loss = self.gains.mean(), self.losses.mean()
            if self.gain != self.gain or self.loss != self.loss:
                return NAN
            if self.loss == 0:
                return 100.0 if self.gain > 0 else NAN
        else:
            self.gain = (self.gain * (self.n - 1) + up) / self.n
            self.loss = (self.loss * (self.n - 1) + down) / self.n
            if not self.loss > 0:  # a missing value counts as no loss here
                return 100.0
        return 100 - 100 / (1 + self.gain / self.loss)

    def push_many(self, i: int, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        head = 0
        while head < len(x) and not (self.gain == self.gain and self.loss == self.loss and self.last == self.last):
            out[head] = self.push(i + head, float(x[head]))
            head += 1
        rest = x[head:]
        if np.isnan(rest).any():
            out[head:] = [self.push(i + head + k, v) for k, v in enumerate(rest.tolist())]
        elif len(rest):
            change = changes(rest, self.last)
            up, down = np.maximum(change, 0.0), np.maximum(-change, 0.0)
            self.gains.push_many(up)
            self.losses.push_many(down)
            gain, loss = (scan(v, 1 - 1 / self.n, 1 / self.n, last) for v, last in ((up, self.gain), (down, self.loss)))
            self.gain, self.loss, self.last = float(gain[-1]), float(loss[-1]), float(rest[-1])
            with np.errstate(all="ignore"):
                out[head:] = np.where(loss > 0, 100 - 100 / (1 + gain / loss), 100.0)
        return out


def rsi(n: int) -> Step:
    r = Rsi(n)
    return with_many(lambda i, x: (r.push(i, x),), lambda i, x: (r.push_many(i, x),))


def connors_rsi(rsi_periods: int, streak_periods: int, rank_periods: int) -> Step:
    price, run = Rsi(rsi_periods), Rsi(streak_periods)
    gains = Recent(rank_periods + 1)
    state = [NAN, 0.0]  # last value, streak

    def step(i: int, x: float) -> tuple:
        last, streak = state
        strength = price.push(i, x)
        if i == 0:
            state[:] = [x, 0.0]
            gains.push(0.0)
            run.push(0, 0.0)
            return 0.0, NAN, NAN, NAN, NAN
        if x != x or last != last:
            streak = NAN
        elif x > last:
            streak = streak + 1 if streak >= 0 else 1.0
        elif x < last:
            streak = streak - 1 if streak <= 0 else -1.0
        else:
            streak = 0.0
        gain = (x - last) / last if x == x and last == last and last > 0 else NAN
        gains.push(gain)
        rank = NAN
        if i > rank_periods - 1 and all(g == g for g in gains.values):
            rank = float(100 * sum(g < gain for g in gains.values) // rank_periods)
        state[:] = [x, streak]
        of_run = run.push(i, streak)
        whole = NAN
        if i >= max(rsi_periods, streak_periods, rank_periods) + 1:
            whole = (strength + of_run + rank) / 3
        return streak, strength, of_run if i >= streak_periods + 2 else NAN, rank, whole

    settled = max(rsi_periods, streak_periods, rank_periods) + 2

    def many(i: int, x: np.ndarray) -> tuple:
        out, head = by_rows(step, i, (x,), settled, 5)
        if head < len(x) and not (state[0] == state[0] and state[1] == state[1]):
            return tuple(by_rows(step, i + head, (x[head:],), i + len(x), 5)[0]) if not head else tuple(np.concatenate((out[:, :head], by_rows(step, i + head, (x[head:],), i + len(x), 5)[0]), axis=1))
        rest = x[head:]
        if len(rest):
            before = np.concatenate(([state[0]], rest[:-1]))
            streak, runs = state[1], []
            for way in np.sign(rest - before).tolist():
                streak = 0.0 if way == 0 else streak + way if streak * way >= 0 else way
                runs.append(streak)
            with np.errstate(all="ignore"):
                gain = np.where(before > 0, (rest - before) / before, NAN)
            window = moving(gains.values, gain, rank_periods + 1)
            below = (window < gain[:, None]).sum(axis=1)
            rank = np.where(np.isnan(window).any(axis=1), NAN, 100 * below // rank_periods)
            gains.push_many(gain)
            state[:] = [float(rest[-1]), streak]
            strength, of_run = price.push_many(i + head, rest), run.push_many(i + head, np.array(runs))
            out[:, head:] = runs, strength, of_run, rank, (strength + of_run + rank) / 3
        return tuple(out)

    return with_many(step, many)


def macd(fast: int, slow: int, signal: int) -> Step:
    f, s = Smooth(fast), Smooth(slow)
    line = Smooth(signal, first=slow + signal - 2) if signal > 0 else None

    def step(i: int, x: float) -> tuple:
        a, b = f.push(i, x), s.push(i, x)
        m = a - b
        if line is None:
            return m, m, 0.0 * m, a, b
        g = line.push(i, m)
        return m, g, m - g, a, b

    def many(i: int, x: np.ndarray) -> tuple:
        a, b = f.push_many(i, x), s.push_many(i, x)
        m = a - b
        g = m if line is None else line.push_many(i, m)
        return m, g, m - g, a, b

    return with_many(step, many)


def pvo(fast: int, slow: int, signal: int) -> Step:
    f, s = Smooth(fast), Smooth(slow)
    line = Smooth(signal, first=slow + signal - 2) if signal > 0 else None

    def step(i: int, x: float) -> tuple:
        a, b = f.push(i, x), s.push(i, x)
        m = 100 * (a - b) / b if b else NAN
        if line is None:
            return m, m, 0.0 * m
        g = line.push(i, m)
        return m, g, m - g

    def many(i: int, x: np.ndarray) -> tuple:
        a, b = f.push_many(i, x), s.push_many(i, x)
        with np.errstate(all="ignore"):
            m = np.where(b != 0, 100 * (a - b) / b, NAN)
        g = m if line is None else line.push_many(i, m)
        return m, g, m - g

    return with_many(step, many)


def pmo(time_periods: int, smooth_periods: int, signal_periods: int) -> Step:
    first = Smooth(time_periods, 2 / time_periods, time_periods)
    second = Smooth(smooth_periods, 2 / smooth_periods, smooth_periods)
    signal = Smooth(signal_periods, first=signal_periods)
    state = [NAN]

    def step(i: int, x: float) -> tuple:
        last, state[0] = state[0], x
        change = 100 * (x / last - 1) if last else NAN
        a = first.push(i, change)
        b = second.push(i, a * 10)
        return b, signal.push(i, b)

    def many(i: int, x: np.ndarray) -> tuple:
        before = np.concatenate(([state[0]], x[:-1]))
        state[0] = float(x[-1])
        with np.errstate(all="ignore"):
            change = np.where(before != 0, 100 * (x / before - 1), NAN)
        b = second.push_many(i, first.push_many(i, change) * 10)
        return b, signal.push_many(i, b)

    return with_many(step, many)


def tsi(lookback: int, smooth: int, signal: int) -> Step:
    c1, a1 = Smooth(lookback, first=lookback), Smooth(lookback, first=lookback)
    c2, a2 = Smooth(smooth, first=smooth), Smooth(smooth, first=smooth)
    line = Smooth(signal, first=signal + 1) if signal > 1 else None
    state = [NAN]

    def step(i: int, x: float) -> tuple:
        last, state[0] = state[0], x
        change = x - last
        c, a = c2.push(i, c1.push(i, change)), a2.push(i, a1.push(i, abs(change)))
        t = 100 * (c / a) if a else NAN
        if line:
            return t, line.push(i, t)
        return t, t if signal == 1 else NAN

    def many(i: int, x: np.ndarray) -> tuple:
        change = changes(x, state[0])
        state[0] = float(x[-1])
        c, a = c2.push_many(i, c1.push_many(i, change)), a2.push_many(i, a1.push_many(i, np.abs(change)))
        with np.errstate(all="ignore"):
            t = np.where(a != 0, 100 * (c / a), NAN)
        return t, line.push_many(i, t) if line else t if signal == 1 else np.full(len(x), NAN)

    return with_many(step, many)


class Plain:
    """Exponential smoothing that starts with the first value itself."""

    def __init__(self, n: int):
        self.k, self.value = 2 / (n + 1), NAN

    def push(self, x: float) -> float:
        self.value = x if self.value != self.value else self.value + self.k * (x - self.value)
        return self.value

    def push_many(self, x: np.ndarray) -> np.ndarray:
        if np.isnan(x).any():
            return np.array([self.push(v) for v in x.tolist()])
        last = float(x[0]) if self.value != self.value else self.value
        out = scan(x, 1 - self.k, self.k, last)
        self.value = float(out[-1])
        return out


def smi(lookback: int, first: int, second: int, signal: int) -> Step:
    highs, lows = Recent(lookback), Recent(lookback)
    a1, a2, b1, b2, line = Plain(first), Plain(second), Plain(first), Plain(second), Plain(signal)

    def step(i: int, high: float, low: float, close: float) -> tuple:
        highs.push(high)
        lows.push(low)
        if i < lookback - 1:
            return NAN, NAN
        top, bottom = max(highs.values), min(lows.values)
        a = a2.push(a1.push(close - 0.5 * (top + bottom)))
        b = b2.push(b1.push(top - bottom))
        value = 100 * (a / (0.5 * b)) if b else NAN
        return value, line.push(value)

    def many(i: int, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> tuple:
        out, head = by_rows(step, i, (high, low, close), max(lookback - 1, i + max(unclean(highs.values), unclean(lows.values))), 2)
        if head < len(high):
            top, bottom = moving(highs.values, high[head:], lookback).max(axis=1), moving(lows.values, low[head:], lookback).min(axis=1)
            highs.push_many(high[head:])
            lows.push_many(low[head:])
            a = a2.push_many(a1.push_many(close[head:] - 0.5 * (top + bottom)))
            b = b2.push_many(b1.push_many(top - bottom))
            with np.errstate(all="ignore"):
                value = np.where(b != 0, 100 * (a / (0.5 * b)), NAN)
            out[:, head:] = value, line.push_many(value)
        return tuple(out)

    return with_many(step, many)


def stoch_smoothed(k_smooth: int, d_smooth: int, k_factor: float, d_factor: float) -> Step:
    """Both smoothings of a raw oscillator by Wilder's rule, and the third line."""
    state = [NAN, NAN]
    raws, lines = Recent(k_smooth), Recent(d_smooth)

    def step(i: int, raw: float) -> tuple:
        raws.push(raw)
        k, d = state
        if k_smooth == 1:
            k = raw
        elif i < k_smooth:
            k = NAN
        else:
            k = ((raws.mean() if k != k else k) * (k_smooth - 1) + raw) / k_smooth
        lines.push(k)
        if d_smooth == 1:
            d = k
        elif i < d_smooth:
            d = NAN
        else:
            d = ((lines.mean() if d != d else d) * (d_smooth - 1) + k) / d_smooth
        state[:] = [k, d]
        return k, d, k_factor * k - d_factor * d

    def many(i: int, raw: np.ndarray) -> tuple:
        head = 0
        out = np.full((3, len(raw)), NAN)
        while head < len(raw) and not (state[0] == state[0] and state[1] == state[1]):
            out[:, head] = step(i + head, float(raw[head]))
            head += 1
        rest = raw[head:]
        if len(rest):
            k = rest if k_smooth == 1 else scan(rest, 1 - 1 / k_smooth, 1 / k_smooth, state[0])
            d = k if d_smooth == 1 else scan(k, 1 - 1 / d_smooth, 1 / d_smooth, state[1])
            raws.push_many(rest)
            lines.push_many(k)
            state[:] = [float(k[-1]), float(d[-1])]
            out[:, head:] = k, d, k_factor * k - d_factor * d
        return tuple(out)

    return with_many(step, many)


def fisher(lookback: int) -> Step:
    values = deque(maxlen=lookback)
    state = [0.0, 0.0]  # transformed value, result

    def step(i: int, x: float) -> tuple:
        values.append(x)
        if i == 0:
            return 0.0, NAN
        low, high = min(values), max(values)
        t, before = state
        t = 0.66 * ((x - low) / (high - low) - 0.5) + 0.67 * t if high != low else 0.0
        t = 0.999 if t > 0.99 else -0.999 if t < -0.99 else t
        now = math.atanh(t) + 0.5 * before
        state[:] = [t, now]
        return now, before

    def many(i: int, x: np.ndarray) -> tuple:
        out, head = by_rows(step, i, (x,), max(lookback, i + unclean(values)), 2)
        rest = x[head:]
        if len(rest):
            window = moving(values, rest, lookback)
            low, high = window.min(axis=1), window.max(axis=1)
            values.extend(rest[-lookback:].tolist())
            with np.errstate(all="ignore"):
                place = np.where(high != low, 0.66 * ((rest - low) / (high - low) - 0.5), NAN)
            t, made = state[0], []
            for p in place.tolist():
                t = p + 0.67 * t if p == p else 0.0
                t = 0.999 if t > 0.99 else -0.999 if t < -0.99 else t
                made.append(t)
            line = scan(np.arctanh(np.array(made)), 0.5, 1.0, state[1])
            out[:, head:] = line, np.concatenate(([state[1]], line[:-1]))
            state[:] = [t, float(line[-1])]
        return tuple(out)

    return with_many(step, many)


# ---------------------------------------------------------------- ranges and trends


class Atr:
    """Average true range: the mean of the first n ranges, then Wilder's rule."""

    def __init__(self, n: int):
        self.smooth, self.close = Wilder(n, first=n), NAN

    def push(self, i: int, high: float, low: float, close: float) -> tuple[float, float]:
        before, self.close = self.close, close
        if i == 0:
            return NAN, NAN
        t = true_range(high, low, before)
        return t, self.smooth.push(i, t)

    def push_many(self, i: int, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = np.concatenate(([self.close], close[:-1]))
        self.close = float(close[-1])
        t = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
        if i:
            return t, self.smooth.push_many(i, t)
        t[0] = NAN  # nothing comes before row 0
        return t, np.concatenate(([NAN], self.smooth.push_many(1, t[1:])))


def atr(n: int) -> Step:
    a = Atr(n)

    def step(i: int, high: float, low: float, close: float) -> tuple:
        t, value = a.push(i, high, low, close)
        return t, value, value / close * 100 if close else NAN

    def many(i: int, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> tuple:
        t, value = a.push_many(i, high, low, close)
        with np.errstate(all="ignore"):
            return t, value, np.where(close != 0, value / close * 100, NAN)

    return with_many(step, many)


def adx(n: int) -> Step:
    state = {"high": NAN, "low": NAN, "close": NAN, "adx": NAN}
    sums, smooth = [0.0, 0.0, 0.0], [NAN, NAN, NAN]
    results: deque = deque(maxlen=n + 1)
    total = [0.0]

    def step(i: int, high: float, low: float, close: float) -> tuple:
        h, lo, c = state["high"], state["low"], state["close"]
        state.update(high=high, low=low, close=close)
        none = (NAN,) * 5
        results.append(NAN)
        if i == 0:
            return none
        up, down = high - h, lo - low
        now = (true_range(high, low, c), max(up, 0.0) if up > down else 0.0, max(down, 0.0) if down > up else 0.0)
        if i <= n:
            sums[:] = [a + b for a, b in zip(sums, now, strict=True)]
        if i < n:
            return none
        smooth[:] = sums if smooth[0] != smooth[0] else [a - a / n + b for a, b in zip(smooth, now, strict=True)]
        if smooth[0] == 0:
            return none
        plus, minus = 100 * smooth[1] / smooth[0], 100 * smooth[2] / smooth[0]
        dx = 0.0 if plus == minus else 100 * abs(plus - minus) / (plus + minus) if plus + minus else NAN
        value = rating = NAN
        if i < 2 * n:
            total[0] += dx
            if i == 2 * n - 1:
                value = state["adx"] = total[0] / n
        else:
            value = state["adx"] = (state["adx"] * (n - 1) + dx) / n
            if i - n >= 2 * n - 1:
                rating = (value + results[0]) / 2
        results[-1] = value
        return plus, minus, dx, value, rating

    def many(i: int, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> tuple:
        out, head = by_rows(step, i, (high, low, close), 3 * n, 5)
        h, lo, c = high[head:], low[head:], close[head:]
        if not len(h):
            return tuple(out)
        before = [np.concatenate(([state[x]], y[:-1])) for x, y in (("high", h), ("low", lo), ("close", c))]
        up, down = h - before[0], before[1] - lo
        now = (true_ranges(h, lo, before[2]), np.where(up > down, np.maximum(up, 0.0), 0.0), np.where(down > up, np.maximum(down, 0.0), 0.0))
        s = [scan(b, 1 - 1 / n, 1.0, a) for a, b in zip(smooth, now, strict=True)]
        if not (np.array(smooth) == np.array(smooth)).all() or not (s[0] > 0).all() or state["adx"] != state["adx"]:
            rest, _ = by_rows(step, i + head, (h, lo, c), i + len(high), 5)
            out[:, head:] = rest
            return tuple(out)
        plus, minus = 100 * s[1] / s[0], 100 * s[2] / s[0]
        with np.errstate(all="ignore"):
            dx = np.where(plus == minus, 0.0, 100 * np.abs(plus - minus) / (plus + minus))
        value = scan(dx, 1 - 1 / n, 1 / n, state["adx"])
        earlier = np.concatenate((np.array(list(results)[-n:]), value))[: len(value)]
        results.extend(value[-(n + 1) :].tolist())
        smooth[:] = [float(x[-1]) for x in s]
        state.update(high=float(h[-1]), low=float(lo[-1]), close=float(c[-1]), adx=float(value[-1]))
        out[:, head:] = plus, minus, dx, value, (value + earlier) / 2
        return tuple(out)

    return with_many(step, many)


def alligator(spans: tuple[tuple[int, int], ...]) -> Step:
    """Three shifted Wilder averages; spans: (periods, offset) of each."""
    lines = [(Wilder(n, first=n + shift - 1), deque(maxlen=shift + 1), shift) for n, shift in spans]

    def step(i: int, x: float) -> tuple:
        out = []
        for wilder, late, shift in lines:
            late.append(x)
            out.append(wilder.push(i, late[0]) if len(late) == shift + 1 else NAN)
        return tuple(out)

    def many(i: int, x: np.ndarray) -> tuple:
        out = np.full((len(lines), len(x)), NAN)
        for k, (wilder, late, shift) in enumerate(lines):
            held = list(late)[-shift:] if shift else []
            head = shift - len(held)  # rows until there is one so far back
            whole = np.concatenate((np.array(held, float), x))
            late.extend(x[-(shift + 1) :].tolist())
            if head < len(x):
                out[k, head:] = wilder.push_many(i + head, whole[: len(x) - head])
        return tuple(out)

    return with_many(step, many)


def atr_stop(n: int, multiplier: float, high_low: bool) -> Step:
    a = Atr(n)
    state = {"close": NAN, "bull": True, "upper": math.inf, "lower": -math.inf}

    def step(i: int, high: float, low: float, close: float) -> tuple:
        _, range_ = a.push(i, high, low, close)
        before, state["close"] = state["close"], close
        if i < n:
            return NAN, NAN, NAN, NAN
        top = (high if high_low else close) + multiplier * range_
        bottom = (low if high_low else close) - multiplier * range_
        if i == n:
            state["bull"] = close >= before
        if top < state["upper"] or before > state["upper"]:
            state["upper"] = top
        if bottom > state["lower"] or before < state["lower"]:
            state["lower"] = bottom
        state["bull"] = not close <= (state["lower"] if state["bull"] else state["upper"])
        stop = state["lower"] if state["bull"] else state["upper"]
        return stop, NAN if state["bull"] else stop, stop if state["bull"] else NAN, range_

    def many(i: int, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> tuple:
        out, head = by_rows(step, i, (high, low, close), n + 1, 4)
        h, lo, c = high[head:], low[head:], close[head:]
        if len(h):
            _, range_ = a.push_many(i + head, h, lo, c)
            before, bull, upper, lower = (state[x] for x in ("close", "bull", "upper", "lower"))
            stops, ways = [], []
            for top, bottom, x in zip(((h if high_low else c) + multiplier * range_).tolist(), ((lo if high_low else c) - multiplier * range_).tolist(), c.tolist(), strict=True):
                if top < upper or before > upper:
                    upper = top
                if bottom > lower or before < lower:
                    lower = bottom
                bull = not x <= (lower if bull else upper)
                before = x
                stops.append(lower if bull else upper)
                ways.append(bull)
            state.update(close=before, bull=bull, upper=upper, lower=lower)
            stop, up = np.array(stops), np.array(ways)
            out[:, head:] = stop, np.where(up, NAN, stop), np.where(up, stop, NAN), range_
        return tuple(out)

    return with_many(step, many)


def super_trend(n: int, multiplier: float) -> Step:
    a = Atr(n)
    state = {"close": NAN, "bull": True, "upper": NAN, "lower": NAN}

    def step(i: int, high: float, low: float, close: float) -> tuple:
        _, range_ = a.push(i, high, low, close)
        before, state["close"] = state["close"], close
        if i < n:
            return NAN, NAN, NAN
        mid = (high + low) / 2
        top, bottom = mid + multiplier * range_, mid - multiplier * range_
        if i == n:
            state.update(bull=close >= mid, upper=top, lower=bottom)
        if top < state["upper"] or before > state["upper"]:
            state["upper"] = top
        if bottom > state["lower"] or before < state["lower"]:
            state["lower"] = bottom
        state["bull"] = not close <= (state["lower"] if state["bull"] else state["upper"])
        if state["bull"]:
            return state["lower"], NAN, state["lower"]
        return state["upper"], state["upper"], NAN

    def many(i: int, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> tuple:
        out, head = by_rows(step, i, (high, low, close), n + 1, 3)
        h, lo, c = high[head:], low[head:], close[head:]
        if len(h):
            _, range_ = a.push_many(i + head, h, lo, c)
            before, bull, upper, lower = (state[x] for x in ("close", "bull", "upper", "lower"))
            mid, stops, ways = (h + lo) / 2, [], []
            for top, bottom, x in zip((mid + multiplier * range_).tolist(), (mid - multiplier * range_).tolist(), c.tolist(), strict=True):
                if top < upper or before > upper:
                    upper = top
                if bottom > lower or before < lower:
                    lower = bottom
                bull = not x <= (lower if bull else upper)
                before = x
                stops.append(lower if bull else upper)
                ways.append(bull)
            state.update(close=before, bull=bull, upper=upper, lower=lower)
            stop, up = np.array(stops), np.array(ways)
            out[:, head:] = stop, np.where(up, NAN, stop), np.where(up, stop, NAN)
        return tuple(out)

    return with_many(step, many)


def parabolic_sar(step_size: float, most: float, initial: float) -> Step:
    """Stops and reversals; what comes up to the first reversal is masked later."""
    s: dict = {}
    lows, highs = deque(maxlen=2), deque(maxlen=2)

    def step(i: int, high: float, low: float) -> tuple:
        if i == 0:
            s.update(rising=True, factor=initial, extreme=high, stop=low)
            lows.append(low)
            highs.append(high)
            return NAN, None
        sign = 1 if s["rising"] else -1
        stop = s["stop"] + s["factor"] * (s["extreme"] - s["stop"])
        if i >= 2:
            stop = min(stop, *lows) if sign > 0 else max(stop, *highs)
        near, far = (low, high) if sign > 0 else (high, low)
        turned = sign * near < sign * stop
        if turned:
            stop = s["extreme"]
            s.update(rising=not s["rising"], factor=initial, extreme=near)
        elif sign * far > sign * s["extreme"]:
            s.update(extreme=far, factor=min(s["factor"] + step_size, most))
        s["stop"] = stop
        lows.append(low)
        highs.append(high)
        return stop, turned

    def many(i: int, high: np.ndarray, low: np.ndarray) -> tuple:
        out, head = by_rows(step, i, (high, low), 2, 2)
        stops, turns = out[0, :head].tolist(), [None if i + k == 0 else bool(out[1, k]) for k in range(head)]
        if head < len(high):
            rising, factor, extreme, stop = (s[x] for x in ("rising", "factor", "extreme", "stop"))
            (l2, l1), (h2, h1) = lows, highs
            for hi, lo in zip(high[head:].tolist(), low[head:].tolist(), strict=True):
                stop += factor * (extreme - stop)
                if rising:
                    stop = min(stop, l2, l1)
                    turned = lo < stop
                    if turned:
                        stop, extreme = extreme, lo
                    elif hi > extreme:
                        extreme, factor = hi, min(factor + step_size, most)
                else:
                    stop = max(stop, h2, h1)
                    turned = hi > stop
                    if turned:
                        stop, extreme = extreme, hi
                    elif lo < extreme:
                        extreme, factor = lo, min(factor + step_size, most)
                if turned:
                    rising, factor = not rising, initial
                l2, l1, h2, h1 = l1, lo, h1, hi
                stops.append(stop)
                turns.append(turned)
            s.update(rising=rising, factor=factor, extreme=extreme, stop=stop)
            lows.extend((l2, l1))
            highs.extend((h2, h1))
        return np.array(stops), turns

    return with_many(step, many)


def volatility_stop(n: int, multiplier: float) -> Step:
    """Stops from row n on; `start` tells whether row n - 1 lies above row 0."""
    a = Atr(n)
    s: dict = {"range": NAN}
    firsts: list[float] = []

    def step(i: int, high: float, low: float, close: float) -> tuple:
        before = s["range"]
        _, s["range"] = a.push(i, high, low, close)
        if i < n:
            firsts.append(close)
            if i == n - 1:
                s["long"] = close > firsts[0]
                s["peak"] = max(firsts) if s["long"] else min(firsts)
            return NAN, None, NAN, NAN
        up = s["long"]
        stop = s["peak"] - multiplier * before if up else s["peak"] + multiplier * before
        hit = close < stop if up else close > stop
        s["peak"] = close if hit else max(s["peak"], close) if up else min(s["peak"], close)
        if hit:
            s["long"] = not up
        return stop, hit, NAN if up else stop, stop if up else NAN

    def many(i: int, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> tuple:
        out, head = by_rows(step, i, (high, low, close), n + 1, 4)
        hits = [None if i + k < n else bool(out[1, k]) for k in range(head)]
        h, lo, c = high[head:], low[head:], close[head:]
        if len(h):
            _, range_ = a.push_many(i + head, h, lo, c)
            width = multiplier * np.concatenate(([s["range"]], range_[:-1]))
            up, peak, stops, ways = s["long"], s["peak"], [], []
            for x, w in zip(c.tolist(), width.tolist(), strict=True):
                stop = peak - w if up else peak + w
                hit = x < stop if up else x > stop
                stops.append(stop)
                ways.append(up)
                hits.append(hit)
                peak = x if hit else max(peak, x) if up else min(peak, x)
                if hit:
                    up = not up
            s.update(long=up, peak=peak, range=float(range_[-1]))
            stop, was_up = np.array(stops), np.array(ways)
            out[0, head:], out[2, head:], out[3, head:] = stop, np.where(was_up, NAN, stop), np.where(was_up, stop, NAN)
        return out[0], hits, out[2], out[3]

    return with_many(step, many)


def heikin_ashi() -> Step:
    state = [NAN, NAN]

    def step(i: int, open_: float, high: float, low: float, close: float, volume: float) -> tuple:
        c = (open_ + high + low + close) / 4
        o = (open_ + close) / 2 if i == 0 else (state[0] + state[1]) / 2
        state[:] = [o, c]
        known = o == o and c == c
        return o, max(high, o, c) if known else NAN, min(low, o, c) if known else NAN, c, volume

    def many(i: int, open_: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> tuple:
        out, head = by_rows(step, i, (open_, high, low, close, volume), 1, 5)
        if head < len(high):
            c = (open_[head:] + high[head:] + low[head:] + close[head:]) / 4
            o = scan(np.concatenate(([state[1]], c[:-1])), 0.5, 0.5, state[0])
            state[:] = [float(o[-1]), float(c[-1])]
            out[:, head:] = o, np.maximum(high[head:], np.maximum(o, c)), np.minimum(low[head:], np.minimum(o, c)), c, volume[head:]
        return tuple(out)

    return with_many(step, many)


# ---------------------------------------------------------------- volume


def force_index(n: int) -> Step:
    s = Smooth(n, first=n)
    state = [NAN]

    def step(i: int, close: float, volume: float) -> tuple:
        last, state[0] = state[0], close
        return (s.push(i, volume * (close - last)),)

    def many(i: int, close: np.ndarray, volume: np.ndarray) -> tuple:
        change = changes(close, state[0])
        state[0] = float(close[-1])
        return (s.push_many(i, volume * change),)

    return with_many(step, many)


def kvo(fast: int, slow: int, signal: int) -> Step:
    f, s = Smooth(fast, first=fast + 1), Smooth(slow, first=slow + 1)
    line = Smooth(signal, first=slow + signal)
    z = {"basis": NAN, "trend": 0, "range": NAN, "sum": 0.0, "force": 0.0}

    def step(i: int, high: float, low: float, close: float, volume: float) -> tuple:
        last = dict(z)
        z["basis"], z["range"] = high + low + close, high - low
        if i == 0:
            return NAN, NAN
        z["trend"] = 1 if z["basis"] > last["basis"] else -1
        if i == 1:
            z["sum"] = 0.0
            return NAN, NAN
        z["sum"] = (last["sum"] if z["trend"] == last["trend"] else last["range"]) + z["range"]
        if z["range"] == z["sum"] or volume == 0:
            z["force"] = 0.0
        elif z["range"] == 0:
            z["force"] = volume * 2 * z["trend"] * 100
        elif z["sum"] != 0:
            z["force"] = volume * abs(2 * (z["range"] / z["sum"] - 1)) * z["trend"] * 100
        k = f.push(i, z["force"]) - s.push(i, z["force"])
        if i < slow + 1:
            return NAN, NAN
        return k, line.push(i, k)

    def many(i: int, high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> tuple:
        out, head = by_rows(step, i, (high, low, close, volume), slow + 1, 2)
        if head < len(high):
            basis, span = (high + low + close)[head:], (high - low)[head:]
            up = basis > np.concatenate(([z["basis"]], basis[:-1]))
            trend, before, total, force, made = z["trend"], z["range"], z["sum"], z["force"], []
            for rises, r, v in zip(up.tolist(), span.tolist(), volume[head:].tolist(), strict=True):
                way = 1 if rises else -1
                total = (total if way == trend else before) + r
                trend, before = way, r
                if r == total or v == 0:
                    force = 0.0
                elif r == 0:
                    force = v * 2 * way * 100
                elif total != 0:
                    force = v * abs(2 * (r / total - 1)) * way * 100
                made.append(force)
            z.update(basis=float(basis[-1]), trend=trend, range=before, sum=total, force=force)
            forces = np.array(made)
            k = f.push_many(i + head, forces) - s.push_many(i + head, forces)
            out[:, head:] = k, line.push_many(i + head, k)
        return tuple(out)

    return with_many(step, many)


def averages(fast: int, slow: int) -> Step:
    """Two exponential averages and their difference."""
    f, s = Smooth(fast), Smooth(slow)

    def step(i: int, x: float) -> tuple:
        a, b = f.push(i, x), s.push(i, x)
        return a - b, a, b

    def many(i: int, x: np.ndarray) -> tuple:
        a, b = f.push_many(i, x), s.push_many(i, x)
        return a - b, a, b

    return with_many(step, many)


# ---------------------------------------------------------------- streaks of a whole window


def hurst_sets(n: int) -> list[tuple[int, int, float]]:
    """(parts, rows in a part, what the corrected form adds) for each way to cut n rows."""
    out = []
    parts = 1
    while parts <= 32 and n // parts >= 8:
        size = n // parts
        inner = sum(math.sqrt((size - j) / j) for j in range(1, size))
        gamma = math.exp(math.lgamma((size - 1) / 2) - 0.5 * math.log(math.pi) - math.lgamma(size / 2)) if size <= 340 else math.sqrt(2 / (math.pi * (size - 1)))
        out.append((parts, size, math.sqrt(math.pi * size / 2) - gamma * inner))
        parts *= 2
    return out


def hurst(n: int) -> Step:
    sets = hurst_sets(n)
    sizes = np.log10([s[1] for s in sets])
    spread = sizes - sizes.mean()
    values = Recent(n + 1)

    def slope(y: np.ndarray) -> np.ndarray:
        """Slopes over the sets, of rows (windows, sets)."""
        return (y - y.mean(axis=1, keepdims=True)) @ spread / (spread**2).sum() if len(sets) > 1 else np.full(len(y), NAN)

    def measure(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both exponents of windows of n + 1 values."""
        with np.errstate(all="ignore"):
            r = np.where((v[:, :-1] > 0) & (v[:, 1:] > 0), np.log(v[:, 1:] / v[:, :-1]), np.nan)
            raw, corrected = [], []
            for parts, size, extra in sets:
                block = r[:, n - parts * size :].reshape(len(v), parts, size)
                dev = block - block.mean(axis=2, keepdims=True)
                run = dev.cumsum(axis=2)
                s = np.sqrt((dev**2).mean(axis=2))
                rs = np.where(s != 0, (run.max(axis=2) - run.min(axis=2)) / s, np.nan).mean(axis=1)
                raw.append(np.where(rs > 0, np.log10(rs), np.nan))
                corrected.append(np.where(rs + extra > 0, np.log10(rs + extra), np.nan))
        return slope(np.stack(raw, axis=1)), slope(np.stack(corrected, axis=1))

    def step(i: int, x: float) -> tuple:
        values.push(x)
        if i < n:
            return NAN, NAN
        raw, corrected = measure(np.array(values.values)[None, :])
        return float(raw[0]), float(corrected[0])

    def many(i: int, x: np.ndarray) -> tuple:
        whole = np.concatenate((np.array(values.values)[-n:], x)) if values.values else x
        values.push_many(x)
        out = np.full((2, len(x)), NAN)
        if len(whole) > n:
            windows = np.lib.stride_tricks.sliding_window_view(whole, n + 1)
            for k in range(0, len(windows), 512):  # a few MB at a time
                end = len(x) - len(windows) + k
                made = measure(windows[k : k + 512])
                out[:, end : end + len(made[0])] = made
        return out[0], out[1]

    return with_many(step, many)
