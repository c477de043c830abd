"""Steps for ``fold.ordered_fold`` and their streaming twins.

Each class holds the state of one key and consumes one row at a time.  Missing
values arrive as NaN or None and leave the state unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame

import numpy as np

from strandline.operators.fold import ordered_fold, recent


def sgn(x: float) -> float:
    return 1.0 if x > 0 else -1.0 if x < 0 else 0.0


def missing(x) -> bool:
    return x is None or x != x


def surprise(p: float) -> float:
    """The part of an entropy in bits that a probability adds."""
    return -p * math.log2(p) if p > 0.0 else 0.0


class Ewma:
    """s_t = a x_t + (1 - a) s_{t-1} with a = 2 / (span + 1), started at the first value."""

    def __init__(self, span: float):
        self.a, self.s = 2.0 / (span + 1.0), None

    def row(self, x):
        if missing(x):
            return (self.s,)
        self.s = x if self.s is None else self.a * x + (1.0 - self.a) * self.s
        return (self.s,)


def ewma(df: DataFrame, col: str, span: float, keys=("series_id",)) -> DataFrame:
    return ordered_fold(df, lambda k: Ewma(span), [col], "ewma double", keys)


class BiasLearning:
    """Correct a rolling sign forecast by the mean of its own recent errors."""

    def __init__(self, n: int, memory: int, gamma: float = -1.0, binary: bool = False):
        self.n, self.memory, self.gamma, self.binary = n, memory, gamma, binary
        self.past, self.own, self.sum_ex, self.count = [], [], 0.0, 0

    def row(self, r):
        if missing(r):
            return None
        y = sgn(r) if self.binary else r
        out = None
        if len(self.past) == self.n:
            plain = sgn(sum(self.past) / self.n)
            if self.count == 0:
                learned, own_error = plain, 0.0
            else:
                if self.count <= self.memory:
                    bias = self.sum_ex / self.count
                else:
                    bias = sum(self.own) / len(self.own)
                learned = sgn(plain + self.gamma * bias)
                own_error = y - learned
            self.sum_ex += y - plain
            self.count += 1
            recent(self.own, self.memory - 1)
            self.own.append(own_error)
            out = (plain, learned, r * plain, r * learned)
        recent(self.past, self.n - 1)
        self.past.append(y)
        return out


def bias_learning(df: DataFrame, ret: str, n: int, memory: int, binary: bool = False, keys=("series_id",)) -> DataFrame:
    return ordered_fold(df, lambda k: BiasLearning(n, memory, binary=binary), [ret], "plain double, learned double, strategy_plain double, strategy double", keys)


class ProbabilityUpdating:
    """Error-driven update of the chance of a gain, restarted at the rolling share when it leaves (0, 1)."""

    def __init__(self, n: int | None, threshold: float, short: float = -1.0, warmup: int = 13):
        self.n, self.threshold, self.short = n, threshold, short
        self.warmup = n or warmup
        self.past, self.total, self.seen, self.pi, self.pending = [], 0.0, 0, None, None

    def _pick(self, on: bool) -> float:
        return 1.0 if on else self.short

    def row(self, r):
        if missing(r):
            return None
        out = None
        if self.pending is not None:
            bench, updated = self.pending
            both = (1.0 if bench >= self.threshold and updated > self.threshold else 0.0) + (
                self.short if bench <= self.threshold or updated < self.threshold else 0.0
            )
            signals = (self._pick(bench >= self.threshold), self._pick(updated >= self.threshold), self._pick(updated >= bench), both)
            out = (bench, updated, *[r * s for s in signals])
        up = 1.0 if r > 0 else 0.0
        self.pending = None
        if self.seen >= self.warmup:
            share = self.total / (len(self.past) if self.n else self.seen)
            pi = share if self.pi is None else self.pi
            if 0.0 < pi < 1.0:
                shift = -0.5 if self.past[-1] > 0 else 0.5
                gain = 0.5 * (pi + shift) * (1.0 / (pi - 1.0) + 1.0 / pi)
                new = pi + gain * (up - pi - 0.5)
            else:
                new = share  # the gain is undefined at the bounds
            if not 0.0 <= new <= 1.0:
                new = share
            self.pi = new
            self.pending = (share, new)
        self.past.append(up)
        self.total += up
        self.seen += 1
        if len(self.past) > (self.n or 1):
            gone = self.past.pop(0)
            if self.n:
                self.total -= gone
        return out


def probability_updating(df: DataFrame, ret: str, n: int | None, threshold: float, short: float = -1.0, keys=("series_id",)) -> DataFrame:
    out = "benchmark double, probability double, bench double, sp1 double, sp2 double, sp3 double"
    return ordered_fold(df, lambda k: ProbabilityUpdating(n, threshold, short), [ret], out, keys)


class _Adaptive:
    """Adaptive and classical learning of one loss probability."""

    def __init__(self):
        self.adt = self.std = 0.5
        self.gamma = 0.1
        self.last = None  # previous (classical) error
        self.a = self.b = self.c = 0.0

    def update(self, loss: float, share: float, i: int):
        e = loss - self.adt
        bottom = share + e * e
        alpha = e * e / bottom if bottom > 0 else 1.0
        alpha2 = alpha * alpha / (2 * alpha * alpha - 2 * alpha + 1)
        self.adt = alpha2 * share + (1 - alpha2) * e * e
        es, ea = loss - self.std, loss - share
        if self.last is not None:
            self.a += es * self.last
            self.b += ea * self.last
            self.c += self.last * self.last
        self.last = es
        if i > 10:
            c = self.c if self.c != 0 else i - 1.0
            self.gamma = (self.a - self.b) / c
        self.std = share + self.gamma * es
        return self.adt, self.std


class AdaptiveProbability:
    """Expanding and rolling means and loss probabilities, plain, adaptive and classical, as trading signs."""

    NAMES = ("me", "mr", "pe_avg", "pr_avg", "pe_avg_b", "pr_avg_b", "pe_adt", "pr_adt", "pe_adt_b", "pr_adt_b", "pe_std", "pr_std", "pe_std_b", "pr_std_b")

    def __init__(self, n: int):
        self.n, self.i, self.sum, self.losses = n, 0, 0.0, 0
        self.past: list[float] = []
        self.e, self.r = _Adaptive(), _Adaptive()

    def row(self, f):
        if missing(f):
            return None
        out = None
        if self.i >= self.n:
            loss = 1.0 if self.past[-1] <= 0 else 0.0
            pe = self.losses / self.i
            pr = sum(1 for v in self.past if v <= 0) / self.n
            me, mr = self.sum / self.i, sum(self.past) / self.n
            ea, es = self.e.update(loss, pe, self.i)
            ra, rs = self.r.update(loss, pr, self.i)
            signals = [me, mr]
            for p_e, p_r in ((pe, pr), (ea, ra), (es, rs)):
                signals += [1 - 2 * p_e, 1 - 2 * p_r, me * (1 - 2 * p_e), mr * (1 - 2 * p_r)]
            out = tuple(f * sgn(s) for s in signals)
        self.i += 1
        self.sum += f
        self.losses += f <= 0
        recent(self.past, self.n - 1)
        self.past.append(f)
        return out


def adaptive_probability(df: DataFrame, ret: str, keys=("series_id", "n"), n: str = "n") -> DataFrame:
    """The window length is a key column, so a sweep is one fold per (series, n)."""
    return ordered_fold(df, lambda k: AdaptiveProbability(int(k[n])), [ret], ", ".join(f"{c} double" for c in AdaptiveProbability.NAMES), keys)


class Switching:
    """Follow or oppose the rolling mean, changing sides on the wealth of the last two rows."""

    def __init__(self, n: int, delay: int = 0):
        self.n, self.delay, self.side = n, delay, 1
        self.past: list[float] = []
        self.done: list[tuple[float, float]] = []

    def row(self, r):
        if missing(r):
            return None
        out = None
        if len(self.past) == self.n + self.delay:
            trade = self.side * (1.0 if sum(self.past[: self.n]) > 0 else -1.0)
            own, hold = 1.0, 1.0
            for h, s in self.done:
                hold, own = hold * (1 + h), own * (1 + s)
            if (hold > own and trade > 0) or (hold < own and trade < 0):
                self.side = -self.side
            recent(self.done, 1)
            self.done.append((r, r * trade))
            out = (trade, r * trade)
        recent(self.past, self.n + self.delay - 1)
        self.past.append(r)
        return out


def switching(df: DataFrame, ret: str, keys=("series_id", "n", "delay")) -> DataFrame:
    return ordered_fold(df, lambda k: Switching(int(k["n"]), int(k["delay"])), [ret], "trade double, strategy double", keys)


class PositionMachine:
    """One position at a time with stop loss, take profit, reversal and proportional cost."""

    def __init__(self, capital: float = 10_000.0, size: float = 0.5, stop: float = 0.02, take: float = 0.04, cost: float = 0.0001):
        self.capital, self.size, self.stop, self.take, self.cost = capital, size, stop, take, cost
        self.position, self.entry, self.value = 0, 0.0, 0.0

    def _close(self) -> float:
        fee = self.value * self.cost
        self.position, self.entry, self.value = 0, 0.0, 0.0
        return fee

    def _open(self, side: int, price: float) -> float:
        self.position, self.entry, self.value = side, price, self.capital * self.size
        return self.value * self.cost

    def row(self, price, ret, signal):
        if missing(price) or missing(ret):
            return None
        side_wanted = 0 if missing(signal) else int(signal)
        action, pnl, fees = "HOLD", 0.0, 0.0
        if self.position:
            long = self.position > 0
            # gain of the open position since entry, in its own direction
            gain = price / self.entry - 1 if long else self.entry / price - 1
            side = "LONG" if long else "SHORT"
            lost = price <= self.entry * (1 - self.stop) if long else price >= self.entry * (1 + self.stop)
            won = price >= self.entry * (1 + self.take) if long else price <= self.entry * (1 - self.take)
            if lost or won:
                action = ("STOP_LOSS_" if lost else "TAKE_PROFIT_") + side
                pnl = self.value * gain
                fees += self._close()
            else:
                pnl = self.value * ret * self.position
        self.capital += pnl
        if self.position == 0 and side_wanted:
            action = "BUY" if side_wanted > 0 else "SELL"
            fees += self._open(side_wanted, price)
        elif self.position and side_wanted == 0:
            action = "FLAT"
            fees += self._close()
        elif self.position and side_wanted != self.position:
            action = "REVERSE"
            fees += self._close()
            fees += self._open(side_wanted, price)
        self.capital -= fees
        return (self.position, action, pnl, fees, self.capital)


class PositionReturns(PositionMachine):
    """The same machine, giving each row's return on capital after cost."""

    def row(self, price, ret, signal):
        before = self.capital
        made = super().row(price, ret, signal)
        return None if made is None else self.capital / before - 1.0


TRADES = "position int, action string, pnl double, cost double, capital double"


def position_machine(df: DataFrame, price: str, ret: str, signal: str, keys=("series_id",), **params) -> DataFrame:
    """``stop``, ``take`` and ``size`` may be key columns (a sweep) or keyword arguments."""
    swept = [p for p in ("stop", "take", "size") if p in keys]
    return ordered_fold(df, lambda k: PositionMachine(**{**params, **{p: float(k[p]) for p in swept}}), [price, ret, signal], TRADES, keys)


class Ledger:
    """Cash and shares: buy a share of the cash or sell a share of the holding."""

    def __init__(self, cash: float = 10_000.0, cost: float = 0.001):
        self.cash, self.shares, self.cost = cash, 0.0, cost

    def row(self, price, action, amount):
        traded = fee = 0.0
        if not missing(price) and action == "BUY" and self.cash > 0:
            spend = min(self.cash * amount, self.cash)
            traded, fee = spend / price, spend * self.cost
            self.shares += traded
            self.cash -= spend + fee
        elif not missing(price) and action == "SELL" and self.shares > 0:
            sold = min(self.shares * amount, self.shares)
            traded, fee = -sold, sold * price * self.cost
            self.shares -= sold
            self.cash += sold * price - fee
        return (traded, fee, self.cash, self.shares, self.cash + self.shares * (0.0 if missing(price) else price))


def ledger(df: DataFrame, price: str, action: str, amount: str, keys=("series_id",), **params) -> DataFrame:
    return ordered_fold(df, lambda k: Ledger(**params), [price, action, amount], "traded double, fee double, cash double, shares double, wealth double", keys)


class CapitalRule:
    """Capital that takes profit after a quick rise, adds funds after falls and sells short after rises."""

    def __init__(self, capital: float = 1000.0, add: float = 0.5, take: float = 0.25, rise: float = 0.06):
        self.start = self.k = capital
        self.add, self.take, self.rise = add, take, rise
        self.wealth: list[float] = [capital]
        self.prior = None

    def row(self, r, fast, slow):
        if missing(r):
            return None
        added = taken = 0.0
        if self.prior is not None:
            f, s = self.prior
            if len(self.wealth) > 4 and self.wealth[-1] / self.wealth[-4] - 1 >= self.rise and self.k > 0:
                taken = self.take * self.k
                self.k -= taken
            profit = self.k - self.start
            growth = 1.0 + r
            if f < -0.03 or s < -0.1:
                if profit > 0:
                    added = profit * self.add
                    self.k = (self.k + added) * growth
                else:
                    self.k *= growth
            elif f > 0.03 and s > 0.1 and profit > 0:
                self.k *= 1.0 - self.add * r
            else:
                self.k *= growth
            self.wealth.append(self.k)
            recent(self.wealth, 5)
        self.prior = (0.0 if missing(fast) else fast, 0.0 if missing(slow) else slow)
        return (self.k, added, taken)


def capital_rule(df: DataFrame, ret: str, fast: str, slow: str, keys=("series_id",), **params) -> DataFrame:
    return ordered_fold(df, lambda k: CapitalRule(**params), [ret, fast, slow], "capital double, added double, taken double", keys)


def template_entropy(x: list[float], m: int = 2, tolerance: float = 0.2) -> float | None:
    """Sample entropy of a short history: a constant one gives 0, one without matches None."""
    values = np.array(x)
    sd = float(values.std())
    if len(values) < 2 or sd <= 1e-8:
        return 0.0
    starts = len(values) - m
    if starts < 2:
        return None
    templates = np.stack([values[k : k + starts] for k in range(m + 1)], axis=1)
    gaps = np.abs(templates[:, None, :] - templates[None, :, :])
    close = gaps < max(tolerance * sd, 1e-9)
    pairs = np.triu(np.ones((starts, starts), dtype=bool), 1)
    short, long = (int((close[:, :, :k].all(axis=2) & pairs).sum()) for k in (m, m + 1))
    return -math.log(long / short) if long else None


def template_entropies(windows: np.ndarray, m: int = 2, tolerance: float = 0.2) -> np.ndarray:
    """``template_entropy`` of each row, NaN for None."""
    sd = windows.std(axis=1)
    starts = windows.shape[1] - m
    out = np.full(len(windows), np.nan)
    if starts >= 2:
        limit = np.maximum(tolerance * sd, 1e-9)
        short, long = np.zeros(len(windows), int), np.zeros(len(windows), int)
        for i in range(starts):
            for j in range(i + 1, starts):
                close = [np.abs(windows[:, i + k] - windows[:, j + k]) < limit for k in range(m + 1)]
                alike = np.logical_and.reduce(close[:m])
                short += alike
                long += alike & close[m]
        for a, b in np.unique(np.stack((short, long))[:, long > 0], axis=1).T.tolist():
            out[(short == a) & (long == b)] = -math.log(b / a)
    out[(sd <= 1e-8) | (windows.shape[1] < 2)] = 0.0
    return out


class OnlineKernel:
    """One-step forecast from constant, linear and quadratic kernels, trained by gradient steps with decay."""

    def __init__(self, memory: int = 5, rate: float = 0.01, decay: float = 0.001, normalise: bool = True):
        self.m, self.rate, self.decay, self.normalise = memory, rate, decay, normalise
        self.h0, self.h1, self.h2 = 0.0, np.zeros(memory), np.zeros((memory, memory))
        self.x: list[float] = []
        self.predicted = 0.0

    def row(self, r):
        if missing(r):
            return None
        before = list(self.x)
        ready = len(before) == self.m
        recent(self.x, self.m - 1)
        self.x.append(float(r))
        if not ready:
            return None
        now, old = np.array(self.x), np.array(before)
        mu, sd = 0.0, 1.0
        if self.normalise:
            mu, sd = float(now.mean()), float(now.std()) or 1e-6
            now, old = (now - mu) / sd, (old - mu) / sd
        error = (r - mu) / sd - self.predicted
        keep = 1.0 - self.rate * self.decay
        self.h0 = keep * self.h0 + self.rate * error
        self.h1 = keep * self.h1 + self.rate * error * old
        self.h2 = keep * self.h2 + self.rate * error * np.outer(old, old)
        self.predicted = float(self.h0 + self.h1 @ now + now @ self.h2 @ now)
        forecast = self.predicted * sd + mu
        return (forecast, sgn(forecast), float(error), template_entropy(self.x))

    def rows(self, r: np.ndarray, most: int = 4096) -> tuple[np.ndarray, list[np.ndarray]]:
        """``row`` over many values: places of those that give a result, and the results' columns.

        All that does not depend on the last forecast is taken for ``most`` values at once; what
        remains for each is the update of the kernels. A null entropy is NaN.
        """
        r = np.asarray(r, dtype=float)
        at = np.flatnonzero(~np.isnan(r))
        ready = at[max(0, self.m - len(self.x)) :]
        made = [self._block(r[at[k : k + most]]) for k in range(0, len(at), most)]
        return ready, [np.concatenate(c) for c in zip(*made, strict=True)] if len(ready) else []

    def _block(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        m, x = self.m, np.concatenate((self.x, r))
        self.x = x[-m:].tolist()
        n = max(0, len(x) - m)
        if not n:
            return (np.zeros(0),) * 4
        windows = np.lib.stride_tricks.sliding_window_view(x, m)
        now, old = np.ascontiguousarray(windows[1:]), np.ascontiguousarray(windows[:-1])
        entropy = template_entropies(now)
        mu, sd = np.zeros(n), np.ones(n)
        if self.normalise:
            mu, sd = now.mean(axis=1), now.std(axis=1)
            sd[sd == 0] = 1e-6
            now, old = (now - mu[:, None]) / sd[:, None], (old - mu[:, None]) / sd[:, None]
        terms = np.concatenate((np.ones((n, 1)), old, (old[:, :, None] * old[:, None, :]).reshape(n, m * m)), axis=1)
        weights = np.concatenate(([self.h0], self.h1, self.h2.ravel()))
        linear, square = weights[1 : m + 1], weights[m + 1 :].reshape(m, m)
        predicted, keep, rate = self.predicted, 1.0 - self.rate * self.decay, self.rate
        errors, forecasts = [], []
        for target, values, term in zip(now[:, -1].tolist(), now, terms):
            error = target - predicted
            weights *= keep
            term *= rate * error
            weights += term
            predicted = float(weights[0] + linear @ values + values @ square @ values)
            errors.append(error)
            forecasts.append(predicted)
        self.h0, self.h1, self.h2, self.predicted = float(weights[0]), linear.copy(), square.copy(), predicted
        forecast = np.array(forecasts) * sd + mu
        return forecast, np.where(forecast > 0, 1.0, np.where(forecast < 0, -1.0, 0.0)), np.array(errors), entropy


KERNEL = "forecast double, signal double, error double, entropy double"


def online_kernel(df: DataFrame, ret: str, keys=("series_id",), **params) -> DataFrame:
    return ordered_fold(df, lambda k: OnlineKernel(**params), [ret], KERNEL, keys)


class AdaptiveMean:
    """Rolling and expanding mean plus a correction from the sign pattern of its own errors."""

    def __init__(self, n: int, gamma: float):
        self.n, self.gamma, self.i = n, gamma, 0
        self.x: list[float] = []
        self.hits: list[float] = []  # error indicators of the rolling form
        self.sum = 0.0
        # expanding form: hits so far, sum of the values that were hits, last hit
        self.count, self.hit_sum, self.last = 0.0, 0.0, 0.0

    def _forecast(self, m: int, total: float, hits: float, hit_sum: float, last: float) -> float:
        """From m values and their sum, the number of hits, the sum of values at hits, the last hit.

        Hits are 0 or 1 (0 before the first forecast), so these sums hold all that the slope of
        the values on the hits needs.
        """
        mean, share = total / m, hits / m
        v = hits * (1.0 - share)
        c = hit_sum - share * total
        if v <= 0 or c == 0:
            return mean
        factor = self.gamma ** math.log(self.i) if c > 0 else (1.0 / self.gamma) ** math.log(self.i)
        # the slope is taken positive, so its sign adds nothing
        return mean + factor * 2.0 * abs(c) / v * (last - share)

    def row(self, y):
        if missing(y):
            return None
        out = None
        if self.i >= self.n:
            roll = self.x[-self.n :]
            m_roll, m_exp = sum(roll) / self.n, self.sum / self.i
            if self.i > self.n + 2:
                own = ([0.0] * self.n + self.hits)[-self.n :]
                f_roll = self._forecast(self.n, sum(roll), sum(own), sum(a * b for a, b in zip(roll, own)), own[-1])
                f_exp = self._forecast(self.i, self.sum, self.count, self.hit_sum, self.last)
            else:
                f_roll, f_exp = m_roll, m_exp
            recent(self.hits, self.n - 1)
            self.hits.append(1.0 if y - f_roll > 0 else 0.0)
            self.last = 1.0 if y - f_exp > 0 else 0.0
            self.count += self.last
            self.hit_sum += self.last * y
            out = (m_roll, f_roll, m_exp, f_exp)
        recent(self.x, self.n - 1)
        self.x.append(float(y))
        self.sum += y
        self.i += 1
        return out


def adaptive_mean(df: DataFrame, col: str, n: int, keys=("series_id", "gamma")) -> DataFrame:
    """Running sums carry the expanding form, so the state is one window long for any series."""
    out = "mean_rolling double, adaptive_rolling double, mean_expanding double, adaptive_expanding double"
    return ordered_fold(df, lambda k: AdaptiveMean(n, float(k["gamma"])), [col], out, keys)


class NeighbourSignal:
    """At each origin, mean over the nearest past values of the span mean that starts at them."""

    def __init__(self, share: float = 1.0, span: float = 1.0, warmup: int = 3, lookback: int | None = None):
        self.share, self.span, self.warmup, self.lookback = share, span, warmup, lookback
        self.x: list[float] = []

    def row(self, r):
        if missing(r):
            return None
        out = None
        if len(self.x) >= self.warmup:
            x = np.array(self.x)
            n = len(x)
            d = np.abs(x[:-1] - x[-1])
            near = np.argsort(d, kind="stable")[: int((n - 1) * self.share)]
            run = np.concatenate([[0.0], np.cumsum(x)])
            end = np.minimum(near + int(n * self.span), n)
            ok = end > near
            if ok.any():
                f = float(((run[end[ok]] - run[near[ok]]) / (end[ok] - near[ok])).mean())
                out = (f, r * sgn(f))
        self.x.append(float(r))
        if self.lookback:
            recent(self.x, self.lookback)
        return out


def neighbour_signal(df: DataFrame, ret: str, keys=("series_id",), **params) -> DataFrame:
    """All past bars of a series are the candidates; give ``lookback`` to bound the state of long series."""
    return ordered_fold(df, lambda k: NeighbourSignal(**params), [ret], "forecast double, strategy double", keys)


class AdaptiveWeights:
    """Combine model forecasts with weights moved toward models that did better over the last rows."""

    def __init__(self, models: int, rate: float = 0.1, window: int = 20, binary: bool = False, threshold: float = 0.0):
        self.w = np.full(models, 1.0 / models)
        self.binary, self.threshold = binary, threshold
        self.rate, self.window = rate, window
        self.own: list[float] = []
        self.each: list[np.ndarray] = []

    def row(self, actual, forecasts):
        if missing(actual) or forecasts is None or all(missing(f) for f in forecasts):
            return None
        f = np.array([np.nan if missing(x) else x for x in forecasts], dtype=float)
        there = np.isfinite(f)
        total = float(self.w[there].sum())
        combined = float(self.w[there] @ f[there] / total) if total > 0 else float(f[there].mean())
        if self.binary:
            combined = 1.0 if combined >= self.threshold else -1.0
        used = self.w.tolist()
        recent(self.own, self.window - 1)
        recent(self.each, self.window - 1)
        self.own.append(float(combined != actual) if self.binary else (actual - combined) ** 2)
        self.each.append(np.where(there, (actual - f) ** 2, np.nan))
        if len(self.own) >= 2:
            each = np.array(self.each)
            seen = np.isfinite(each).sum(axis=0)
            errors = np.nansum(each, axis=0) / np.maximum(seen, 1)
            # a model without any forecast in the window is taken as average
            errors = np.where(seen > 0, errors, errors[seen > 0].mean())
            good = 1.0 / (1.0 + errors / (float(errors.mean()) + 1e-10))
            step = self.rate * (1.0 - math.exp(-float(np.mean(self.own))))
            new = self.w + step * (good - good.mean())
            s = float(new.sum())
            self.w = np.clip(new / s, 0.0, 1.0) if s > 0 else np.full(len(new), 1.0 / len(new))
        return (combined, used)


WEIGHTS = "combined double, weights array<double>"


def adaptive_weights(df: DataFrame, actual: str, forecasts: str, models: int, keys=("series_id",), **params) -> DataFrame:
    """``forecasts`` is an array column with one forecast per model for the row's actual value.

    Missing forecasts are left out of the combination; a row without any is dropped.  In
    ``binary`` form the combination becomes 1 from ``threshold`` on, else -1, for actual values
    of 1 and -1.
    """
    return ordered_fold(df, lambda k: AdaptiveWeights(models, **params), [actual, forecasts], WEIGHTS, keys)


class BeliefReturns:
    """Return of a position that follows the belief in the current market state, learned from the start.

    Every visit of a state adds the log odds of its evidence to the state's own; evidence of 0 or
    1 settles the belief at once.  A belief of low entropy buys above ``trade_limit`` and sells
    otherwise, any other keeps the position.  The position earns from the next row on.
    """

    def __init__(self, prior: float = 0.5, entropy_limit: float = 0.9, trade_limit: float = 0.5):
        self.start, self.entropy_limit, self.trade_limit = math.log(prior / (1.0 - prior)), entropy_limit, trade_limit
        self.odds: dict[str, float] = {}
        self.position = 0.0

    def row(self, ret, state, evidence):
        if missing(ret) or state is None or missing(evidence):
            return None
        earned = self.position * ret
        if 0.0 < evidence < 1.0:
            odds = self.odds.get(state, self.start) + math.log(evidence / (1.0 - evidence))
            self.odds[state] = odds
            p = 1.0 / (1.0 + math.exp(-odds))
        else:
            p = evidence
        q = 1.0 - p
        entropy = -(p * math.log2(p) + q * math.log2(q)) if p > 0.0 and q > 0.0 else 0.0
        if entropy < self.entropy_limit:
            self.position = 1.0 if p > self.trade_limit else -1.0
        return earned


class WeightedBeliefs:
    """Belief in each market state from evidence that weighs features by their relevance so far.

    Evidence is the weighted mean of the features' probabilities, one half if no feature weighs.
    Bayes' rule moves the belief in the row's state.  A feature then weighs by the share of the
    joint entropy of all beliefs that its conditional entropy given the state leaves, in no case
    less than nothing, and weights add up to one.  Features enter the joint entropy after the first
    row.  With a belief of zero the conditional entropy has no value, and weights stay.
    """

    def __init__(self, features: Sequence[float], prior: float = 0.5):
        self.features, self.prior = list(features), prior
        self.weights = [1.0 / len(self.features)] * len(self.features)
        self.beliefs: dict[str, float] = {}
        self.joint, self.first = 0.0, True

    def _conditional(self, p: float, state: float) -> float:
        parts = (p * state, p * (1.0 - state), (1.0 - p) * state)
        return sum(v * math.log2(v / state) for v in parts if v > 0.0)

    def row(self, state, *probabilities):
        if state is None or any(missing(p) for p in probabilities):
            return None
        total = sum(self.weights)
        evidence = sum(w * p for w, p in zip(self.weights, probabilities)) / total if total > 0.0 else 0.5
        was = self.beliefs.get(state, self.prior)
        both = was * evidence
        whole = both + (1.0 - was) * (1.0 - evidence)
        now = both / whole if whole > 0.0 else was
        self.joint += surprise(now) - (surprise(was) if state in self.beliefs else 0.0)
        self.beliefs[state] = now
        if self.joint > 0.0 and now > 0.0:
            shares = [max(0.0, 1.0 - self._conditional(p, now) / self.joint) for p in self.features]
            total = sum(shares)
            self.weights = [s / total for s in shares] if total > 0.0 else shares
        if self.first:
            self.joint, self.first = self.joint + sum(surprise(p) for p in self.features), False
        return (evidence, now, surprise(now) + surprise(1.0 - now), *self.weights)


class RiskPosition:
    """Position from BUY / SELL / HOLD scaled by the covariance of entropy changes and wealth changes so far."""

    def __init__(self):
        self.position, self.wealth = 0.0, 1.0
        self.n, self.me, self.mp, self.c = 0, 0.0, 0.0, 0.0
        self.logged = 0

    def row(self, ret, signal, entropy):
        if missing(ret) or signal is None:
            return None
        # the covariance pairs entropies with wealth changes known before this row
        risk = 0.5 if self.n < 2 else max(-1.0, min(1.0, math.tanh(10.0 * self.c / (self.n - 1)) - 1.0))
        if signal == "BUY":
            self.position = risk
        elif signal == "SELL":
            self.position = -risk
        change = self.position * ret
        self.wealth *= 1.0 + change
        self.logged += 1
        if self.logged > 1 and not missing(entropy):
            self.n += 1
            de = entropy - self.me
            self.me += de / self.n
            self.mp += (change - self.mp) / self.n
            self.c += de * (change - self.mp)
        return (risk, self.position, change, self.wealth)


def risk_position(df: DataFrame, ret: str, signal: str, entropy: str, keys=("series_id",)) -> DataFrame:
    return ordered_fold(df, lambda k: RiskPosition(), [ret, signal, entropy], "risk double, position double, strategy double, wealth double", keys)
