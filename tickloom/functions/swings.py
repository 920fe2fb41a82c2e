"""Swings of one ticker's bars, marked on the bar that makes them known; nulls are NaN."""

from __future__ import annotations

import math

import numpy as np

from tickloom.functions.recur import Bars, atr, div, exrem_span, heikin_ashi, hhv, llv, ma, ref, tema


def confirmed(high: np.ndarray, low: np.ndarray, pct: float) -> np.ndarray:
    """(n, 3): on a bar that confirms a swing of ``pct`` percent its side (1 top, -1 bottom), bar and price, else NaN.

    A top is known on the first bar whose low is that far below it, a bottom on
    the first whose high is that far above it.
    """
    out, side, top, bottom = np.full((len(high), 3), np.nan), 0, None, None
    for i, (h, l) in enumerate(zip(high.tolist(), low.tolist())):
        if h != h or l != l:
            continue
        if top is None:
            top, bottom = (i, h), (i, l)
        if side >= 0 and h > top[1]:
            top = i, h
        if side <= 0 and l < bottom[1]:
            bottom = i, l
        if side >= 0 and l <= top[1] * (1 - pct / 100) and top[0] < i:
            out[i], side, bottom = (1, *top), -1, (i, l)
        elif side <= 0 and h >= bottom[1] * (1 + pct / 100) and bottom[0] < i:
            out[i], side, top = (-1, *bottom), 1, (i, h)
    return out


def segment_lines(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """(n, 4): on a bar that confirms a swing, the least-squares line of ``x`` between it and the swing before.

    First bar, value there, slope and standard error; sums over a segment are
    differences of running sums, so segments may have any length.
    """
    y, i = np.nan_to_num(x), np.arange(len(x), dtype=float)
    sums = np.concatenate((np.zeros((3, 1)), np.cumsum([y, i * y, y * y], axis=1)), axis=1)
    out, before = np.full((len(x), 4), np.nan), None
    for at in np.flatnonzero(~np.isnan(marks[:, 0])).tolist():
        pivot = int(marks[at, 1])
        if before is not None:
            n = pivot - before + 1
            sy, siy, syy = sums[:, pivot + 1] - sums[:, before]
            sxy = siy - before * sy - (n - 1) / 2 * sy  # centred on the segment's middle
            sxx = n * (n * n - 1) / 12
            slope = sxy / sxx
            rest = max(0.0, syy - sy * sy / n - slope * sxy)
            out[at] = before, sy / n - slope * (n - 1) / 2, slope, (rest / (n - 2)) ** 0.5 if n > 2 else np.nan
        before = pivot
    return out


def close_trail(b: Bars, bull: float = 2.0, bear: float = 2.0, n: int = 20) -> np.ndarray:
    """A stop at a distance from the close that follows it, and turns when both closes have not kept to one side of it."""
    a, c, out, stop = atr(b, n).tolist(), b.c.tolist(), np.full(b.n, np.nan), 0.0
    for i in range(1, b.n):
        up, down = c[i] - bull * a[i], c[i] + bear * a[i]
        if c[i] > stop and c[i - 1] > stop:
            stop = max(stop, up)
        elif c[i] < stop and c[i - 1] < stop:
            stop = min(stop, down)
        else:
            stop = up if c[i] > stop else down
        out[i] = stop
    return out


def trail_legs(b: Bars, stop: np.ndarray) -> dict[str, np.ndarray]:
    """Legs above and below a trailing stop and the extremes between its reversals.

    ``leg`` is 1 or -1; ``fresh`` is 1 where a bar is at the extreme of its leg so
    far; on the first bar of a leg the leg before gives its extreme as a swing
    (``side``, ``bar``, ``price``, the last of equal ones), with the lowest low
    (``low_to``) and the highest high (``high_to``) from there to this bar.
    """
    names = ("leg", "fresh", "side", "bar", "price", "low_to", "high_to")
    out, leg, best = {n: np.full(b.n, np.nan) for n in names}, 0, None
    for i in range(b.n):
        now = leg if stop[i] != stop[i] else int(np.sign(b.c[i] - stop[i])) or leg
        if not now:
            continue
        if now != leg:
            if best is not None:
                at, price = best
                for n, v in zip(names[2:], (leg, at, price, b.l[at : i + 1].min(), b.h[at : i + 1].max())):
                    out[n][i] = v
            leg, best = now, None
        x = b.h[i] if leg > 0 else b.l[i]
        fresh = best is None or (x - best[1]) * leg >= 0
        if fresh:
            best = i, x
        out["leg"][i], out["fresh"][i] = leg, fresh
    return out


def pivot_box(b: Bars, n: int = 7, quiet: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed high (low) of the last bar whose high (low) of two bars ago was the extreme of n bars; others within ``quiet`` bars don't count."""
    _, top, low, _ = heikin_ashi(b)
    out = []
    for hit, value in ((ref(b.h, -2) == hhv(b.h, n), top), (ref(b.l, -2) == llv(b.l, n), low)):
        last = np.maximum.accumulate(np.where(exrem_span(hit, quiet), np.arange(b.n), -1))
        out.append(np.where(last >= 0, value[np.maximum(last, 0)], np.nan))
    return out[0], out[1]


def turn_inputs(b: Bars, n: int = 2) -> dict[str, np.ndarray]:
    """What the major peaks and valleys are made from: fast averages of highs and lows and the smoothed bars' extremes."""
    _, top, low, _ = b.once(heikin_ashi)
    return {"tema_high": tema(b.h, n), "tema_low": tema(b.l, n), "ha_high": top, "ha_low": low}


HILBERT = ((0, 0.0962), (2, 0.5769), (4, -0.5769), (6, -0.0962))


def dominant_cycle(x: np.ndarray) -> dict[str, np.ndarray]:
    """Quadrature of the price and its cycle, the filters' gain being set by the cycle found on the bar before.

    ``i1`` and ``q1`` (in phase and quadrature), ``period`` (between 6 and 50) and
    ``smooth_period``; bars before the seventh are zero.
    """
    n, price, full = len(x), x.tolist(), 2 * math.pi
    smooth, detrend, q1, i1, periods, smooth_periods = ([0.0] * n for _ in range(6))
    (k0, w0), (k1, w1), (k2, w2), (k3, w3) = HILBERT
    i3 = q3 = re = im = raw = period = smooth_period = 0.0
    for i in range(6, n):
        gain = 0.075 * period + 0.54
        a, b, c, d = i - k0, i - k1, i - k2, i - k3
        smooth[i] = (4 * price[i] + 3 * price[i - 1] + 2 * price[i - 2] + price[i - 3]) / 10
        detrend[i] = (w0 * smooth[a] + w1 * smooth[b] + w2 * smooth[c] + w3 * smooth[d]) * gain
        q1[i] = (w0 * detrend[a] + w1 * detrend[b] + w2 * detrend[c] + w3 * detrend[d]) * gain
        i1[i] = detrend[i - 3]
        i2 = i1[i] - (w0 * q1[a] + w1 * q1[b] + w2 * q1[c] + w3 * q1[d]) * gain
        q2 = q1[i] + (w0 * i1[a] + w1 * i1[b] + w2 * i1[c] + w3 * i1[d]) * gain
        i3b, q3b, before = i3, q3, raw
        i3, q3 = 0.2 * i2 + 0.8 * i3, 0.2 * q2 + 0.8 * q3
        re, im = 0.2 * (i3 * i3b + q3 * q3b) + 0.8 * re, 0.2 * (i3 * q3b - q3 * i3b) + 0.8 * im
        if im and re and (angle := math.atan(im / re)):
            raw = full / angle
        held = 1.5 * before if raw > 1.5 * before else 0.67 * before if raw < 0.67 * before else raw
        period = 0.2 * min(50.0, max(6.0, held)) + 0.8 * period
        smooth_period = 0.33 * period + 0.67 * smooth_period
        periods[i], smooth_periods[i] = period, smooth_period
    return {"i1": np.array(i1), "q1": np.array(q1), "period": np.array(periods), "smooth_period": np.array(smooth_periods)}


def cycle_of(b: Bars) -> dict[str, np.ndarray]:
    """The dominant cycle of the bars' middle."""
    return dominant_cycle((b.h + b.l) / 2)


def cycle_macd(b: Bars, signal: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Difference of two averages of the close over one and two dominant cycles of the bars' middle, and its plain mean."""
    period = np.floor(b.once(cycle_of)["smooth_period"] + 0.5)
    lines = []
    for cycles in (1, 2):
        shares, y, line = np.minimum(1.0, 2 / (cycles * period + 1)).tolist(), float(b.c[0]) if b.n else 0.0, []
        for v, share in zip(b.c.tolist(), shares):
            y += (v - y) * share
            line.append(y)
        lines.append(np.array(line))
    macd = lines[0] - lines[1]
    return macd, ma(macd, signal)


def phase_average(b: Bars, fast: float = 0.5, slow: float = 0.05, part: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """An average of the bars' middle as fast as its phase turns, and a follower of a ``part`` of its speed.

    As published, the phase is a full turn over the arctangent of quadrature over
    in-phase part, carried on where the latter is zero.  The published form has
    no update of its period, so its gain is that of period zero.
    """
    x = (b.h + b.l) / 2
    smooth = (4 * x + 3 * ref(x, -1) + 2 * ref(x, -2) + ref(x, -3)) / 10
    smooth[:6] = 0
    hilbert = lambda s: 0.54 * sum(w * (s if not k else np.concatenate((np.zeros(min(k, b.n)), s[: max(0, b.n - k)]))) for k, w in HILBERT)
    detrend = hilbert(smooth)
    detrend[:6] = 0
    q = hilbert(detrend)
    q[:6] = 0
    i1 = np.concatenate((np.zeros(min(3, b.n)), detrend[: max(0, b.n - 3)]))
    angle = np.arctan(div(q, i1))
    phase, mama, fama, last = 0.0, np.zeros(b.n), np.zeros(b.n), 0.0
    for i in range(6, b.n):
        phase = 2 * np.pi / angle[i] if i1[i] and angle[i] else last if i1[i] else 0.0
        alpha = max(slow, fast / max(1.0, last - phase))
        last = phase
        mama[i] = alpha * x[i] + (1 - alpha) * mama[i - 1]
        fama[i] = part * alpha * x[i] + (1 - part * alpha) * fama[i - 1]
    return mama, fama
