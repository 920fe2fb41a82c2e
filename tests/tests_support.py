"""Plain loops that the streams are held against."""


def ema(x, n):
    out, y = [], None
    for v in x:
        y = v if y is None else y + (v - y) * 2 / (n + 1)
        out.append(y)
    return out
