"""A character-level bidirectional LSTM with a CRF on top, in numpy: training by gradient descent, and Viterbi decoding of many windows."""

from __future__ import annotations

import functools
import random

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tags: 0 outside, 1 + 2k opens kind k, 2 + 2k goes on.
TAGS = 1 + 2 * len(KINDS)
#: Characters: 0 padding, 1..95 printable ASCII, 96 line end and other control characters, 97 all others.
CLASSES = 98
LENGTH = 96


def classes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c > 126, 97, np.where(c < 32, 96, c.astype(np.int64) - 31)).astype(np.uint8)


# Labelled spans, made by rule from a seed.

_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve é ñ ü que ción lich keit eau".split()


def _word(r: random.Random) -> str:
    w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    return r.choice((w, w, w, w.capitalize(), w.upper(), w + ",", w + ".", w + r.choice(("!!", "###", "%%%", "&&&", "***"))))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _luhn(r: random.Random, n: int) -> str:
    d = _digits(r, n - 1)
    return d + str(-sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(d))) % 10)


def _name(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES[:30]) for _ in range(r.randint(1, 3)))


def _personal(r: random.Random) -> tuple[str, int]:
    """One item and its kind; half of them in forms that no plain pattern catches."""
    k, plain = r.randrange(4), r.random() < 0.5
    if k == 0:
        user, host, top = _name(r) + r.choice(("", f".{_digits(r, 2)}", "_" + _name(r), _digits(r, 1))), r.choice((f"mail{_digits(r, 1)}.example", _name(r))), r.choice(("com", "org", "net", "de"))
        at, dot = ("@", ".") if plain else r.choice(((" [at] ", "."), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", ".")))
        return user + at + host.replace(".", dot) + dot + top, 0
    if k == 1:
        return r.choice((".",) if plain else ("[.]", " . ", "(.)")).join(str(r.randrange(256)) for _ in range(4)), 1
    if k == 2:
        d = _luhn(r, r.choice((16, 16, 16, 15, 14, 19)))
        return (d if r.random() < 0.5 else r.choice((" ", "-")).join(d[i : i + 4] for i in range(0, len(d), 4))) if plain else r.choice((".", "/", "_", " - ")).join(d[i : i + 4] for i in range(0, len(d), 4)), 2
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    if plain:
        return r.choice((f"+1 ({a}) {b}-{c}", f"+{_digits(r, 2)} {a} {b} {c}", f"+1-{a}-{b}-{c}")), 3
    return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{_digits(r, 2)} {a} {b} {c}")), 3


def _decoy(r: random.Random) -> str:
    return r.choice((
        lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', lambda: f"Version {r.randrange(9)}.{r.randrange(9)}", lambda: f"{r.randrange(1900, 2030)}", lambda: f"{r.randrange(1900, 2030)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}",
        lambda: f"${r.randrange(9999)}.{_digits(r, 2)}", lambda: f"[{r.randrange(99)}]", lambda: f"({_word(r)})", lambda: _digits(r, r.randint(1, 6)), lambda: f"{r.randrange(24)}:{_digits(r, 2)}", lambda: f"{r.randrange(99)}%", lambda: f"{_digits(r, 1)}.{_digits(r, 3)}.{_digits(r, 3)}", lambda: f"@{_name(r)}", lambda: f"{_name(r)}{_digits(r, 3)}",
    ))()


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows of LENGTH characters as classes, and their tags."""
    r = random.Random(seed)
    x, y = np.zeros((n, LENGTH), np.uint8), np.zeros((n, LENGTH), np.int64)
    for row in range(n):
        text, tags = "", []
        while len(text) < 2 * LENGTH:
            u = r.random()
            piece, kind = _personal(r) if u < 0.12 else (_decoy(r), None) if u < 0.24 else (_word(r), None)
            tags += [0] * len(piece) if kind is None else [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1)
            text += piece + (end := r.choice((" ", " ", " ", " ", "\n", ". ", ", ") if kind is not None else (" ", " ", "\n")))
            tags += [0] * len(end)
        lo = r.randrange(LENGTH)
        long = LENGTH if r.random() < 0.8 else r.randint(8, LENGTH)
        x[row, :long], y[row, :long] = classes(text[lo : lo + long]), tags[lo : lo + long]
        for k in range(len(KINDS)):  # a span cut by the window's start opens there
            if y[row, 0] == 2 + 2 * k:
                y[row, 0] = 1 + 2 * k
    return x, y


# The network


def initial(hidden: int, seed: int) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"{d}x"] = g.normal(0, 0.3, (CLASSES, 4 * hidden))
        p[f"{d}h"] = g.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        p[f"{d}x"][:, hidden : 2 * hidden] += 1  # forget gates start open
    p["out"], p["bias"], p["trans"] = g.normal(0, 0.3, (2 * hidden, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _allowed() -> np.ndarray:
    """0 where tag j may follow tag i, else a large negative number: a span's inside follows its own kind only."""
    m = np.zeros((TAGS, TAGS), np.float32)
    for j in range(2, TAGS, 2):
        m[:, j] = -1e4
        m[[j - 1, j], j] = 0
    return m


ALLOWED = _allowed()
_START = np.where(np.arange(TAGS) % 2 == 0, -1e4, 0).astype(np.float32)
_START[0] = 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool):
    """One direction over (rows, time) classes: outputs (time, rows, hidden), and what the backward pass needs."""
    n, t_max = x.shape
    hid = wh.shape[0]
    h, c = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
    out, saved = np.empty((t_max, n, hid), np.float32), []
    for t in range(t_max):
        z = wx[x[:, t]] + h @ wh
        g = _sigmoid(z[:, : 3 * hid])
        i, f, o, u = g[:, :hid], g[:, hid : 2 * hid], g[:, 2 * hid :], np.tanh(z[:, 3 * hid :])
        c0, c = c, f * c + i * u
        tc = np.tanh(c)
        h0, h = h, o * tc
        out[t] = h
        if keep:
            saved.append((h0, c0, i, f, o, u, tc))
    return out, saved


def _back(x, wh, saved, dout):
    n, t_max = x.shape
    hid = wh.shape[0]
    dx, dwh = np.zeros((CLASSES, 4 * hid), np.float32), np.zeros_like(wh)
    dh, dc = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
    for t in reversed(range(t_max)):
        h0, c0, i, f, o, u, tc = saved[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 1)
        dwh += h0.T @ dz
        np.add.at(dx, x[:, t], dz)
        dh, dc = dz @ wh.T, dc * f
    return dx, dwh


def emissions(p: dict, x: np.ndarray, keep: bool = False):
    f, fs = _run(x, p["fx"], p["fh"], keep)
    b, bs = _run(x[:, ::-1], p["bx"], p["bh"], keep)
    both = np.concatenate([f, b[::-1]], 2)
    return both @ p["out"] + p["bias"], both, fs, bs


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))


def _gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    n, t_max = x.shape
    e, both, fs, bs = emissions(p, x, True)
    tr = p["trans"] + ALLOWED
    al, be = np.empty_like(e), np.zeros_like(e)
    al[0] = e[0] + _START
    for t in range(1, t_max):
        al[t] = e[t] + _lse(al[t - 1][:, :, None] + tr[None], 1)
    for t in reversed(range(t_max - 1)):
        be[t] = _lse(tr[None] + (e[t + 1] + be[t + 1])[:, None, :], 2)
    z = _lse(al[-1], 1)
    de = np.exp(al + be - z[None, :, None])
    dtr = np.zeros_like(tr)
    for t in range(1, t_max):
        dtr += np.exp(al[t - 1][:, :, None] + tr[None] + (e[t] + be[t])[:, None, :] - z[:, None, None]).sum(0)
    yt, rows = y.T, np.arange(n)
    gold = _START[yt[0]].sum()
    for t in range(t_max):
        gold += e[t][rows, yt[t]].sum()
        de[t][rows, yt[t]] -= 1
        if t:
            gold += tr[yt[t - 1], yt[t]].sum()
            np.add.at(dtr, (yt[t - 1], yt[t]), -1)
    de /= n * t_max / 32
    dboth = de @ p["out"].T
    hid = p["fh"].shape[0]
    g = {"out": np.tensordot(both, de, ([0, 1], [0, 1])), "bias": de.sum((0, 1)), "trans": np.where(ALLOWED < 0, 0, dtr / (n * t_max / 32))}
    g["fx"], g["fh"] = _back(x, p["fh"], fs, dboth[:, :, :hid])
    g["bx"], g["bh"] = _back(x[:, ::-1], p["bh"], bs, dboth[::-1, :, hid:])
    return float((z.sum() - gold) / n), g


@functools.lru_cache(maxsize=4)
def trained(hidden: int = 16, steps: int = 320, rows: int = 64, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights after `steps` batches of `rows` labelled windows; the same for the same parameters."""
    p = initial(hidden, seed)
    x, y = labelled(rows * steps // 4, seed)
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    for s in range(steps):
        at = np.arange(s * rows, (s + 1) * rows) % len(x)
        _, g = _gradients(p, x[at], y[at])
        norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
        lr = 0.02 * min(1, (steps - s) / (steps * 0.5))
        for k in p:
            d = g[k] * min(1, 5 / (norm + 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
            p[k] = (p[k] - lr * (m[k] / (1 - 0.9 ** (s + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (s + 1))) + 1e-6)).astype(np.float32)
    return p


def decode(p: dict, x: np.ndarray) -> np.ndarray:
    """The best tags (rows, time) of windows of classes."""
    n, t_max = x.shape
    e = emissions(p, x)[0].transpose(1, 0, 2).reshape(n * t_max, TAGS)
    whole = np.ones(n, bool)
    return best_paths(p, e, np.arange(n) * t_max, np.full(n, t_max), whole, whole).reshape(n, t_max)


def best_paths(p: dict, e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray, cells: int = 1 << 19) -> np.ndarray:
    """The best tags of the stretches e[start : start + size] of emissions, end to end in the stretches' order.

    A stretch begins (ends) a text where `first` (`last`) says so; elsewhere outside characters stand before (after) it. Stretches of
    like length are searched together, some `cells` characters at a time.
    """
    tr = p["trans"] + ALLOWED
    to = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(to[-1], np.int8)
    by = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(by):
        n = 1
        while at + n < len(by) and (n + 1) * sizes[by[at + n]] <= cells:
            n += 1
        part = by[at : at + n]
        at += n
        size, t_max = sizes[part], int(sizes[part].max())
        score = e[starts[part]] + np.where(first[part, None], _START, tr[0])
        back = np.zeros((t_max, n, TAGS), np.int8)
        for t in range(1, t_max):
            live = size > t
            a = score[live][:, :, None] + tr[None]
            back[t, live] = a.argmax(1)
            score[live] = a.max(1) + e[starts[part[live]] + t]
        tag = (score + np.where(last[part, None], 0, tr[:, 0])).argmax(1)
        for t in range(t_max - 1, -1, -1):
            live = size > t
            out[to[part[live]] + t] = tag[live]
            tag = np.where(live, back[t][np.arange(n), tag], tag)
    return out
