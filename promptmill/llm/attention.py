"""A small causal self-attention model over subword leaves, forward and backward in numpy.

The next piece is predicted in two steps: one of CLASSES classes, then one of LEAVES leaves of that class. A window holds WINDOW
places; each place sees itself and the ones before it. The first WINDOW - FRESH places are context alone: only the others predict.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# equal, so that one vector of ones adds up any of them
CLASSES = LEAVES = WINDOW = 32
FRESH = 24
WIDTH, HIDDEN = 16, 32

# Windows that are worked on together, so that their arrays stay in the processor's cache.
TOGETHER = 128

Params = dict[str, np.ndarray]
_CONTEXT = WINDOW - FRESH
_SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))[_CONTEXT:]
_ONES = np.ones(WINDOW, np.float32)
_SCALE = np.float32(WIDTH**-0.5)


def initial(class_logs: np.ndarray, leaf_logs: np.ndarray, seed: int = 7) -> Params:
    """Parameters whose first predictions are near the given logarithms of shares, whatever the context."""
    r = np.random.RandomState(seed)
    draw = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
    root = WIDTH**-0.5
    return {
        "piece": draw(CLASSES * LEAVES, WIDTH, scale=0.3),
        "place": draw(WINDOW, WIDTH, scale=0.05),
        "query": draw(WIDTH, WIDTH, scale=root),
        "key_value": draw(WIDTH, 2 * WIDTH, scale=root),
        "out": draw(WIDTH, WIDTH, scale=root),
        "up": draw(WIDTH, HIDDEN, scale=root),
        "up_bias": np.zeros(HIDDEN, np.float32),
        "down": draw(HIDDEN, WIDTH, scale=HIDDEN**-0.5),
        # the last row of these two is a bias
        "class": np.vstack([draw(WIDTH, CLASSES, scale=0.05), class_logs]).astype(np.float32),
        "leaf": np.concatenate([draw(CLASSES, WIDTH, LEAVES, scale=0.05), leaf_logs[:, None]], axis=1).astype(np.float32),
    }


def _exp(x: np.ndarray) -> np.ndarray:
    """In place. Logits beyond 60 count as 60, so that no sum overflows."""
    if x.size and x.max() > 60:
        np.minimum(x, 60, out=x)
    return np.exp(x, out=x)


class _Pass(NamedTuple):
    """What a forward pass leaves; weights of attention, classes and leaves are not yet divided by their sums."""

    h0: np.ndarray
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    weights: np.ndarray
    weight_sums: np.ndarray
    mixed: np.ndarray
    h1: np.ndarray
    z: np.ndarray
    h2: np.ndarray
    logs: np.ndarray
    classes: np.ndarray
    class_sums: np.ndarray
    leaves: np.ndarray
    leaf_sums: np.ndarray
    order: np.ndarray
    cuts: np.ndarray
    sorted_h: np.ndarray


def _forward(p: Params, inputs: np.ndarray, which: np.ndarray, goal: np.ndarray) -> _Pass:
    """`which` are the fresh places, numbered over all windows, whose target is in `goal`."""
    n = len(inputs)
    h0 = p["piece"].take(inputs.reshape(-1), axis=0).reshape(n, WINDOW, WIDTH)
    h0 += p["place"]
    key_value = (h0.reshape(-1, WIDTH) @ p["key_value"]).reshape(n, WINDOW, 2 * WIDTH)
    k, v = key_value[..., :WIDTH], key_value[..., WIDTH:]
    fresh = h0[:, _CONTEXT:].reshape(-1, WIDTH)
    q = (fresh @ (p["query"] * _SCALE)).reshape(n, FRESH, WIDTH)
    weights = _exp(q @ k.transpose(0, 2, 1))
    weights *= _SEEN
    weight_sums = (weights.reshape(-1, WINDOW) @ _ONES)[:, None]
    mixed = (weights @ v).reshape(-1, WIDTH)
    mixed /= weight_sums
    if len(which) < len(fresh):
        fresh, mixed = fresh.take(which, axis=0), mixed.take(which, axis=0)
    h1 = mixed @ p["out"]
    h1 += fresh
    z = h1 @ p["up"]
    z += p["up_bias"]
    np.maximum(z, 0, out=z)
    h2 = np.ones((len(h1), WIDTH + 1), h1.dtype)
    np.matmul(z, p["down"], out=h2[:, :WIDTH])
    h2[:, :WIDTH] += h1

    at = np.arange(len(goal)) * LEAVES
    cls, leaf = np.divmod(goal, LEAVES)
    classes = h2 @ p["class"]
    logs = np.minimum(classes.reshape(-1).take(at + cls), 60)
    class_sums = _exp(classes) @ _ONES
    order = np.argsort(cls.astype(np.int8), kind="stable")
    cuts = np.r_[0, np.cumsum(np.bincount(cls, minlength=CLASSES))]
    sorted_h = h2.take(order, axis=0)
    leaves = np.empty((len(h2), LEAVES), h2.dtype)
    for c in range(CLASSES):
        if cuts[c] < cuts[c + 1]:
            own = slice(cuts[c], cuts[c + 1])
            np.matmul(sorted_h[own], p["leaf"][c], out=leaves[own])
    picked = np.minimum(leaves.reshape(-1).take(at + leaf.take(order)), 60)
    leaf_sums = _exp(leaves) @ _ONES
    logs -= np.log(class_sums)
    logs[order] += picked - np.log(leaf_sums)
    return _Pass(h0, q, k, v, weights, weight_sums, mixed, h1, z, h2, logs, classes, class_sums, leaves, leaf_sums, order, cuts, sorted_h)


def log_shares(p: Params, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> np.ndarray:
    """Natural logarithm of the predicted share of every scored target, window by window, in float32.

    `inputs` are leaves of all places, `targets` and `scored` are those of the fresh ones.
    """
    found = []
    for lo in range(0, len(inputs), TOGETHER):
        part = slice(lo, lo + TOGETHER)
        which = np.flatnonzero(scored[part])
        found.append(_forward(p, inputs[part], which, targets[part].reshape(-1).take(which)).logs)
    return np.concatenate(found) if found else np.zeros(0, np.float32)


def gradient(p: Params, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> tuple[Params, float, int]:
    """Sums over the scored targets: derivatives of their loss, the loss, and their number."""
    sums: Params = {}
    loss, count = 0.0, 0

    def add(name: str, part: np.ndarray) -> None:
        # the first block's are kept as they are: a step has no other
        sums[name] = sums[name] + part.astype(np.float64) if name in sums else part

    for lo in range(0, len(inputs), TOGETHER):
        part = slice(lo, lo + TOGETHER)
        x, n = inputs[part], len(inputs[part])
        which = np.flatnonzero(scored[part])
        goal = targets[part].reshape(-1).take(which)
        f = _forward(p, x, which, goal)
        loss -= float(f.logs.sum(dtype=np.float64))
        count += len(goal)

        at = np.arange(len(goal))
        classes = np.divide(f.classes, f.class_sums[:, None], out=f.classes)
        leaves = np.divide(f.leaves, f.leaf_sums[:, None], out=f.leaves)
        classes[at, goal // LEAVES] -= 1
        leaves[at, goal[f.order] % LEAVES] -= 1
        add("class", f.h2.T @ classes)
        d2 = classes @ p["class"][:WIDTH].T
        sorted_d = np.empty_like(d2)
        of_leaves = np.zeros(p["leaf"].shape, d2.dtype)
        cuts = f.cuts.tolist()
        for c in range(CLASSES):
            if cuts[c] < cuts[c + 1]:
                own = slice(cuts[c], cuts[c + 1])
                np.matmul(f.sorted_h[own].T, leaves[own], out=of_leaves[c])
                np.matmul(leaves[own], p["leaf"][c, :WIDTH].T, out=sorted_d[own])
        add("leaf", of_leaves)
        d2[f.order] += sorted_d
        dz = d2 @ p["down"].T
        dz *= f.z > 0
        add("down", f.z.T @ d2)
        add("up", f.h1.T @ dz)
        add("up_bias", dz.sum(0))
        d1 = dz @ p["up"].T
        d1 += d2
        add("out", f.mixed.T @ d1)

        a = np.divide(f.weights, f.weight_sums.reshape(n, FRESH, 1), out=f.weights)
        dmixed = np.zeros((n * FRESH, WIDTH), d1.dtype)
        dmixed[which] = d1 @ p["out"].T
        dmixed = dmixed.reshape(n, FRESH, WIDTH)
        dfresh = np.zeros((n * FRESH, WIDTH), d1.dtype)
        dfresh[which] = d1
        da = dmixed @ f.v.transpose(0, 2, 1)
        da -= (da * a).sum(-1, keepdims=True)
        da *= a
        dq = (da @ f.k).reshape(-1, WIDTH) * _SCALE
        add("query", f.h0[:, _CONTEXT:].reshape(-1, WIDTH).T @ dq)
        dfresh += dq @ p["query"].T
        dkv = np.empty((n, WINDOW, 2 * WIDTH), d1.dtype)
        np.matmul(da.transpose(0, 2, 1), f.q, out=dkv[..., :WIDTH])
        np.matmul(a.transpose(0, 2, 1), dmixed, out=dkv[..., WIDTH:])
        dkv = dkv.reshape(-1, 2 * WIDTH)
        add("key_value", f.h0.reshape(-1, WIDTH).T @ dkv)
        dh0 = (dkv @ p["key_value"].T).reshape(n, WINDOW, WIDTH)
        dh0[:, _CONTEXT:] += dfresh.reshape(n, FRESH, WIDTH)
        add("place", dh0.sum(0))
        flat = x.reshape(-1).astype(np.int16)
        rows = np.argsort(flat, kind="stable")
        flat = flat[rows]
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        of_pieces = np.zeros(p["piece"].shape, dh0.dtype)
        of_pieces[flat[starts]] = np.add.reduceat(dh0.reshape(-1, WIDTH).take(rows, axis=0), starts, axis=0)
        add("piece", of_pieces)
    return {k: sums.get(k, np.zeros(v.shape)) for k, v in p.items()}, loss, count


def pack(p: Params, dtype: type | None = None) -> np.ndarray:
    return np.concatenate([v.reshape(-1) for v in p.values()], dtype=dtype)


def unpack(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


class Adam:
    """Steps along a mean gradient, of a length that each parameter's own history sets."""

    def __init__(self, size: int, rate: float):
        self.rate, self.step = rate, 0
        self.mean, self.square, self._one, self._other = (np.zeros(size) for _ in range(4))

    def move(self, flat: np.ndarray, slope: np.ndarray) -> None:
        """In place."""
        one, other = self._one, self._other
        self.step += 1
        self.mean *= 0.9
        self.mean += np.multiply(slope, 0.1, out=one)
        self.square *= 0.98
        np.multiply(slope, slope, out=one)
        one *= 0.02
        self.square += one
        np.divide(self.square, 1 - 0.98**self.step, out=one)
        np.sqrt(one, out=one)
        one += 1e-8
        np.multiply(self.mean, self.rate / (1 - 0.9**self.step), out=other)
        other /= one
        flat -= other
