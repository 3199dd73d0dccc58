"""A small causal self-attention language model in numpy: one head over classes of subword ids.

The most frequent ids are classes of their own and the others share a few classes by the look of their token, inside
which they keep their unigram shares; so the probabilities of all ids add up to one. A text is read as a start mark and
its ids, and every id and the end mark are predicted from the inputs before: ``SPAN`` predictions at a time, by attention
over these and the ``SPAN`` inputs before them. The windows overlap and each id is predicted once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

SPAN = 16
WIDTH = 16
CLASSES = 64
_LOOKS = 10
HEAD = CLASSES - _LOOKS
END = 50_256
_PAD = CLASSES
_RATE, _STEP_WINDOWS = 0.01, 128
# What is learned; the log shares of class pairs are counted.
_SHAPES = {"q": (CLASSES, WIDTH), "k": (CLASSES + 1, WIDTH), "v": (CLASSES + 1, WIDTH), "o": (WIDTH, CLASSES), "b": (2 * SPAN,)}
_LIMITS = {"q": 3.0, "k": 3.0, "v": 1.5, "o": 1.5, "b": 10.0}


def looks(tokens: list[str]) -> np.ndarray:
    """A number under ``_LOOKS`` for each token of a byte-level vocabulary: with or without a blank first, and of what."""

    def look(t: str) -> int:
        blank = t[:1] == "Ġ"
        body = t[1:] if blank else t
        kind = 0 if body.isascii() and body.isalpha() else 1 if body.isalpha() else 2 if body.isdigit() else 3 if body.isascii() else 4
        return kind + 5 * blank

    return np.array([look(t) for t in tokens], dtype=np.int64)


@dataclass
class Classes:
    """Which class each id has and its log share in it."""

    of: np.ndarray
    log_share: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray, look: np.ndarray) -> Classes:
        order = np.lexsort((np.arange(len(counts)), -counts))
        of = HEAD + look
        of[order[:HEAD]] = np.arange(HEAD)
        smoothed = counts + 1.0
        total = np.bincount(of, smoothed, CLASSES)
        return cls(of.astype(np.uint8), np.log(smoothed / total[of]).astype(np.float32))


def start_model(pairs: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters before learning: the log shares of class pairs, and small random attention."""
    rng = np.random.default_rng(5)
    model = {n: rng.normal(0, 0.1, s).astype(np.float32) for n, s in _SHAPES.items()}
    prior = (pairs.sum(axis=0) + 1.0) / (pairs.sum() + CLASSES)
    shares = (pairs + 20.0 * prior) / (pairs.sum(axis=1, keepdims=True) + 20.0)
    model["r"] = np.log(np.maximum(shares, 1e-10)).astype(np.float32)
    model["b"][:] = 0.0
    return model


def packed(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[n].ravel() for n in _SHAPES])


def unpacked(flat: np.ndarray, copy: bool = True) -> dict[str, np.ndarray]:
    """The parameters in ``flat``; without ``copy`` they change with it."""
    out, at = {}, 0
    for n, s in _SHAPES.items():
        size = int(np.prod(s))
        out[n] = flat[at : at + size].reshape(s).astype(np.float32, copy=copy)
        at += size
    return out


def windows(
    ids: list[np.ndarray], classes: np.ndarray, chosen: Callable[[np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Input classes (windows by 2*SPAN), predicted ids (windows by SPAN), which of these are real, and each window's text.

    ``chosen`` says, given the text of every window, which of them are made.
    """
    sizes = np.array([len(x) + 1 for x in ids], dtype=np.int64)  # predictions: the ids and the end
    each = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(ids)), each)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    room = SPAN + each * SPAN  # per text: SPAN paddings, then its inputs, filled up to whole spans
    base = np.cumsum(room) - room
    inputs = np.full(int(room.sum()), _PAD, dtype=np.uint8)
    targets = np.full(int(room.sum()), END, dtype=np.int32)
    real = np.zeros(int(room.sum()), dtype=bool)
    for text, start, end in zip(ids, (base + SPAN).tolist(), (base + SPAN + sizes).tolist()):
        inputs[start + 1 : end] = classes[text]
        targets[start : end - 1] = text
        real[start:end] = True
    inputs[base + SPAN] = classes[END]
    at = base[owner] // SPAN + place  # every text begins at a whole span, so windows are two spans in a row
    if chosen is not None:
        mine = chosen(owner)
        at, owner = at[mine], owner[mine]
    spans = inputs.reshape(-1, SPAN)
    return np.concatenate((spans[at], spans[at + 1]), axis=1), targets.reshape(-1, SPAN)[at + 1], real.reshape(-1, SPAN)[at + 1], owner


_DISTANCE = (SPAN + np.arange(SPAN))[:, None] - np.arange(2 * SPAN)[None, :]
_CAUSAL = _DISTANCE >= 0
_ALL = CLASSES + 1  # with the padding


_held: dict[str, np.ndarray] = {}


def _room(name: str, shape: tuple[int, ...], kind: type = np.float32) -> np.ndarray:
    """An array that the next batch of windows uses again: fresh memory for a product costs more than the product."""
    size = int(np.prod(shape))
    if name not in _held or len(_held[name]) < size:
        _held[name] = np.empty(size, kind)
    return _held[name][:size].reshape(shape)


def _tables(model):
    """What attention needs of each pair of classes and of each distance, so that no pair of inputs is multiplied.

    ``weight`` holds the exponential of the score of an asking class (row) and a class that is looked at; paddings are
    not looked at. ``near`` is the factor of the distance, 0 for what comes later.
    """
    q = np.concatenate((model["q"] / np.float32(np.sqrt(WIDTH)), np.zeros((1, WIDTH), np.float32)))
    weight = np.exp(q @ model["k"].T)
    weight[:, _PAD] = 0.0
    v = model["v"].copy()
    v[_PAD] = 0.0
    near = np.where(_CAUSAL, np.exp(model["b"][np.maximum(_DISTANCE, 0)]), 0.0).astype(np.float32)
    r = np.concatenate((model["r"], np.zeros((1, CLASSES), np.float32)))
    return q, weight, v, near, r


def _pairs(u: np.ndarray) -> np.ndarray:
    """The place in ``weight`` of every asking input and every input of its window."""
    pairs, wide = _room("pairs", (len(u), SPAN, 2 * SPAN), np.int64), u.astype(np.int64)
    return np.add((wide[:, SPAN:] * _ALL)[:, :, None], wide[:, None, :], out=pairs)


def _one_over_sums(p: np.ndarray) -> np.ndarray:
    """For every asking input, as a column."""
    return (1.0 / np.maximum(p.reshape(-1, 2 * SPAN) @ np.ones(2 * SPAN, np.float32), np.float32(1e-30)))[:, None]


def log_probability(model: dict[str, np.ndarray], classes: Classes, ids: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each whole text with its end, by masked attention over batches of windows."""
    _, weight, v, near, r = _tables(model)
    inputs, targets, real, owner = windows(ids, classes.of)
    out = np.zeros(len(ids))
    n, ones = _STEP_WINDOWS, np.ones(CLASSES, np.float32)
    # Buffers small enough for the processor's cache, used again by every batch.
    vs, o = np.empty((n, 2 * SPAN, WIDTH), np.float32), np.empty((n, SPAN, WIDTH), np.float32)
    p = np.empty((n, SPAN, 2 * SPAN), np.float32)
    logits, prior = np.empty((n * SPAN, CLASSES), np.float32), np.empty((n * SPAN, CLASSES), np.float32)
    rows = np.arange(n * SPAN)
    for s in range(0, len(inputs), n):
        u, y, ok = inputs[s : s + n], targets[s : s + n].ravel(), real[s : s + n].ravel()
        m = len(u)
        np.take(weight.ravel(), _pairs(u), out=p[:m], mode="clip")
        p[:m] *= near
        np.take(v, u, axis=0, out=vs[:m], mode="clip")
        np.matmul(p[:m], vs[:m], out=o[:m])
        h = o[:m].reshape(-1, WIDTH)
        h *= _one_over_sums(p[:m])
        z, b = logits[: m * SPAN], prior[: m * SPAN]
        np.matmul(h, model["o"], out=z)
        np.take(r, u[:, SPAN:].ravel(), axis=0, out=b, mode="clip")
        z += b
        found = z[rows[: len(y)], classes.of[y]]
        np.exp(z, out=z)
        each = found - np.log(z @ ones) + classes.log_share[y]
        each = np.where(ok, each, 0.0).reshape(-1, SPAN).sum(axis=1, dtype=np.float64)
        out += np.bincount(owner[s : s + n], each, len(ids))
    return out / np.log(10.0)


def _by_class(values: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` (one for each input) by the class of the input."""
    order = np.argsort(u.ravel(), kind="stable")
    found = np.flatnonzero(counts := np.bincount(u.ravel(), minlength=_ALL))
    ends = np.cumsum(counts)
    rows = np.take(values, order, axis=0, out=_room("rows", values.shape), mode="clip")
    out = np.zeros((_ALL, values.shape[1]), np.float32)
    out[found] = np.add.reduceat(rows, (ends - counts)[found], axis=0)
    return out


def gradients(model: dict[str, np.ndarray], u: np.ndarray, y: np.ndarray, ok: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss of the real predictions of some windows, by what is learned; ``y`` are classes."""
    q, weight, v, near, r = _tables(model)
    n, asked = len(u), u[:, SPAN:].ravel()
    pairs = _pairs(u)
    p = np.take(weight.ravel(), pairs, out=_room("p", pairs.shape), mode="clip")
    p *= near
    vs = np.take(v, u, axis=0, out=_room("vs", (n, 2 * SPAN, WIDTH)), mode="clip")
    h = np.matmul(p, vs, out=_room("h", (n, SPAN, WIDTH))).reshape(-1, WIDTH)
    over = _one_over_sums(p)
    h *= over
    d = np.matmul(h, model["o"], out=_room("d", (len(asked), CLASSES)))
    d += np.take(r, asked, axis=0, out=_room("prior", d.shape), mode="clip")
    np.exp(d, out=d)
    # Rows of d are left as multiples of the softmax; each row's factor is put into the narrow arrays beside it.
    total = d @ np.ones(CLASSES, np.float32)
    d[np.arange(len(d)), y.ravel()] -= total
    scale = (ok.ravel() / (total * np.float32(max(1, ok.sum())))).astype(np.float32)[:, None]
    dh = np.matmul(d, model["o"].T, out=_room("dh", h.shape))
    dh *= scale * over
    ds = np.matmul(dh.reshape(n, SPAN, WIDTH), vs.transpose(0, 2, 1), out=_room("ds", pairs.shape))
    ds -= np.einsum("ij,ij->i", dh, h).reshape(n, SPAN, 1)
    ds *= p
    of_pair = np.zeros(_ALL * _ALL, np.float32)
    np.add.at(of_pair, pairs.ravel(), ds.ravel())
    of_pair = of_pair.reshape(_ALL, _ALL)
    dv = np.matmul(p.transpose(0, 2, 1), dh.reshape(n, SPAN, WIDTH), out=_room("dv", (n, 2 * SPAN, WIDTH)))
    h *= scale
    # Products of a few windows at a time, then summed: one long product of two narrow arrays takes twice as long.
    each = np.matmul(h.reshape(n, SPAN, WIDTH).transpose(0, 2, 1), d.reshape(n, SPAN, CLASSES), out=_room("each", (n, WIDTH, CLASSES)))
    grad = {
        "q": (of_pair @ model["k"])[:CLASSES] / np.float32(np.sqrt(WIDTH)),
        "k": of_pair.T @ q,
        "v": _by_class(dv.reshape(-1, WIDTH), u),
        "o": each.sum(axis=0),
        "b": np.bincount(_DISTANCE[_CAUSAL], ds.sum(axis=0)[_CAUSAL], 2 * SPAN).astype(np.float32),
    }
    grad["k"][_PAD] = grad["v"][_PAD] = 0.0
    return grad


class Learner:
    """Adam over batches of windows, from given parameters; all of them lie in one vector."""

    def __init__(self, model: dict[str, np.ndarray]):
        self._w = packed(model)
        self.model = model | unpacked(self._w, copy=False)
        self._m, self._v = np.zeros_like(self._w), np.zeros_like(self._w)
        self._limit = np.concatenate([np.full(int(np.prod(s)), _LIMITS[n], np.float32) for n, s in _SHAPES.items()])
        self._t, self.seen = 0, 0

    def learn(self, u: np.ndarray, y: np.ndarray, ok: np.ndarray) -> None:
        for s in range(0, len(u), _STEP_WINDOWS):
            part = slice(s, s + _STEP_WINDOWS)
            g = packed(gradients(self.model, u[part], y[part], ok[part]))
            self._t += 1
            self.seen += int(ok[part].sum())
            rate = np.float32(_RATE * np.sqrt(1 - 0.99**self._t) / (1 - 0.9**self._t))
            self._m += np.float32(0.1) * (g - self._m)
            self._v += np.float32(0.01) * (g * g - self._v)
            self._w -= rate * self._m / (np.sqrt(self._v) + np.float32(1e-6))
            np.clip(self._w, -self._limit, self._limit, out=self._w)
