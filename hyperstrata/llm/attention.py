"""A small causal self-attention language model over subword ids, in numpy.

One block: embeddings of ids and places, one attention head with a causal mask, a
rectified layer, and a softmax in two steps: over ``GROUPS`` groups of classes, then
over the ``MEMBERS`` classes of the group, whose biases depend on the group. Frequent
ids are classes of their own; the others share classes by frequency, and within a
class an id has its smoothed share of the corpus counts. So the probabilities of all
ids sum to 1, and GROUPS + MEMBERS logits tell GROUPS * MEMBERS classes apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, STRIDE = 32, 24
WIDTH, HIDDEN, GROUPS, MEMBERS = 16, 24, 16, 16
CLASSES = GROUPS * MEMBERS
OWN = 192  # classes of one frequent id each; the rest are bands of ids by frequency
KNOWN, OTHER = 4096, 256  # embedding rows of frequent ids, and those the other ids share by hash
CHUNK, SCORE_CHUNK = 64, 64
_CEILING = np.float32(60.0)  # exp of this, summed over a window or the classes, stays finite
_SHAPES = {
    "embed": (KNOWN + OTHER, WIDTH),
    "place": (WINDOW, WIDTH),
    "query": (WIDTH, WIDTH),
    "key": (WIDTH, WIDTH),
    "value": (WIDTH, WIDTH),
    "mix": (WIDTH, WIDTH),
    "up": (WIDTH, HIDDEN),
    "up_bias": (HIDDEN,),
    "head": (HIDDEN, GROUPS + MEMBERS),
    "group_bias": (GROUPS,),
    "member_bias": (GROUPS, MEMBERS),
}
_STOPS = dict(zip(_SHAPES, np.cumsum([int(np.prod(s)) for s in _SHAPES.values()]).tolist()))
SIZE = max(_STOPS.values())
_SEEN = np.tril(np.ones((WINDOW, WINDOW), "f4"))
#: Sums each of the two parts of the logits.
_HALVES = np.repeat(np.eye(2, dtype="f4"), [GROUPS, MEMBERS], axis=0)
_PARTS = np.ascontiguousarray(_HALVES.T)
_CHOSEN = np.eye(GROUPS, dtype="f4")
_SCALE = np.float32(WIDTH**-0.5)
_ONES = np.ones((WINDOW, 1), "f4")
_ZEROS = np.zeros((max(CHUNK, SCORE_CHUNK) * WINDOW, HIDDEN), "f4")


def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parameters in one vector."""
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        out[name] = flat[at : _STOPS[name]].reshape(shape)
        at = _STOPS[name]
    return out


@dataclass
class Vocabulary:
    """Classes, embedding rows and shares within the class of ids 0 .. n-1."""

    row: np.ndarray
    cls: np.ndarray
    log_share: np.ndarray
    class_counts: np.ndarray


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """From the corpus counts of all ids (each also gets one smoothing count)."""
    order = np.argsort(-counts, kind="stable")
    smooth = counts.astype("f8") + 1
    row = np.empty(len(counts), "i4")
    row[order[:KNOWN]] = np.arange(min(KNOWN, len(counts)))
    rest = order[KNOWN:]
    row[rest] = KNOWN + rest % OTHER
    cls = np.empty(len(counts), "i4")
    cls[order[:OWN]] = np.arange(min(OWN, len(counts)))
    tail = order[OWN:]
    mass, bands = np.cumsum(smooth[tail]), CLASSES - OWN
    if len(tail):
        cls[tail] = OWN + np.minimum(bands - 1, (mass - smooth[tail]) * bands // mass[-1])
    totals = np.bincount(cls, smooth, CLASSES)
    return Vocabulary(row, cls, np.log(smooth / totals[cls]).astype("f4"), totals)


def start(vocab: Vocabulary, seed: int = 11) -> np.ndarray:
    """Small random weights; the biases are those of the class counts."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(SIZE, "f4")
    p = parts(flat)
    for name in ("embed", "place"):
        p[name][:] = rng.normal(0, 0.1, p[name].shape)
    for name in ("query", "key", "value", "mix", "up", "head"):
        p[name][:] = rng.normal(0, p[name].shape[0] ** -0.5, p[name].shape)
    counts = (vocab.class_counts + 1).reshape(GROUPS, MEMBERS)
    p["group_bias"][:] = np.log(counts.sum(1) / counts.sum())
    p["member_bias"][:] = np.log(counts / counts.sum(1, keepdims=True))
    return flat


def _folded(p: dict) -> dict:
    """The parameters with ``asks``, (scaled) queries multiplied by keys, and ``gives``, values multiplied by the mix."""
    return p | {"asks": p["query"] @ p["key"].T * _SCALE, "gives": p["value"] @ p["mix"]}


def _forward(p: dict, rows: np.ndarray, since: int = 0) -> dict:
    """The block on windows of embedding rows, for the places from ``since`` on; ``a`` over ``sums`` are the attention weights.

    Keys and mix need no products of their own: they are in ``q`` and ``v`` (see ``_folded``).
    Here and in ``step`` what is wide stays contiguous, and sums along short axes are
    products with ones: numpy pays for each short inner loop.
    """
    n = len(rows)
    p = p if "asks" in p else _folded(p)
    x = np.take(p["embed"], rows.ravel(), axis=0).reshape(n, WINDOW, WIDTH)
    x += p["place"]
    own = np.ascontiguousarray(x[:, since:]).reshape(-1, WIDTH)
    q, v = (y.reshape(n, -1, WIDTH) for y in (own @ p["asks"], x.reshape(-1, WIDTH) @ p["gives"]))
    a = np.matmul(q, np.ascontiguousarray(x.transpose(0, 2, 1)))
    if a.max(initial=0) > _CEILING:
        np.minimum(a, _CEILING, out=a)
    np.exp(a, out=a)
    a *= _SEEN[since:]
    sums = a.reshape(-1, WINDOW) @ _ONES
    o = np.matmul(a, v).reshape(-1, WIDTH)
    o /= sums
    return {"x": x, "q": q, "v": v, "a": a, "sums": sums, "o": o, "h": o + own}


def _biases(p: dict) -> np.ndarray:
    """Of the logits of each group: those of the groups and of its members."""
    return np.hstack([np.broadcast_to(p["group_bias"], (GROUPS, GROUPS)), p["member_bias"]])


def _logits(p: dict, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rectified layer, and the logits of the groups and of the members of ``group``."""
    up = h @ p["up"]
    up += p["up_bias"]
    np.maximum(up, _ZEROS[: len(up)] if len(up) <= len(_ZEROS) else 0, out=up)  # with an array four times as quick as with a number
    z = up @ p["head"]
    z += np.take(p["bias"] if "bias" in p else _biases(p), group, axis=0)
    if z.max(initial=0) > _CEILING:
        np.minimum(z, _CEILING, out=z)
    return up, z


def _split(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups and members of classes, in a row."""
    cls = cls.ravel().astype("i8")
    group = cls // MEMBERS
    return group, cls - group * MEMBERS


def _target_places(group: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the targets' logits stand in the flattened logits."""
    at = np.arange(0, len(group) * (GROUPS + MEMBERS), GROUPS + MEMBERS)
    return at + group, at + (member + GROUPS)


def _across(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y of long thin matrices, in 8 parts: BLAS is slow on the whole."""
    part = lambda m: m.reshape(8, -1, m.shape[1])
    return np.matmul(part(x).transpose(0, 2, 1), part(y)).sum(0)


def _descend(flat: np.ndarray, memory: np.ndarray, at, grad: np.ndarray, rate: float) -> None:
    """The step at some parameters; where the gradient is 0, nothing would change."""
    squares = grad * grad
    squares += memory[at] if isinstance(at, slice) else np.take(memory, at, axis=0)
    memory[at] = squares
    squares += np.float32(1e-8)
    grad *= np.float32(-rate)
    grad /= np.sqrt(squares, out=squares)
    if isinstance(at, slice):
        flat[at] += grad
    else:  # quicker than to add in place
        grad += np.take(flat, at, axis=0)
        flat[at] = grad


def step(flat: np.ndarray, memory: np.ndarray, rows: np.ndarray, targets: np.ndarray, weight: np.ndarray, rate: float) -> float:
    """One step of stochastic gradient descent (with per-parameter rates); the mean loss before it.

    ``rows`` and ``targets``: windows x WINDOW embedding rows and next classes;
    ``weight`` 0 where a window has ended.
    """
    p, g = parts(flat), {}
    p = _folded(p)
    f = _forward(p, rows)
    group, member = _split(targets)
    first, second = _target_places(group, member)
    h, x, a, one = f["h"], f["x"], f["a"], np.ones((1, len(group)), "f4")
    up, e = _logits(p, h, group)
    z = e.ravel()
    right = np.take(z, first) + np.take(z, second)
    np.exp(e, out=e)
    sums = e @ _HALVES
    w = weight.ravel().astype("f4")
    whole = np.float32(max(1.0, float(w.sum())))
    loss = float((np.log(sums[:, 0] * sums[:, 1]) - right) @ w / whole)
    w /= whole
    e *= (w[:, None] / sums) @ _PARTS
    z[first] -= w
    z[second] -= w
    g["head"] = _across(up, e)
    biases = _across(np.take(_CHOSEN, group, axis=0), e)
    g["group_bias"], g["member_bias"] = biases[:, :GROUPS].sum(0), biases[:, GROUPS:]
    d_up = e @ p["head"].T
    d_up *= up > 0
    g["up"], g["up_bias"] = h.T @ d_up, one @ d_up
    d_h = d_up @ p["up"].T
    d_o = d_h / f["sums"]
    # over a row, the sum of weights times their gradients is that of output times its gradient
    inner = (d_o * f["o"]) @ _ONES[:WIDTH]
    d_o = d_o.reshape(-1, WINDOW, WIDTH)
    d_s = np.matmul(d_o, np.ascontiguousarray(f["v"].transpose(0, 2, 1)))
    d_s -= inner.reshape(-1, WINDOW, 1)
    d_s *= a
    d = np.empty((len(rows), WINDOW, 2 * WIDTH), "f4")
    np.matmul(d_s, x, out=d[:, :, :WIDTH])
    np.matmul(a.transpose(0, 2, 1), d_o, out=d[:, :, WIDTH:])
    d = d.reshape(-1, 2 * WIDTH)
    d_pair = _across(x.reshape(-1, WIDTH), d)
    d_q, d_v = d_pair[:, :WIDTH] * _SCALE, d_pair[:, WIDTH:]
    g["query"], g["key"] = d_q @ p["key"], d_q.T @ p["query"]
    g["value"], g["mix"] = d_v @ p["mix"].T, p["value"].T @ d_v
    d_x = d_h
    d_x += np.matmul(d_s.transpose(0, 2, 1), f["q"]).reshape(-1, WIDTH)
    d_x += d @ np.vstack([p["asks"].T, p["gives"].T])
    g["place"] = np.ones((1, len(rows)), "f4") @ d_x.reshape(len(rows), -1)
    order = np.argsort(rows.ravel().astype("u2"), kind="stable")
    at = np.take(rows.ravel(), order)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    # complex numbers: two sums in each of numpy's inner loops
    summed = np.add.reduceat(np.take(d_x, order, axis=0).view("c8"), starts, axis=0).view("f4")
    _descend(p["embed"], parts(memory)["embed"], at[starts], summed, rate)
    _descend(flat, memory, slice(_STOPS["embed"], None), np.concatenate([g[name].ravel() for name in _SHAPES if name != "embed"]), rate)
    return loss


def fresh_memory() -> np.ndarray:
    """The sums of squared gradients that training starts with."""
    return np.full(SIZE, 1e-4, "f4")


def windows(begins: np.ndarray, sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, number within it, first place) of windows of WINDOW inputs, ``step`` apart.

    They cover every id of the sequences that begin at ``begins``, but the first id as a target.
    """
    inputs = sizes - 1  # the last id is a target only
    per = np.where(inputs > 0, 1 + np.maximum(0, -(-(inputs - WINDOW) // step)), 0)
    owner = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    return owner, number, begins[owner] + step * number


def padded(ids: np.ndarray) -> np.ndarray:
    return np.concatenate([ids, np.zeros(WINDOW + 1, ids.dtype)])


def _places(tables: tuple, ids: np.ndarray) -> list[np.ndarray]:
    """Each table's entries for all ids, and some more so that the last windows are whole."""
    at = padded(ids).astype(np.intp)
    return [np.take(table, at) for table in tables]


def _views(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` values from each place on."""
    return np.lib.stride_tricks.sliding_window_view(values, width)


def train(flat: np.ndarray, vocab: Vocabulary, ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, epochs: int, rate: float, seed: int, memory: np.ndarray | None = None) -> np.ndarray:
    """Train on windows that cover the sequences whole, in random order: each id but a first one is a target once an epoch.

    A ``memory`` that is given is updated in place, so that training can go on later.
    """
    flat, rng = flat.copy(), np.random.default_rng(seed)
    memory = fresh_memory() if memory is None else memory
    owner, number, first = windows(begins, sizes, WINDOW)
    real, span = sizes[owner] - 1 - WINDOW * number, np.arange(WINDOW)
    rows, classes = (_views(x, WINDOW) for x in _places((vocab.row, vocab.cls), ids))
    for _ in range(epochs):
        order = rng.permutation(len(first))
        for k in range(0, len(order), CHUNK):
            some = order[k : k + CHUNK]
            at = first[some]
            step(flat, memory, rows[at], classes[at + 1], span < real[some, None], rate)
    return flat


def log_probabilities(flat: np.ndarray, vocab: Vocabulary, ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log probability of each sequence ``ids[begin : begin + size]`` after its given first id.

    Windows of WINDOW inputs overlap by WINDOW - STRIDE; a window after the first
    scores only what the one before did not, so each id is scored once, with at
    least WINDOW - STRIDE ids before it.
    """
    owner, number, first = windows(begins, sizes, STRIDE)
    p, scores = _folded(parts(flat)), np.zeros(len(owner))
    p["bias"] = _biases(p)
    rows, classes, shares = _places((vocab.row, vocab.cls, vocab.log_share), ids)
    rows = _views(rows, WINDOW)
    for since, which in ((0, np.flatnonzero(number == 0)), (WINDOW - STRIDE, np.flatnonzero(number))):
        width = WINDOW - since
        targets, extra, span = _views(classes[since + 1 :], width), _views(shares[since + 1 :], width), np.arange(width)
        for k in range(0, len(which), SCORE_CHUNK):
            some = which[k : k + SCORE_CHUNK]
            at = first[some]
            group, member = _split(targets[at])
            z = _logits(p, _forward(p, rows[at], since)["h"], group)[1]
            places = _target_places(group, member)
            right = np.take(z, places[0]) + np.take(z, places[1])
            np.exp(z, out=z)
            sums = z @ _HALVES
            right -= np.log(sums[:, 0] * sums[:, 1])
            right = right.reshape(-1, width) + extra[at]
            inside = sizes[owner[some]] - 1 - STRIDE * number[some] - since
            scores[some] = (right * (span < inside[:, None])).sum(1)
    return np.bincount(owner, scores, len(sizes))
