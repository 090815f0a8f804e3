"""A gated recurrent unit with a class-factored softmax, in numpy, over integer token ids."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, fields, replace
from itertools import pairwise, repeat

import numpy as np

#: Width of embeddings and state, classes of words, tokens of a training and of a scoring window.
WIDTH, CLASSES, TRAIN_WINDOW, SCORE_WINDOW = 16, 24, 32, 64
#: Lanes of texts side by side at most, and at least; Adam's step size.
LANES_TRAIN, LANES_SCORE, LEAST_LANES, RATE = 192, 512, 32, 0.012


@dataclass
class Gru:
    """Ids 0 to n - 1 are the n words of the net by falling frequency.

    A word's class is its id // members. Rarer words have the ids beyond these classes, one for
    each tail class; the net gives a tail class its chance and leaves its words to their counts.
    inputs: embeddings; into, state and bias: what an input and the state add to the gates
    (reset, update, candidate); by_class, by_word: the output layers with their biases.
    """

    inputs: np.ndarray
    into: np.ndarray
    state: np.ndarray
    bias: np.ndarray
    by_class: np.ndarray
    class_bias: np.ndarray
    by_word: np.ndarray
    word_bias: np.ndarray

    @property
    def members(self) -> int:
        return self.word_bias.shape[1]

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    def load(self, vector: np.ndarray) -> Gru:
        """Takes its weights from vector; they are parts of it if it is of float32."""
        at = 0
        for f in fields(self):
            old = getattr(self, f.name)
            setattr(self, f.name, vector[at : at + old.size].reshape(old.shape).astype(np.float32, copy=False))
            at += old.size
        return self


def shape_of(words: int) -> tuple[int, int]:
    """Classes that so many words fill, and members of each; the first tail class has the id that is their product."""
    members = max(1, -(-words // CLASSES))
    return -(-words // members), members


def start(counts: np.ndarray, tails: np.ndarray, seed: int = 11) -> Gru:
    """A net that gives each word and each tail class its share of the counts, whatever came before."""
    rng = np.random.default_rng(seed)
    words = len(counts)
    used, members = shape_of(words)
    padded = np.full(used * members, 0.0)
    padded[:words] = counts + 0.5
    share = padded.reshape(used, members)
    mass = np.append(share.sum(axis=1), np.asarray(tails) + 0.5)
    with np.errstate(divide="ignore"):
        word_bias = np.maximum(np.log(share / share.sum(axis=1, keepdims=True)), -60)
    f = lambda *shape, scale=0.1: rng.normal(0, scale, shape).astype(np.float32)
    return Gru(
        f(used * members + len(tails), WIDTH, scale=0.3), f(WIDTH, 3 * WIDTH, scale=0.25), f(WIDTH, 3 * WIDTH, scale=0.25), np.zeros(3 * WIDTH, np.float32),
        f(WIDTH, used + len(tails), scale=0.01), np.log(mass / mass.sum()).astype(np.float32), f(used, WIDTH, members, scale=0.01), word_bias.astype(np.float32),
    )


def run(net: Gru, ids: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None, keep: bool = False):
    """States (time, lane, WIDTH) after each of ids (time, lane), the last of them, and what a backward pass needs.

    fresh (time, lane) says where a text begins: there the state is 0. In memory lanes lie last,
    so that a gate of all lanes is one block. The gates' inputs are negated, as their sigmoid wants them.
    """
    d, steps, lanes = WIDTH, *ids.shape
    given = np.append(net.inputs, np.ones((len(net.inputs), 1), np.float32), axis=1)[ids]
    into, state = np.vstack((net.into, net.bias)).T.copy(), net.state.T.copy()
    into[: 2 * d] *= -1
    state[: 2 * d] *= -1
    x = into @ given.transpose(0, 2, 1)
    states, news = (np.empty((steps, d, lanes), np.float32) for _ in range(2))
    gates, us = np.empty((steps, 2 * d, lanes), np.float32), np.empty((steps if keep else 1, 3 * d, lanes), np.float32)
    begins = fresh.any(axis=1).tolist() if fresh is not None else [False] * steps
    first = h = h.T
    views = zip(begins, x[:, : 2 * d], x[:, 2 * d :], gates, gates[:, :d], gates[:, d:], news, states, us if keep else repeat(us[0]))
    for t, (begin, x_gates, x_new, gate, r, z, new, out, u) in enumerate(views):
        if begin:
            h = np.where(fresh[t], np.float32(0), h)
        np.matmul(state, h, out=u)
        np.add(x_gates, u[: 2 * d], out=gate)
        np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        np.multiply(r, u[2 * d :], out=new)
        new += x_new
        np.tanh(new, out=new)
        np.subtract(h, new, out=out)
        out *= z
        out += new
        h = out
    kept = None
    if keep:
        before = np.concatenate((first[None], states[:-1]))
        if fresh is not None:
            before *= ~fresh[:, None]
        kept = given, before, gates[:, :d], gates[:, d:], news, us[:, 2 * d :]
    return states.transpose(0, 2, 1), h.T, kept


def widened(states: np.ndarray) -> np.ndarray:
    """The states with a last column of ones, which biases are multiplied by."""
    out = np.ones((len(states), states.shape[1] + 1), np.float32)
    out[:, :-1] = states
    return out


def shift(weights: np.ndarray, reach: float) -> np.ndarray | None:
    """What may be subtracted from all logits, for states within +-reach, so that no row's exponentials overflow or vanish.

    The last two axes of weights are inputs, of which the last is 1, and outputs. None if there is no such number.
    """
    far, bias = np.abs(weights[..., :-1, :]).sum(axis=-2) * reach, weights[..., -1, :]
    most, sure = (bias + far).max(axis=-1), (bias - far).max(axis=-1)
    return most if (most - sure).max() < 60 else None


def choice(x: np.ndarray, chosen: np.ndarray, shifted: bool, grads: bool) -> np.ndarray:
    """The log of each row's softmax at chosen; with grads, x becomes the gradient of its negative."""
    rows = np.arange(len(x))
    if not shifted:
        x -= x.max(axis=1, keepdims=True)
    out = x[rows, chosen]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    if grads:
        x *= (1 / total)[:, None]
        x[rows, chosen] -= 1
    return out - np.log(total)


def log_likelihood(net: Gru, states: np.ndarray, targets: np.ndarray, grads: Gru | None = None):
    """Natural log-probability of each target, and the loss gradient of the states if grads is given."""
    members, words = net.members, net.word_bias.shape[0]
    kind = np.where(targets < words * members, targets // members, targets - words * (members - 1)).astype(np.min_scalar_type(len(net.class_bias)))
    states = widened(states)
    reach = float(np.abs(states).max(initial=0))
    by_class, by_word = np.vstack((net.by_class, net.class_bias)), np.concatenate((net.by_word, net.word_bias[:, None]), axis=1)
    low, lows = shift(by_class, reach), shift(by_word, reach)
    if low is not None:
        by_class[-1] -= low
    if lows is not None:
        by_word[:, -1] -= lows[:, None]
    x = states @ by_class
    out = choice(x, kind, low is not None, grads is not None).astype(np.float64)
    # Words class by class: one block of logits, a class's rows side by side.
    inner = np.flatnonzero(kind < words)
    inner = inner[np.argsort(kind[inner], kind="stable")]
    s, own = states[inner], kind[inner]
    edges = np.searchsorted(own, np.arange(words + 1, dtype=own.dtype)).tolist()
    spans = [(c, slice(a, b)) for c, (a, b) in enumerate(pairwise(edges)) if a < b]
    y = np.empty((len(inner), members), np.float32)
    for c, part in spans:
        np.matmul(s[part], by_word[c], out=y[part])
    out[inner] += choice(y, targets[inner] - own * np.int64(members), lows is not None, grads is not None)
    if grads is None:
        return out, None
    g = states.T @ x
    grads.by_class += g[:-1]
    grads.class_bias += g[-1]
    back, inner_back = x @ net.by_class.T, np.empty((len(inner), WIDTH), np.float32)
    for c, part in spans:
        g = s[part].T @ y[part]
        grads.by_word[c] += g[:-1]
        grads.word_bias[c] += g[-1]
        np.matmul(y[part], net.by_word[c].T, out=inner_back[part])
    back[inner] += inner_back
    return out, back


@dataclass
class Lanes:
    """Texts side by side, and in each lane one after the other: (time, lane) matrices, longest lane first.

    ids are a lane's tokens, texts the number of the text that each belongs to, fresh where one
    begins; sizes are the lanes' lengths.
    """

    ids: np.ndarray
    texts: np.ndarray
    fresh: np.ndarray
    sizes: np.ndarray

    def windows(self, end: int, window: int):
        """(given, targets, texts, fresh, mask) of each window; lanes that are over are left out."""
        for at in range(0, len(self.ids), window):
            live = int(np.count_nonzero(self.sizes > at))
            part = slice(at, at + window)
            given = np.empty_like(self.ids[part, :live])
            given[1:] = self.ids[part, :live][:-1]
            given[0] = self.ids[at - 1, :live] if at else end
            mask = np.arange(at, at + len(given))[:, None] < self.sizes[None, :live]
            yield given, self.ids[part, :live], self.texts[part, :live], self.fresh[part, :live], mask


def side_by_side(texts: list[np.ndarray], most: int) -> Lanes:
    """Longest first, each text goes to the lane that is shortest; as many lanes as the longest text fits into all, ``most`` at most.

    Every text ends with the end token, so the token before a text is always the end.
    """
    sizes = np.array([len(t) for t in texts])
    lanes = int(np.clip(sizes.sum() // max(1, sizes.max()), min(LEAST_LANES, len(texts)), most))
    heap = [(0, lane) for lane in range(lanes)]
    own: list[list[int]] = [[] for _ in range(lanes)]
    for k in np.argsort(-sizes, kind="stable").tolist():
        length, lane = heap[0]
        own[lane].append(k)
        heapq.heapreplace(heap, (length + int(sizes[k]), lane))
    own.sort(key=lambda ks: -sum(int(sizes[k]) for k in ks))
    lengths = np.array([sizes[ks].sum() for ks in own])
    ids, text, fresh = (np.zeros((int(lengths[0]), lanes), kind) for kind in (np.int32, np.int32, bool))
    for lane, ks in enumerate(own):
        if ks:
            ids[: lengths[lane], lane] = np.concatenate([texts[k] for k in ks])
            text[: lengths[lane], lane] = np.repeat(ks, sizes[ks])
            fresh[np.cumsum(np.append(0, sizes[ks[:-1]])), lane] = True
    return Lanes(ids, text, fresh, lengths)


def score(net: Gru, texts: list[np.ndarray], end: int) -> np.ndarray:
    """log10 P of each text's ids, of which the last is ``end``, given that an end came before.

    A lane's state goes on from window to window through each whole text.
    """
    out = np.zeros(len(texts))
    if not texts:
        return out
    h = np.zeros((LANES_SCORE, WIDTH), np.float32)
    for given, target, text, fresh, mask in side_by_side(texts, LANES_SCORE).windows(end, SCORE_WINDOW):
        states, h, _ = run(net, given, h[: given.shape[1]], fresh)
        logp, _ = log_likelihood(net, states[mask], target[mask])
        out += np.bincount(text[mask], logp, len(texts))
    return out / np.log(10)


class Trainer:
    """Adam over truncated backpropagation through time, on a copy of a net."""

    def __init__(self, net: Gru):
        self.weights, self.steps = net.vector(), 0
        self.net = replace(net).load(self.weights)
        self.gradient, self.m, self.v = (np.zeros_like(self.weights) for _ in range(3))
        self.grads = replace(net).load(self.gradient)

    def fit(self, texts: list[np.ndarray], end: int) -> None:
        """One pass: windows of TRAIN_WINDOW tokens, the state carried on, the gradient cut between windows."""
        h = np.zeros((LANES_TRAIN, WIDTH), np.float32)
        for given, target, _, fresh, mask in side_by_side(texts, LANES_TRAIN).windows(end, TRAIN_WINDOW) if texts else ():
            h = self.step(given, h[: given.shape[1]], target, mask, fresh)

    def step(self, given: np.ndarray, h: np.ndarray, target: np.ndarray, mask: np.ndarray, fresh: np.ndarray | None = None) -> np.ndarray:
        net, grads, d = self.net, self.grads, WIDTH
        self.gradient[:] = 0
        states, last, (inputs, before, r, z, new, u) = run(net, given, h, fresh, keep=True)
        to_states = np.zeros((*given.shape, d), np.float32)
        _, to_states[mask] = log_likelihood(net, states[mask], target[mask], grads)
        to_states = to_states.transpose(0, 2, 1).copy()
        # All that the gradient of a state is multiplied by: for the candidate, the reset and update gates, what the state adds to the candidate, and the state before.
        steps, lanes = given.shape
        factors = np.empty((steps, 5, d, lanes), np.float32)
        to_new = factors[:, 0]
        np.multiply(1 - z, 1 - new * new, out=to_new)
        np.multiply(to_new, r, out=factors[:, 3])
        np.multiply(factors[:, 3], u * (1 - r), out=factors[:, 1])
        np.multiply((before - new) * z, 1 - z, out=factors[:, 2])
        factors[:, 4] = z
        flows = np.empty_like(factors)
        du = flows[:, 1:4].reshape(steps, 3 * d, lanes)
        dh, begins = np.zeros((d, lanes), np.float32), fresh.any(axis=1).tolist() if fresh is not None else [False] * steps
        for t in range(steps - 1, -1, -1):
            dh += to_states[t]
            np.multiply(factors[t], dh, out=flows[t])
            np.matmul(net.state, du[t], out=dh)
            dh += flows[t, 4]
            if begins[t]:
                dh[:, fresh[t]] = 0
        grads.state += np.matmul(before, du.transpose(0, 2, 1)).sum(axis=0)
        dx = np.concatenate((flows[:, 1:3], flows[:, :1]), axis=1).reshape(steps, 3 * d, lanes).transpose(0, 2, 1).reshape(-1, 3 * d)
        by_input = inputs.reshape(-1, d + 1).T @ dx
        grads.into += by_input[:-1]
        grads.bias += by_input[-1]
        ids = given.ravel().astype(np.min_scalar_type(len(net.inputs)))
        order = np.argsort(ids, kind="stable")
        firsts = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
        grads.inputs[ids[order[firsts]]] += np.add.reduceat((dx @ net.into.T)[order], firsts, axis=0)
        g = self.gradient
        g /= max(1, int(mask.sum()))
        self.steps += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        self.weights -= RATE * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.99**self.steps)) + 1e-7)
        return last
