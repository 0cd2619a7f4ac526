"""A gated recurrent network with a class-factored softmax: training by truncated backpropagation and scoring, in numpy.

The input of a step is the token before: a learned word, the shape of another word, or a text's start. The output is a softmax over classes,
and for the classes of learned words a softmax over the words of the class. Classes are runs of word numbers. Single precision throughout.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

WEIGHTS = ("embed", "wx", "wh", "bx", "bh", "wo", "bo", "ww", "bw")
LEAST_LANES, MOST_LANES, LANE_TOKENS = 16, 256, 4096  # texts read side by side, and the tokens a lane has at least if there are fewer
MOST_SCORE = 70.0
HELD = 32_768  # states kept before their outputs are worked out together


@dataclass(frozen=True)
class Layout:
    """``others`` classes without learned words come first; learned word w is in the class of the last of ``firsts`` (ascending, from 0) that it reaches."""

    words: int
    firsts: np.ndarray
    others: int

    @property
    def classes(self) -> int:
        return self.others + len(self.firsts)

    @property
    def start(self) -> int:
        """The input that begins a text; before it stand the words, then the other classes."""
        return self.words + self.others

    def class_of(self, codes: np.ndarray) -> np.ndarray:
        """Classes of codes: below ``words`` learned words, from there on the other classes."""
        return np.where(codes < self.words, self.others + np.searchsorted(self.firsts, codes, side="right") - 1, codes - self.words)

    def bounds(self, k: int) -> tuple[int, int]:
        """The words of the k-th class of learned words."""
        return int(self.firsts[k]), int(self.firsts[k + 1]) if k + 1 < len(self.firsts) else self.words


def start(layout: Layout, hidden: int, width: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    of = lambda n, m, size: (rng.standard_normal((n, m)) * size**-0.5).astype(np.float32)
    zeros = lambda n: np.zeros(n, np.float32)
    return {
        "embed": of(layout.start + 1, width, 4 * width), "wx": of(width, 3 * hidden, width), "wh": of(hidden, 3 * hidden, hidden), "bx": zeros(3 * hidden), "bh": zeros(3 * hidden),
        "wo": of(hidden, layout.classes, 4 * hidden), "bo": zeros(layout.classes), "ww": of(layout.words, hidden, 16 * hidden), "bw": zeros(layout.words),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _step(m: dict, inputs: np.ndarray, h: np.ndarray):
    """inputs: the tokens' part of the three gates. Returns the new state and what the backward pass needs."""
    k = h.shape[1]
    own = h @ m["wh"] + m["bh"]
    gates = _sigmoid(inputs[:, : 2 * k] + own[:, : 2 * k])
    z, r = gates[:, :k], gates[:, k:]
    c = np.tanh(inputs[:, 2 * k :] + r * own[:, 2 * k :])
    return c + z * (h - c), (z, r, c, own[:, 2 * k :])


def _chosen(scores: np.ndarray, goal: np.ndarray, backward: bool):
    """Log of the softmax at each row's goal; with ``backward`` also the softmax less one at the goal. scores are overwritten; they stay
    far below MOST_SCORE, which only keeps the exponential within single precision."""
    every = np.arange(len(goal))
    np.minimum(scores, MOST_SCORE, out=scores)
    own = scores[every, goal]
    np.exp(scores, out=scores)
    whole = scores @ np.ones(scores.shape[1], scores.dtype) + 1e-30
    if backward:
        scores /= whole[:, None]
        scores[every, goal] -= 1
    return own - np.log(whole), scores


def outputs(m: dict, layout: Layout, h: np.ndarray, goal: np.ndarray, backward: bool = False):
    """Natural log of each goal's probability after state h: its class, and in a class of learned words its share. With ``backward`` also the
    gradients of the sum of -log: of h, and of wo, bo, ww, bw."""
    classes = layout.class_of(goal)
    logs, p = _chosen(h @ m["wo"] + m["bo"], classes, backward)
    g = {}
    if backward:
        g = {"wo": h.T @ p, "bo": p.sum(0), "ww": np.zeros_like(m["ww"]), "bw": np.zeros_like(m["bw"])}
        dh = p @ m["wo"].T
    order = np.argsort(classes, kind="stable")
    ends = np.searchsorted(classes[order], np.arange(layout.others, layout.classes + 1))
    for k in range(len(layout.firsts)):
        mine = order[ends[k] : ends[k + 1]]
        low, high = layout.bounds(k)
        if not len(mine) or high - low == 1:
            continue
        own = h[mine]
        found, q = _chosen(own @ m["ww"][low:high].T + m["bw"][low:high], goal[mine] - low, backward)
        logs[mine] += found
        if backward:
            g["ww"][low:high], g["bw"][low:high] = q.T @ own, q.sum(0)
            dh[mine] += q @ m["ww"][low:high]
    return (logs, dh, g) if backward else logs


class Learner:
    """Learns from whole texts by truncated backpropagation with Adam, beginning from given weights."""

    def __init__(self, m: dict[str, np.ndarray], layout: Layout, window: int = 24, rate: float = 0.01):
        self.m = {k: v.copy() for k, v in m.items()}
        self.first, self.second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
        self.layout, self.window, self.rate, self.steps, self.tokens = layout, window, rate, 0, 0

    def learn(self, codes: np.ndarray, bounds: np.ndarray) -> None:
        """One pass over texts (codes, bounds): each token of each text is a target once.

        Texts are dealt whole to lanes, the longest first, each to the shortest lane. Lanes advance side by side in windows with their
        states carried on, and stop as they end; a text's start clears the state. A token weighs the same in full and in sparse windows.
        """
        if not len(codes):
            return
        begin, hidden = self.layout.start, self.m["wo"].shape[0]
        before = np.append(begin, codes[:-1])
        before[bounds[:-1]] = begin
        lanes = deal(np.diff(bounds), min(MOST_LANES, max(LEAST_LANES, len(codes) // LANE_TOKENS)))
        parts = [np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in lane]) for lane in lanes]
        parts.sort(key=len, reverse=True)
        lengths = np.array([len(x) for x in parts])
        scale = np.float32(1 / (len(parts) * self.window))
        h = np.zeros((len(parts), hidden), np.float32)
        at = 0
        while at < lengths[0]:
            n = int(np.searchsorted(-lengths, -at))
            steps = int(min(self.window * min(8, len(parts) // n), lengths[0] - at))  # fewer lanes go further in a window
            inputs, targets = np.full((steps, n), begin), np.full((steps, n), -1)
            for i, own in enumerate(parts[:n]):
                place = own[at : at + steps]
                inputs[: len(place), i], targets[: len(place), i] = before[place], codes[place]
            g, h, _ = gradients(self.m, self.layout, inputs, targets, h[:n], scale)
            self._move(g)
            at += steps
        self.tokens += len(codes)

    def _move(self, g: dict[str, np.ndarray]) -> None:
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        self.steps += 1
        for k, v in self.m.items():
            grad = g[k] * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            self.first[k] += np.float32(0.1) * (grad - self.first[k])
            self.second[k] += np.float32(0.001) * (grad * grad - self.second[k])
            slow, fast = np.float32(self.rate / (1 - 0.9**self.steps)), np.float32(1 / (1 - 0.999**self.steps))
            v -= slow * self.first[k] / (np.sqrt(self.second[k] * fast) + np.float32(1e-8))


def deal(lengths: np.ndarray, n: int) -> list[list[int]]:
    """Text numbers of at most n lanes: the longest text first, each to the shortest lane."""
    heap = [(0, k) for k in range(min(n, len(lengths)))]
    lanes: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-lengths, kind="stable").tolist():
        length, k = heap[0]
        lanes[k].append(i)
        heapq.heapreplace(heap, (length + int(lengths[i]), k))
    return lanes


def gradients(m: dict[str, np.ndarray], layout: Layout, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, scale: float):
    """Gradients of scale times the loss over a window (steps, lanes), the state after it, and the loss in nats.

    The input ``layout.start`` begins a text and clears the state; the target -1 pads a lane that has ended.
    """
    hidden = m["wo"].shape[0]
    met, place = np.unique(inputs, return_inverse=True)
    place = place.reshape(inputs.shape)
    table = m["embed"][met] @ m["wx"] + m["bx"]
    fed, on = table[place], (inputs != layout.start)[:, :, None].astype(h.dtype)
    shape = (*inputs.shape, hidden)
    old, new, z, r, c, own = (np.empty(shape, h.dtype) for _ in range(6))
    for t in range(len(inputs)):
        old[t] = h * on[t]
        h, (z[t], r[t], c[t], own[t]) = _step(m, fed[t], old[t])
        new[t] = h
    flat, goal = new.reshape(-1, hidden), targets.ravel()
    used = np.flatnonzero(goal >= 0)
    logs, dh_used, g = outputs(m, layout, flat[used], goal[used], backward=True)
    above = np.zeros_like(flat)
    above[used] = dh_used * scale
    above, g = above.reshape(shape), {k: v * scale for k, v in g.items()}
    by_c, by_z, by_r = (1 - z) * (1 - c * c), (old - c) * z * (1 - z), own * r * (1 - r)
    gates, inner = (np.empty((*inputs.shape, 3 * hidden), h.dtype) for _ in range(2))
    back, turned = np.zeros_like(h), m["wh"].T.copy()
    for t in reversed(range(len(inputs))):
        dh = back + above[t]
        dc = dh * by_c[t]
        inner[t, :, :hidden] = dh * by_z[t]
        inner[t, :, hidden : 2 * hidden] = dc * by_r[t]
        inner[t, :, 2 * hidden :] = dc * r[t]
        gates[t, :, 2 * hidden :] = dc
        back = (dh * z[t] + inner[t] @ turned) * on[t]
    gates[:, :, : 2 * hidden] = inner[:, :, : 2 * hidden]
    order = np.argsort(place.ravel(), kind="stable")
    starts = np.searchsorted(place.ravel()[order], np.arange(len(met)))
    dtable = np.add.reduceat(gates.reshape(-1, 3 * hidden)[order], starts, axis=0)
    inner = inner.reshape(-1, 3 * hidden)
    embed = np.zeros_like(m["embed"])
    embed[met] = dtable @ m["wx"].T
    g |= {"embed": embed, "wx": m["embed"][met].T @ dtable, "wh": old.reshape(-1, hidden).T @ inner, "bx": dtable.sum(0), "bh": inner.sum(0)}
    return g, h, -float(logs.sum())


def flattened(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in WEIGHTS]).astype(np.float64)


def unflattened(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([like[k].size for k in WEIGHTS])
    return {k: v.reshape(like[k].shape).astype(np.float32) for k, v in zip(WEIGHTS, np.split(values, ends[:-1]), strict=True)}


def score(m: dict[str, np.ndarray], layout: Layout, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural-log probability of each text's run of codes; states go on to the end of each text.

    Texts of a batch advance side by side, the longest first, so a step holds those not yet ended; outputs are worked out for many steps together.
    """
    hidden = m["wo"].shape[0]
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    starts, left = bounds[:-1][order], lengths[order]
    table = m["embed"] @ m["wx"] + m["bx"]
    total = np.zeros(len(order))
    h = np.zeros((len(order), hidden), np.float32)
    inputs = np.full(len(order), layout.start)
    alive = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
    states: list[np.ndarray] = []
    goals: list[np.ndarray] = []

    def settle() -> None:
        if states:
            logs = outputs(m, layout, np.concatenate(states), np.concatenate(goals))
            total[:] += np.bincount(np.concatenate([np.arange(len(x)) for x in goals]), logs, len(total))
            states.clear()
            goals.clear()

    held = 0
    for t, n in enumerate(alive.tolist()):
        h, _ = _step(m, table[inputs[:n]], h[:n])
        inputs = codes[starts[:n] + t]
        states.append(h)
        goals.append(inputs)
        held += n
        if held >= HELD:
            settle()
            held = 0
    settle()
    out = np.empty(len(order))
    out[order] = total
    return out
