"""Linear-chain conditional random fields in numpy, batched over many sequences.

Sequences are laid out longest first and padded by shrinking the active prefix, so a step costs one
small array operation for all sequences that still run. Potentials are kept as scaled probabilities.
"""

from __future__ import annotations

import numpy as np

#: Longer sequences are cut into windows of so many words, read with so many neighbours.
LONGEST, CONTEXT = 512, 32


class Layout:
    """Order of the words of many sequences by (step, sequence), longest sequence first."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        steps = int(ordered[0]) if len(ordered) else 0
        self.active = np.searchsorted(-ordered, -np.arange(steps), "left")  # sequences longer than t
        self.base = np.concatenate([[0], np.cumsum(self.active)])
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        n = int(lengths.sum())
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        step = np.arange(n) - np.repeat(first, lengths)
        #: place of each word (in reading order) in the layout
        self.place = self.base[step] + np.repeat(rank, lengths)


def forward_backward(layout: Layout, scores: np.ndarray, transitions: np.ndarray, keep_alpha: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (words x labels, reading order), and the scaled forward values or nothing."""
    top = scores.max(axis=1, keepdims=True)
    e = np.empty_like(scores)
    e[layout.place] = np.exp(scores - top)
    move = np.exp(transitions)
    steps = len(layout.active)
    alpha = np.empty_like(e)
    for t in range(steps):
        a, n = layout.base[t], layout.active[t]
        x = e[a : a + n]
        if t:
            p = layout.base[t - 1]
            x = x * (alpha[p : p + n] @ move)
        alpha[a : a + n] = x / x.sum(axis=1)[:, None]
    beta = np.ones((layout.active[0] if steps else 0, scores.shape[1]), scores.dtype)
    gamma = alpha.copy() if keep_alpha else alpha
    for t in range(steps - 2, -1, -1):
        a, n, m = layout.base[t], layout.active[t], layout.active[t + 1]
        b = layout.base[t + 1]
        back = (e[b : b + m] * beta[:m]) @ move.T
        beta[:m] = back / back.sum(axis=1, keepdims=True)
        beta[m:n] = 1.0
        g = gamma[a : a + n] * beta[:n]
        gamma[a : a + n] = g / g.sum(axis=1, keepdims=True)
    return gamma[layout.place], alpha[layout.place] if keep_alpha else None


def viterbi(layout: Layout, scores: np.ndarray, transitions: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Best label of every word, reading order."""
    n_labels = scores.shape[1]
    s = np.empty_like(scores)
    s[layout.place] = scores
    if start is not None and len(layout.active):
        s[: layout.active[0]] += start
    back = np.zeros(s.shape, np.int8)
    steps = len(layout.active)
    best = np.empty((layout.active[0] if steps else 0, n_labels), scores.dtype)
    for t in range(steps):
        a, n = layout.base[t], layout.active[t]
        if t:
            options = best[:n, :, None] + transitions[None]
            pick = options.argmax(axis=1)
            back[a : a + n] = pick
            best[:n] = np.take_along_axis(options, pick[:, None, :], 1)[:, 0] + s[a : a + n]
        else:
            best[:n] = s[a : a + n]
    # a sequence ends where the active prefix shrinks; its own best row was last written there
    label = best.argmax(axis=1)
    out = np.zeros(len(s), np.int8)
    for t in range(steps - 1, -1, -1):
        a, n = layout.base[t], layout.active[t]
        out[a : a + n] = label[:n]
        if t:
            label[:n] = back[np.arange(a, a + n), label[:n]]
    return out[layout.place]


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Sequences of over LONGEST words in windows with CONTEXT words of their neighbours on both sides: the words of all windows, their
    lengths, and which words a window answers for (each word once, in order). None if no sequence is that long."""
    if not (lengths > LONGEST).any():
        return None
    words, sizes, own = [], [], []
    end = np.cumsum(lengths)
    for a, b in zip((end - lengths).tolist(), end.tolist()):
        for c in range(a, b, LONGEST):
            low, high = (max(a, c - CONTEXT), min(b, c + LONGEST + CONTEXT))
            words.append(np.arange(low, high))
            sizes.append(high - low)
            own.append((words[-1] >= c) & (words[-1] < c + LONGEST))
    return np.concatenate(words), np.array(sizes, np.int64), np.concatenate(own)


def marginals(lengths: np.ndarray, scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Marginals of every word, long sequences by windows: a step costs the same for one long line as for many short ones."""
    cut = windows(lengths)
    if cut is None:
        return forward_backward(Layout(lengths), scores, transitions)[0]
    words, sizes, own = cut
    return forward_backward(Layout(sizes), scores[words], transitions)[0][own]


def labels(lengths: np.ndarray, scores: np.ndarray, transitions: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Best label of every word, long sequences by windows."""
    cut = windows(lengths)
    if cut is None:
        return viterbi(Layout(lengths), scores, transitions, start)
    words, sizes, own = cut
    return viterbi(Layout(sizes), scores[words], transitions, start)[own]


def fit(lengths: np.ndarray, rows: np.ndarray, owner: np.ndarray, n_features: int, labels: np.ndarray, n_labels: int, steps: int = 60, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels) and transitions by adaptive gradient steps on the mean log likelihood a word.

    rows and owner are the features of all words: word owner[k] has feature rows[k].
    """
    layout = Layout(lengths)
    n = len(labels)
    w, t = np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels))
    gold = np.zeros((n, n_labels))
    gold[np.arange(n), labels] = 1
    first = np.concatenate([[0], np.cumsum(lengths)])
    inner = np.ones(n, np.bool_)
    inner[first[:-1][lengths > 0]] = False
    now = np.flatnonzero(inner)
    gold_t = np.zeros_like(t)
    np.add.at(gold_t, (labels[now - 1], labels[now]), 1)
    sq_w, sq_t = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    for _ in range(steps):
        scores = np.zeros((n, n_labels))
        for y in range(n_labels):
            scores[:, y] = np.bincount(owner, w[rows, y], n)
        g, alpha = forward_backward(layout, scores, t, True)
        diff = gold - g
        grad = np.empty_like(w)
        for y in range(n_labels):
            grad[:, y] = np.bincount(rows, diff[owner, y], n_features)
        grad = grad / n - decay * w
        # pair marginals summed over words: alpha, transition and what each target's share is of all ways to it
        before, move = alpha[now - 1], np.exp(t)
        pairs = move * (before.T @ (g[now] / np.maximum(before @ move, 1e-300)))
        grad_t = (gold_t - pairs) / n - decay * t
        sq_w += grad**2
        sq_t += grad_t**2
        w += rate * grad / np.sqrt(sq_w)
        t += rate * grad_t / np.sqrt(sq_t)
    return w, t
