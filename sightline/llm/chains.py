"""Dynamic programs over the words of many texts at once: step t handles word t of every text that is so long."""

from __future__ import annotations

import numpy as np


def by_length(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with words, longest first: where each begins, its length, and the texts' numbers."""
    n = np.diff(starts)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    return starts[:-1][order], n[order], order


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of each word, where a change of state costs penalty. scores: a row for each word, a column for each state."""
    kind = np.min_scalar_type(max(1, scores.shape[1] - 1))  # states are stored in as many bytes as they need
    out, back = np.zeros(len(scores), np.int32), np.zeros(scores.shape, kind)
    begin, length, _ = by_length(starts)
    if not len(begin):
        return out
    active = np.searchsorted(-length, -np.arange(length[0]), "left")  # texts longer than t
    best, me = scores[begin].copy(), np.arange(scores.shape[1], dtype=kind)
    for t in range(1, length[0]):
        k = active[t]
        rows = begin[:k] + t
        v = best[:k]
        top = v.argmax(1)
        change = v[np.arange(k), top] - penalty
        stay = v >= change[:, None]
        back[rows] = np.where(stay, me, top[:, None].astype(kind))
        best[:k] = np.where(stay, v, change[:, None]) + scores[rows]
    state = best.argmax(1).astype(np.int32)
    for t in range(length[0] - 1, -1, -1):
        k = active[t]
        rows = begin[:k] + t
        out[rows] = state[:k]
        if t:
            state[:k] = back[rows, state[:k]]
    return out


def marginals(score: np.ndarray, trans: np.ndarray, first: float, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward of a chain with two states, in odds of state 1 to state 0.

    score: the word's log odds; trans[a, b]: log weight of b after a; first: log odds of state 1 before the first word.
    Returns the probability of state 1 at each word, and the expected number of each transition.
    """
    p, pairs = np.zeros(len(score)), np.zeros((2, 2))
    begin, length, _ = by_length(starts)
    if not len(begin):
        return p, pairs
    e, w = np.exp(np.clip(score, -30, 30)), np.exp(trans)
    active = np.searchsorted(-length, -np.arange(length[0]), "left")
    fore, aft = np.empty(len(score)), np.empty(len(score))
    f = e[begin] * np.exp(first)
    fore[begin] = f
    for t in range(1, length[0]):
        k = active[t]
        rows, g = begin[:k] + t, f[:k]
        f[:k] = e[rows] * (w[0, 1] + g * w[1, 1]) / (w[0, 0] + g * w[1, 0])
        fore[rows] = f[:k]
    b = np.ones(len(begin))
    for t in range(length[0] - 1, -1, -1):
        k = active[t]
        rows = begin[:k] + t
        aft[rows] = b[:k]
        if t:
            g = e[rows] * b[:k]
            b[:k] = (w[1, 0] + w[1, 1] * g) / (w[0, 0] + w[0, 1] * g)
    # pairs: weight of (a, b) between a word and the next one of the same text
    nxt = np.ones(len(score), bool)
    nxt[starts[1:][np.diff(starts) > 0] - 1] = False
    i = np.flatnonzero(nxt)
    g, x = fore[i], e[i + 1] * aft[i + 1]
    whole = w[0, 0] + w[0, 1] * x + g * (w[1, 0] + w[1, 1] * x)
    for a in (0, 1):
        for b in (0, 1):
            pairs[a, b] = (w[a, b] * (g if a else 1) * (x if b else 1) / whole).sum()
    fore *= aft
    return fore / (1 + fore), pairs
