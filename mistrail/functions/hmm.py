"""Forward-backward probabilities of many sequences at once."""

from __future__ import annotations

import numpy as np

#: A sequence longer than this is worked on in parts, side by side; what passes from part to part is exact.
SEGMENT = 512


def segments(starts: np.ndarray, n: int, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, rows and sequence of each segment."""
    ends = np.append(starts[1:], n)
    counts = np.maximum(1, -(-(ends - starts) // segment))
    group = np.repeat(np.arange(len(starts)), counts)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[group] + nth * segment
    return begin, np.minimum(begin + segment, ends[group]) - begin, group


def _edges(likelihood: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray, transition: np.ndarray, prior: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment: the state probabilities before it, given the readings before it (the prior's for the first), and
    the likelihood of all readings after it by the state at its end. Each segment is a matrix that carries one to the other."""
    k = likelihood.shape[1]
    before, after = np.tile(prior, (len(begin), 1)), np.ones((len(begin), k))
    first = np.concatenate([[True], group[1:] != group[:-1]])
    parts = np.flatnonzero(~first | np.concatenate([~first[1:], [False]]))
    carry = np.empty((len(begin), k, k))
    for at in range(0, len(parts), lanes):
        lane = parts[at : at + lanes]
        m = np.tile(np.eye(k), (len(lane), 1, 1))
        for t in range(int(size[lane].max())):
            seen = likelihood[np.minimum(begin[lane] + t, len(likelihood) - 1)]
            step = m if t == 0 else m @ transition
            if t == 0:
                step = np.where(first[lane][:, None, None], m, m @ transition)
            step = step * seen[:, None, :]
            m = np.where((t < size[lane])[:, None, None], step / step.sum((1, 2), keepdims=True), m)
        carry[lane] = m
    for s in parts[~first[parts]]:
        state = before[s - 1] @ carry[s - 1]
        before[s] = state / state.sum()
    for s in parts[::-1]:
        if s + 1 < len(begin) and not first[s + 1]:
            ahead = carry[s + 1] @ after[s + 1]
            after[s] = ahead / ahead.sum()
    return before, after


def posteriors(likelihood: np.ndarray, starts: np.ndarray, transition: np.ndarray, prior: np.ndarray, lanes: int = 4096, segment: int = SEGMENT) -> np.ndarray:
    """P(state | all readings of the sequence) for each row.

    ``likelihood`` has a row per reading and a column per state; the sequences lie one after the other and begin at
    ``starts``. Segments of like length are worked on together, one reading of each at a time; what the segments of a
    sequence must know of each other is worked out beforehand, so that the result is that of the whole sequence.
    """
    n, k = likelihood.shape
    result = np.zeros((n, k))
    if not n:
        return result
    begins, length, group = segments(starts, n, segment)
    first = np.concatenate([[True], group[1:] != group[:-1]])
    before, after = _edges(likelihood, begins, length, group, transition, prior, lanes)
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), lanes):
        lane = order[at : at + lanes]
        begin, size = begins[lane], length[lane]
        steps = int(size.max())
        rows = np.minimum(begin[:, None] + np.arange(steps), n - 1)
        inside = np.arange(steps) < size[:, None]
        seen = np.where(inside[..., None], likelihood[rows], 1.0)
        forward = np.empty((steps, len(lane), k))
        state = np.where(first[lane][:, None], before[lane], before[lane] @ transition) * seen[:, 0]
        forward[0] = state / state.sum(1, keepdims=True)
        for t in range(1, steps):
            state = (forward[t - 1] @ transition) * seen[:, t]
            forward[t] = state / state.sum(1, keepdims=True)
        beyond = after[lane]
        backward = beyond
        for t in range(steps - 1, -1, -1):
            both = forward[t] * backward
            own = inside[:, t]
            result[begin[own] + t] = (both / both.sum(1, keepdims=True))[own]
            if t:
                ahead = (seen[:, t] * backward) @ transition.T
                ahead /= ahead.sum(1, keepdims=True)
                backward = np.where(inside[:, t, None], ahead, beyond)
    return result
