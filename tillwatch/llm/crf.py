"""Linear-chain conditional random fields in numpy: forward-backward, Viterbi and training.

A token has a type (its text, say), a type has features, and a token's score for each tag is the sum of the weights of
its own features and, at other offsets, of its neighbours'. Sequences are stored one after another in flat arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BLOCK = 64


def _times(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of matrices stored as (rows, columns, n)."""
    return (p[:, :, None, :] * q[None, :, :, :]).sum(axis=1)


def forward(steps: np.ndarray) -> np.ndarray:
    """States after each step, scaled to sum 1: state(t) = state(t-1) @ steps(t), from the uniform state.

    ``steps`` is (tags, tags, n). Blocks of steps are multiplied side by side, the states at the starts of the blocks come
    from the blocks' products in the same way, and then all blocks are walked through side by side.
    """
    tags, _, n = steps.shape
    if n <= 4 * BLOCK:
        out, state = np.empty((tags, n)), np.full(tags, 1.0 / tags)
        for t in range(n):
            state = state @ steps[:, :, t]
            state /= state.sum()
            out[:, t] = state
        return out
    blocks = -(-n // BLOCK)
    padded = np.empty((tags, tags, blocks * BLOCK))
    padded[:, :, :n] = steps
    padded[:, :, n:] = np.eye(tags)[:, :, None]
    walk = np.ascontiguousarray(padded.reshape(tags, tags, blocks, BLOCK).transpose(3, 0, 1, 2))
    whole = walk[0]
    for t in range(1, BLOCK):
        whole = _times(whole, walk[t])
        whole /= whole.max(axis=(0, 1))
    after = forward(whole)
    state = np.concatenate([np.full((tags, 1), 1.0 / tags), after[:, :-1]], axis=1)
    out = np.empty((BLOCK, tags, blocks))
    for t in range(BLOCK):
        state = (state[:, None, :] * walk[t]).sum(axis=0)
        state /= state.sum(axis=0)
        out[t] = state
    return out.transpose(1, 2, 0).reshape(tags, blocks * BLOCK)[:, :n]


def steps_of(scores: np.ndarray, between: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Potentials as (tags, tags, n); the first token of a sequence does not depend on what came before."""
    local = np.exp(scores - scores.max(axis=1, keepdims=True)).T
    steps = np.exp(between)[:, :, None] * local[None]
    steps[:, :, first] = np.exp(start)[None, :, None] * local[None][:, :, first]
    return steps


def marginals(scores: np.ndarray, between: np.ndarray, start: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Probability of each tag of each token, (n, tags); with ``pairs`` also the expected number of each pair of tags."""
    n, tags = scores.shape
    if not n:
        empty = np.zeros((0, tags))
        return (empty, np.zeros((tags, tags))) if pairs else empty
    steps = steps_of(scores, between, start, first)
    ahead = forward(steps)
    back = np.ones((tags, n))
    if n > 1:
        back[:, :-1] = forward(np.ascontiguousarray(steps[:, :, :0:-1].transpose(1, 0, 2)))[:, ::-1]
    joint = ahead * back
    single = (joint / joint.sum(axis=0)).T
    if not pairs:
        return single
    inner = np.setdiff1d(np.arange(1, n), first)
    both = ahead[:, None, inner - 1] * steps[:, :, inner] * back[None, :, inner]
    return single, (both / both.sum(axis=(0, 1))).sum(axis=2)


def blocked_marginals(scores: np.ndarray, between: np.ndarray, start: np.ndarray, first: np.ndarray, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """``marginals`` with pairs, over runs of whole sequences of about ``most`` tokens at a time, so that its working memory does not grow with all of them."""
    cuts, at = [0], most
    while at < len(scores):
        k = int(np.searchsorted(first, at))
        if k == len(first):
            break
        cuts.append(int(first[k]))
        at = cuts[-1] + most
    single, pairs = np.empty_like(scores), np.zeros_like(between)
    for a, b in zip(cuts, [*cuts[1:], len(scores)], strict=True):
        own = first[np.searchsorted(first, a) : np.searchsorted(first, b)] - a
        single[a:b], found = marginals(scores[a:b], between, start, own, pairs=True)
        pairs += found
    return single, pairs


def viterbi(scores: np.ndarray, between: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
    """The best tags of one sequence; ties go to the lower tag."""
    if not len(scores):
        return []
    best, came = start + scores[0], []
    for row in scores[1:]:
        reach = best[:, None] + between
        came.append(reach.argmax(axis=0))
        best = reach.max(axis=0) + row
    tag = int((best + end).argmax())
    out = [tag]
    for step in reversed(came):
        tag = int(step[tag])
        out.append(tag)
    return out[::-1]


def shifted(types: np.ndarray, first: np.ndarray, offset: int, nothing: int) -> np.ndarray:
    """The type at an offset (-1, 0 or 1) within the sequence; ``nothing`` beyond its ends."""
    if offset == 0:
        return types
    out = np.full(len(types), nothing, dtype=types.dtype)
    if offset < 0:
        out[1:] = types[:-1]
        out[first] = nothing
    else:
        out[:-1] = types[1:]
        out[first[1:] - 1] = nothing
    return out


def train(
    features: Sequence[Sequence[int]],
    types: np.ndarray,
    tags: np.ndarray,
    first: np.ndarray,
    n_tags: int,
    n_features: int,
    offsets: Sequence[int] = (0,),
    banned: np.ndarray | None = None,
    epochs: int = 40,
    rate: float = 0.2,
    l2: float = 1e-6,
) -> dict:
    """Maximum likelihood with Adam over all tokens at once; no random numbers.

    ``features[type]`` lists a type's features; the last type stands for "no token". ``banned`` (n, tags) marks tags a token cannot have.
    """
    n, sizes = len(types), np.array([len(f) for f in features])
    flat, owner = np.array([x for f in features for x in f], dtype=np.int64), np.repeat(np.arange(len(features)), sizes)
    at = [shifted(types, first, o, len(features) - 1) for o in offsets]
    gold = np.zeros((n, n_tags))
    gold[np.arange(n), tags] = 1
    inner = np.setdiff1d(np.arange(1, n), first)
    pairs_gold = np.zeros((n_tags, n_tags))
    np.add.at(pairs_gold, (tags[inner - 1], tags[inner]), 1)
    params = {"between": np.zeros((n_tags, n_tags)), "start": np.zeros(n_tags), **{f"w{k}": np.zeros((n_features, n_tags)) for k in range(len(offsets))}}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}

    def per_type(w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(owner, weights=w[flat, t], minlength=len(features)) for t in range(n_tags)], axis=1)

    for epoch in range(1, epochs + 1):
        scores = sum(per_type(params[f"w{k}"])[at[k]] for k in range(len(offsets)))
        if banned is not None:
            scores = np.where(banned, -1e4, scores)
        found, pairs = blocked_marginals(scores, params["between"], params["start"], first)
        error = (gold - found) / n
        if banned is not None:
            error = np.where(banned, 0, error)
        grads = {"between": (pairs_gold - pairs) / n, "start": error[first].sum(axis=0)}
        for k in range(len(offsets)):
            by_type = np.stack([np.bincount(at[k], weights=error[:, t], minlength=len(features)) for t in range(n_tags)], axis=1)
            grads[f"w{k}"] = np.stack([np.bincount(flat, weights=by_type[owner, t], minlength=n_features) for t in range(n_tags)], axis=1)
        for k, grad in grads.items():
            grad = grad - l2 * params[k]
            m, v = moments[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            params[k] += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    return {"between": params["between"], "start": params["start"], "weights": [params[f"w{k}"] for k in range(len(offsets))]}
