"""Linear-chain conditional random fields on many chains at once, with numpy.

Chains are laid out position by position, longest chain first, so one step of a
recursion serves every chain that is long enough.
"""

import numpy as np


class Chains:
    """Where the tokens of chains of given lengths (each at least 1) lie, position-major."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        longest = int(lengths.max()) if len(lengths) else 0
        counts = np.bincount(lengths, minlength=longest + 1)
        self.active = len(lengths) - np.cumsum(counts)[:longest]
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        chain = np.repeat(np.arange(len(lengths)), lengths)
        begin = np.cumsum(lengths) - lengths
        position = np.arange(len(chain)) - begin[chain]
        #: Of each token, its place in the position-major order.
        self.place = self.offset[position] + rank[chain]

    def steps(self):
        """The slices of one position and of the part of the position before that goes on."""
        for t in range(1, len(self.active)):
            a, n = self.offset[t], self.active[t]
            yield slice(a, a + n), slice(self.offset[t - 1], self.offset[t - 1] + n)


def _normal(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return top.squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(scores: np.ndarray, moves: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: the log probability of each label of each token, and the
    expected number of each move from label to label.

    ``scores`` is tokens by labels in token order, ``moves`` labels by labels.
    """
    own = np.empty_like(scores)
    own[chains.place] = scores
    ahead, behind = own.copy(), np.zeros_like(own)
    for now, before in chains.steps():
        ahead[now] += _normal(ahead[before][:, :, None] + moves[None], 1)
    for now, before in reversed(list(chains.steps())):
        behind[before] = _normal(moves[None] + (own[now] + behind[now])[:, None, :], 2)
    both = ahead + behind
    total = _normal(both, 1)
    expected = np.zeros_like(moves)
    for now, before in chains.steps():
        joint = ahead[before][:, :, None] + moves[None] + (own[now] + behind[now])[:, None, :]
        expected += np.exp(joint - total[now][:, None, None]).sum(axis=0)
    return (both - total[:, None])[chains.place], expected


def token_marginals(scores: np.ndarray, moves: np.ndarray, chains: Chains) -> np.ndarray:
    """As ``marginals`` for two labels, but only the log odds of label 1, in one pass each way."""
    own = np.empty(len(scores))
    own[chains.place] = scores
    ahead, behind = own.copy(), np.zeros(len(own))
    (stay, rise), (fall, hold) = moves
    for now, before in chains.steps():
        x = ahead[before]
        ahead[now] += np.logaddexp(rise, x + hold) - np.logaddexp(stay, x + fall)
    for now, before in reversed(list(chains.steps())):
        x = own[now] + behind[now]
        behind[before] = np.logaddexp(fall, x + hold) - np.logaddexp(stay, x + rise)
    return (ahead + behind)[chains.place]


def viterbi(scores: np.ndarray, moves: np.ndarray, chains: Chains) -> np.ndarray:
    """The most probable labels of each chain, ties to the lesser label."""
    best = np.empty_like(scores)
    best[chains.place] = scores
    back = np.zeros(best.shape, np.int8)
    steps = list(chains.steps())
    for now, before in steps:
        paths = best[before][:, :, None] + moves[None]
        back[now] = paths.argmax(axis=1)
        best[now] += paths.max(axis=1)
    label = best.argmax(axis=1).astype(np.int8)
    for now, before in reversed(steps):
        label[before] = np.take_along_axis(back[now], label[now][:, None].astype(np.int64), 1)[:, 0]
    return label[chains.place]


class Adam:
    """Adaptive steps for a set of named arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(w) for k, w in weights.items()}
        self.v = {k: np.zeros_like(w) for k, w in weights.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradients.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.99**self.t)
            self.weights[k] -= self.rate * m / (np.sqrt(v) + 1e-8)


def fit(
    features: list[list[np.ndarray]],
    size: int,
    labels: np.ndarray,
    lengths: np.ndarray,
    n_labels: int,
    steps: int = 60,
    rate: float = 0.2,
    ridge: float = 1e-4,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features by labels) and moves that make the labels of the chains likely.

    ``features`` holds pairs of arrays: the token and the feature of each place where
    a feature is on.  Label 0 has weight zero.
    """
    tokens = np.concatenate([f[0] for f in features])
    kinds = np.concatenate([f[1] for f in features])
    weights = {"w": np.zeros((size, n_labels)), "m": np.zeros((n_labels, n_labels))}
    chains, n = Chains(lengths), len(labels)
    goal = np.eye(n_labels)[labels]
    first = np.zeros(n, bool)
    first[np.cumsum(lengths) - lengths] = True
    after = np.flatnonzero(~first)
    seen = np.zeros((n_labels, n_labels))
    np.add.at(seen, (labels[after - 1], labels[after]), 1)
    optimizer = Adam(weights, rate)
    for _ in range(steps if n else 0):
        w = weights["w"]
        scores = np.stack([np.bincount(tokens, w[kinds, k], n) for k in range(n_labels)], axis=1)
        log_p, expected = marginals(scores, weights["m"], chains)
        miss = np.exp(log_p) - goal
        g = np.stack([np.bincount(kinds, miss[tokens, k], size) for k in range(n_labels)], axis=1)
        g[:, 0] = 0
        optimizer.step({"w": g / n + ridge * w, "m": (expected - seen) / n + ridge * weights["m"]})
    return weights["w"], weights["m"]
