"""Linear-chain conditional random field in numpy: training on a small table, Viterbi in batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BANNED = -1e9


@dataclass
class Crf:
    """Weights of known features (sorted hashes), of steps between labels and of the first label."""
    known: np.ndarray
    weight: np.ndarray  # (known + 1, labels); the last row is zero, for features never seen
    step: np.ndarray  # (labels, labels)
    first: np.ndarray

    def emission(self, features: np.ndarray) -> np.ndarray:
        return self.weight[rows_of(self.known, features)].sum(axis=1)

    def decode(self, features: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best label of every token; ``length`` are the lengths of the sequences in order.

        All sequences of a batch advance together, longest first, so a step costs one numpy call
        for all that are still going on.
        """
        emission = self.emission(features)
        begin = np.cumsum(length) - length
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        labels = np.zeros(len(features), np.int64)
        if not len(length):
            return labels
        back = np.zeros(emission.shape, np.int8)
        score = self.first + emission[begin]
        still = np.searchsorted(-length, -np.arange(length[0] + 1), "left")  # sequences longer than t
        for t in range(1, length[0]):
            m = still[t]
            through = score[:m, :, None] + self.step
            back[begin[:m] + t] = through.argmax(axis=1)
            score[:m] = through.max(axis=1) + emission[begin[:m] + t]
        current = score.argmax(axis=1)
        for t in range(length[0] - 1, -1, -1):
            m = still[t]
            labels[begin[:m] + t] = current[:m]
            current[:m] = back[begin[:m] + t, current[:m]]
        return labels


def rows_of(known: np.ndarray, features: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, features)
    at[at == len(known)] = 0
    return np.where(known[at] == features, at, len(known))


def train(features: np.ndarray, labels: np.ndarray, length: np.ndarray, allowed: np.ndarray, first: np.ndarray,
          rounds: int = 300, rate: float = 0.3, decay: float = 0.02) -> Crf:
    """Weights of largest penalised likelihood, by gradient ascent with per-weight step sizes.

    ``allowed`` and ``first`` say which steps and first labels exist. The sequences are padded to
    one array, so this is for small tables.
    """
    n_labels = len(first)
    known = np.unique(features)
    index = rows_of(known, features)
    # The tokens of each feature, one feature after the other.
    order = np.argsort(index, axis=None, kind="stable")
    holder = order // index.shape[1]
    held, starts = np.unique(index.ravel()[order], return_index=True)
    width, count = int(length.max()), len(length)
    # Longest sequences first: at each place only those that go on.
    begin = np.cumsum(length) - length
    longest = np.argsort(-length, kind="stable")
    begin, length = begin[longest], length[longest]
    still = np.searchsorted(-length, -np.arange(width + 1), "left")
    place = np.minimum(begin[:, None] + np.arange(width), len(features) - 1)
    real = np.arange(width) < length[:, None]
    gold = np.eye(n_labels)[labels]
    step_gold = np.zeros((n_labels, n_labels))
    inner = np.ones(len(labels), bool)
    inner[begin] = False
    np.add.at(step_gold, (labels[np.flatnonzero(inner) - 1], labels[inner]), 1)
    first_gold = gold[begin].sum(axis=0)
    parts = [np.zeros((len(known) + 1, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    squares = [np.full_like(p, 1e-8) for p in parts]
    ban_step, ban_first = np.where(allowed, 0, BANNED), np.where(first, 0, BANNED)
    for _ in range(rounds):
        weight, step, start = parts
        emit = weight[index].sum(axis=1)[place]
        full_step = step + ban_step
        ahead = np.zeros((count, width, n_labels))
        ahead[:, 0] = start + ban_first + emit[:, 0]
        for t in range(1, width):
            m = still[t]
            ahead[:m, t] = _logsum(ahead[:m, t - 1, :, None] + full_step, 1) + emit[:m, t]
        after = np.zeros((count, width, n_labels))
        for t in range(width - 2, -1, -1):
            m = still[t + 1]
            after[:m, t] = _logsum(full_step + (emit[:m, t + 1] + after[:m, t + 1])[:, None, :], 2)
        total = _logsum(ahead[np.arange(count), length - 1], 1)
        share = np.exp(ahead + after - total[:, None, None]) * real[:, :, None]
        pair = np.zeros((n_labels, n_labels))
        for t in range(1, width):
            m = still[t]
            joint = ahead[:m, t - 1, :, None] + full_step + (emit[:m, t] + after[:m, t])[:, None, :] - total[:m, None, None]
            pair += np.exp(np.minimum(joint, 0)).sum(axis=0)
        miss = np.zeros((len(known) + 1, n_labels))
        error = gold.copy()
        error[place[real]] -= share[real]
        miss[held] = np.add.reduceat(error[holder], starts, axis=0)
        slopes = [miss, step_gold - pair, first_gold - share[:, 0].sum(axis=0)]
        for part, slope, square in zip(parts, slopes, squares):
            slope = slope - decay * part
            square += slope ** 2
            part += rate * slope / np.sqrt(square)
        parts[0][-1] = 0
    return Crf(known, parts[0], parts[1] + ban_step, parts[2] + ban_first)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))
