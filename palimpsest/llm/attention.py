"""A causal self-attention model of subword ids in numpy: fitting, and batched scoring of overlapping windows.

One head: queries are projected, keys and values are the inputs themselves, since matrices of theirs would only multiply those of the queries and of the
output. An id is predicted in two steps: its class by attention over the window before it, then the id within its class by counts
of the id before. Counts come from the whole training corpus; attention corrects what they say about classes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Ids of the model: the most frequent ones, one for all others that go on with a word, one for all others that begin one, one for a text's
#: end (and what comes before its start), which counts as a word.
DENSE = 1024
RARE, RARE_FIRST, END = DENSE - 3, DENSE - 2, DENSE - 1
#: Inputs of a window; a window's last STRIDE inputs are scored in it, in a text's first window all.
LENGTH, STRIDE = 32, 24
CLASSES, FIRST_CLASSES, WIDTH = 64, 26, 16
#: The first classes are of ids that begin a word. Counts that the level above is worth. Share of the word counts in a word's probability.
PRIOR, BY_COUNTS = 4.0, 0.2
#: Scores of attention and of classes lie between this and its negative, so that their exponentials stay within single precision.
MOST = 40.0
#: Adam's rate.
RATE = 2e-2
#: Windows whose arrays are worked on at a time, for the cache's sake, and windows in a block of their products.
PART, BLOCK = 32, 16


def windows(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many inputs, one after the other: first input of each window, inputs in it, and of those how many are context only."""
    number = 1 + np.maximum(0, -(-(lens - LENGTH) // STRIDE))
    turn = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    start = turn * STRIDE
    size = np.minimum(LENGTH, np.repeat(lens, number) - start)
    return np.repeat(np.cumsum(lens) - lens, number) + start, size, np.where(turn > 0, LENGTH - STRIDE, 0)


def _largest(x: np.ndarray) -> float:
    """The largest length of a vector."""
    return math.sqrt(float(np.einsum("...i,...i->...", x, x).max()))


@dataclass
class Model:
    """All that scoring needs; arrays in single precision."""

    dense: np.ndarray  # of each raw id its id here
    rare: np.ndarray  # log share of each raw id among those that share its id here
    begins: np.ndarray  # whether an id here begins a word
    classes: np.ndarray  # of each id
    prior: np.ndarray  # [id before, class] log P by counts
    member: np.ndarray  # [id before, id] log P(id | its class, id before) by counts
    weights: dict[str, np.ndarray]
    fitted: int = 0  # windows of training texts that the weights were fitted on

    def __post_init__(self):
        w = self.weights
        both = np.concatenate([w["q"] / math.sqrt(WIDTH), np.eye(WIDTH), np.zeros((WIDTH, 1))], 1)
        self.by_id, self.by_place = (w["ids"] @ both).astype(np.float32), (w["places"] @ both).astype(np.float32)
        self.by_id[:, -1] = 1  # so that products with the values give sums too
        # no score needs a bound if none can be large
        reach = [np.linalg.norm(self.by_id[:, k : k + WIDTH], axis=1).max() + np.linalg.norm(self.by_place[:, k : k + WIDTH], axis=1).max() for k in (0, WIDTH)]
        self.small = reach[0] * reach[1] < MOST
        values = math.sqrt(1 + reach[1] ** 2)
        self.tame = values * _largest(np.concatenate([w["out"], w["bias"][None]]).T) < MOST
        self.sums = np.stack([np.ones(CLASSES), np.arange(CLASSES) < FIRST_CLASSES], 1).astype(np.float32)
        self.mask = np.tri(LENGTH, dtype=np.float32)
        self.start = self.prior.astype(np.float32)
        self.out = np.concatenate([w["out"], w["bias"][None]]).astype(np.float32)

    def score(self, ids: np.ndarray, following: np.ndarray, skip: int = 0, at_once: int = PART) -> tuple[np.ndarray, np.ndarray]:
        """For each of `following` after the ids of its window up to there, both [windows, LENGTH], but the first `skip` of a window: log P, for ids that
        begin a word given that one begins; and for those log P that one begins, else 0."""
        here, then, long = ids[:, skip:].reshape(-1), following[:, skip:].reshape(-1), LENGTH - skip
        right, mass = np.empty(len(then), np.float32), np.empty((len(then), 2), np.float32)
        goals, number = self.classes[then], min(at_once, len(ids))
        of = lambda *shape: np.empty((number, *shape), np.float32)
        rooms = of(LENGTH, 2 * WIDTH + 1), of(WIDTH, LENGTH), of(long, LENGTH), of(long, WIDTH + 1), of(long, CLASSES), of(long, CLASSES)
        masks, cells = np.tile(self.mask[skip:], (number, 1, 1)), np.arange(number * long) * CLASSES
        for k in range(0, len(ids), at_once):
            x, turned, seen, held, logits, prior = (room[: len(ids) - k] for room in rooms)
            own = slice(k * long, (k + len(x)) * long)
            np.take(self.by_id, ids[k : k + at_once], axis=0, out=x, mode="clip")
            x += self.by_place
            turned[:] = x[..., WIDTH : 2 * WIDTH].transpose(0, 2, 1)
            np.matmul(x[:, skip:, :WIDTH], turned, out=seen)
            if not self.small:
                np.clip(seen, -MOST, MOST, out=seen)
            np.exp(seen, out=seen)
            seen *= masks[: len(x)]
            held = np.matmul(seen, x[..., WIDTH:], out=held).reshape(-1, WIDTH + 1)
            held *= 1 / held[:, WIDTH:]
            logits = np.matmul(held, self.out, out=logits.reshape(-1, CLASSES))
            logits += np.take(self.start, here[own], axis=0, out=prior.reshape(-1, CLASSES), mode="clip")
            if not self.tame:
                np.clip(logits, -MOST, MOST, out=logits)
            np.take(logits.reshape(-1), goals[own] + cells[: len(logits)], out=right[own], mode="clip")
            np.exp(logits, out=logits)
            np.matmul(logits, self.sums, out=mass[own])
        np.log(mass, out=mass)
        every, first = mass.T
        begins = self.begins[then]
        right -= np.where(begins, first, every)
        right += self.member[here, then]
        return right.reshape(-1, long), np.where(begins, first - every, np.float32(0)).reshape(-1, long)

    def score_words(self, raw: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """log P of each word given the words before it in its text, each text's end as a last word. raw: the texts' raw ids, in a
        row; lens: raw ids of each text. That a word ends is part of its probability, so over all
        words these sum up to 1. Each id is scored once."""
        stops = np.cumsum(lens)
        following = np.insert(self.dense.astype(np.int32)[raw], stops, END)
        own, edge = np.empty(len(following) + LENGTH, np.float32), np.empty(len(following) + LENGTH, np.float32)
        first, size, context = windows(lens + 1)
        line = np.pad(following, (1, LENGTH), constant_values=END)  # the inputs, since each text's end is what the next one starts from
        rows = np.lib.stride_tricks.sliding_window_view(line, LENGTH + 1)
        for skip in (0, LENGTH - STRIDE):  # a text's first window, and the later ones
            into = [np.lib.stride_tricks.sliding_window_view(x, LENGTH - skip, writeable=True) for x in (own, edge)]
            for whole in (True, False):
                mine, steps = np.flatnonzero((context == skip) & ((size == LENGTH) == whole)), np.arange(skip, LENGTH)
                for k in range(0, len(mine), 4096):
                    now = mine[k : k + 4096]
                    window, place = rows[first[now]].astype(np.intp), first[now] + skip
                    found = self.score(window[:, :-1], window[:, 1:], skip)
                    if whole:
                        into[0][place], into[1][place] = found
                    else:
                        inside = steps < size[now, None]
                        place = (place[:, None] + np.arange(LENGTH - skip))[inside]
                        own[place], edge[place] = (x[inside] for x in found)
        own, edge = own[: len(following)], edge[: len(following)]
        own += np.insert(self.rare.astype(np.float32)[raw], stops, 0)
        ends = stops + np.arange(len(lens))  # places of the texts' ends among all
        starts = np.flatnonzero(self.begins[following])  # of words and ends, in a row
        out = np.add.reduceat(own, starts, dtype=np.float64) if len(starts) else np.zeros(0)
        over = np.where(np.isin(starts, np.concatenate([[0], ends[:-1] + 1])), 0, edge[starts])
        out[:-1] += over[1:]
        return out


def counted(pairs: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, prior and member tables from counts [id before, id]; begins: whether an id begins a word."""
    n = pairs.sum(0)
    # Ids in the order of the main direction of what comes before them, cut into classes of like mass.
    profile = np.log1p(pairs) - np.log1p(np.outer(pairs.sum(1), n) / max(n.sum(), 1))
    way = np.random.default_rng(7).standard_normal(DENSE)
    for _ in range(30):
        way = profile.T @ (profile @ way)
        way /= max(np.linalg.norm(way), 1e-12)
    classes = np.empty(DENSE, np.int64)
    for own, base, many in ((begins, 0, FIRST_CLASSES), (~begins, FIRST_CLASSES, CLASSES - FIRST_CLASSES)):
        order = np.flatnonzero(own)
        order = order[np.argsort(way[order], kind="stable")]
        mass = np.cumsum(n[order] + 0.5)
        classes[order] = base + np.minimum((mass / mass[-1] * many).astype(np.int64), many - 1)
    one = np.eye(CLASSES)[classes]
    by_class = pairs @ one
    overall = (n + 0.5) / ((n + 0.5) @ one)[classes]
    member = (pairs + PRIOR * overall) / (by_class + PRIOR)[:, classes]
    share = ((n + 0.5) @ one) / (n + 0.5).sum()
    prior = (by_class + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR)
    present = one.any(0)
    prior = np.where(present, prior, 1e-30)
    return classes, np.log(prior / prior.sum(1, keepdims=True)), np.log(member)


def begun(seed: int = 11) -> dict[str, np.ndarray]:
    """Weights that leave the counts as they are, from which fitting starts."""
    draw = np.random.default_rng(seed)
    small = lambda *shape: (draw.standard_normal(shape) * 0.3).astype(np.float32)
    w = {"ids": small(DENSE, WIDTH), "places": small(LENGTH, WIDTH), "q": small(WIDTH, WIDTH)}
    return w | {"out": np.zeros((WIDTH, CLASSES), np.float32), "bias": np.zeros(CLASSES, np.float32)}


def _within(sums: np.ndarray) -> bool:
    """Whether these sums of exponentials are what they'd be if no score lay beyond MOST or its negative."""
    return bool(sums.min() > math.exp(-MOST / 2) and sums.max() < math.exp(MOST))


class _Room:
    """Arrays for a part of so many windows, written over by the next part's. Those named `_by` are views in blocks of BLOCK windows: products of few rows run
    faster."""

    def __init__(self, many: int):
        block = BLOCK if many % BLOCK == 0 else many
        of = lambda width, rows=LENGTH: np.zeros((many, rows, width), np.float32)
        by = lambda x: x.reshape(many // block, block * LENGTH, -1)
        self.q, self.d_held, self.d_q, self.d_x, self.spare = (of(WIDTH) for _ in range(5))
        self.seen, self.d_seen, self.d, self.prior = of(LENGTH), of(LENGTH), of(CLASSES), of(CLASSES).reshape(-1, CLASSES)
        self.values, self.turned, self.held, self.wide = of(WIDTH + 1), of(LENGTH, WIDTH + 1), of(WIDTH + 1), of(WIDTH + 1)
        self.values[..., WIDTH] = self.turned[:, WIDTH] = 1  # inputs and ones, so that products give sums too
        self.x, self.x_by = self.values[..., :WIDTH], by(self.values)[..., :WIDTH]
        self.q_by, self.held_by, self.d_by, self.d_held_by, self.d_q_by, self.spare_by = map(by, (self.q, self.held, self.d, self.d_held, self.d_q, self.spare))
        self.mask = np.tile(np.tri(LENGTH, dtype=np.float32), (many, 1, 1))
        self.ones, self.cells = np.ones(CLASSES, np.float32), np.arange(many * LENGTH) * CLASSES


def fit(samples: np.ndarray, classes: np.ndarray, prior: np.ndarray, start: dict[str, np.ndarray], passes: int = 1, batch: int = 128, rate: float = RATE, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights of the attention part, from `start` on, by Adam on windows of LENGTH + 1 ids. Without windows: `start`.

    A batch's gradient is summed up over parts of PART windows, whose arrays stay in the cache.
    """
    draw = np.random.default_rng(seed)
    names = ["ids", "places", "q", "out", "bias"]  # the last two are one matrix: the bias weighs a column of ones
    flat_w = np.concatenate([start[k].reshape(-1) for k in names]).astype(np.float32)
    flat_grad, mean, square, spare = (np.zeros_like(flat_w) for _ in range(4))
    cuts = np.cumsum([start[k].size for k in names])
    views = lambda flat: {k: x.reshape(start[k].shape) for k, x in zip(names, np.split(flat, cuts[:-1]), strict=True)}
    w, grad = views(flat_w), views(flat_grad)
    out, d_out = (x[cuts[2] :].reshape(WIDTH + 1, CLASSES) for x in (flat_w, flat_grad))
    prior = prior.astype(np.float32)
    total, turns, scale = passes * -(-len(samples) // batch), 0, np.float32(1 / math.sqrt(WIDTH))
    rooms: dict[int, _Room] = {}
    by_column, sums = np.empty((WIDTH, batch * LENGTH)), np.empty((WIDTH, DENSE))
    for _ in range(passes):
        order = draw.permutation(len(samples))
        for k in range(0, len(order), batch):
            now = np.take(samples, order[k : k + batch], axis=0).astype(np.intp)
            n, inputs, goals = len(now) * LENGTH, now[:, :-1].reshape(-1), np.take(classes, now[:, 1:]).reshape(-1)
            query, behind = w["q"] * scale, np.ascontiguousarray(w["out"].T)
            back = np.ascontiguousarray(query.T)
            flat_grad[cuts[0] :] = 0
            for at in range(0, n, PART * LENGTH):
                line, goal = inputs[at : at + PART * LENGTH], goals[at : at + PART * LENGTH]
                many = len(line) // LENGTH
                r = rooms.get(many) or rooms.setdefault(many, _Room(many))
                x = np.add(np.take(w["ids"], line, axis=0, out=r.spare.reshape(-1, WIDTH), mode="clip").reshape(r.spare.shape), w["places"], out=r.x)
                r.turned[:, :WIDTH] = x.transpose(0, 2, 1)
                np.matmul(r.x_by, query, out=r.q_by)
                for bounded in (False, True):
                    seen = np.matmul(r.q, r.turned[:, :WIDTH], out=r.seen)
                    if bounded:
                        np.clip(seen, -MOST, MOST, out=seen)
                    with np.errstate(over="ignore", invalid="ignore"):
                        np.exp(seen, out=seen)
                        seen *= r.mask
                        held = np.matmul(seen, r.values, out=r.held).reshape(-1, WIDTH + 1)
                    if _within(held[:, WIDTH]):
                        break
                over = 1 / held[:, WIDTH]
                held *= over[:, None]  # the last column becomes ones
                np.take(prior, line, axis=0, out=r.prior, mode="clip")
                for bounded in (False, True):
                    d = np.matmul(r.held_by, out, out=r.d_by).reshape(-1, CLASSES)
                    d += r.prior
                    if bounded:
                        np.clip(d, -MOST, MOST, out=d)
                    with np.errstate(over="ignore"):
                        np.exp(d, out=d)
                        mass = d @ r.ones
                    if _within(mass):
                        break
                goal += r.cells
                d.reshape(-1)[goal] -= mass
                part = 1 / (mass * n)
                d_held = np.matmul(r.d_by, behind, out=r.d_held_by).reshape(-1, WIDTH)
                over *= part
                less = np.einsum("ni,ni->n", d_held, held[:, :WIDTH])
                held *= part[:, None]
                d_out += np.matmul(r.held_by.transpose(0, 2, 1), r.d_by).sum(0)
                wide = r.wide.reshape(-1, WIDTH + 1)
                np.multiply(d_held, over[:, None], out=wide[:, :WIDTH])
                np.multiply(less, -over, out=wide[:, WIDTH])
                d_seen = np.matmul(r.wide, r.turned, out=r.d_seen)
                d_seen *= seen
                np.matmul(d_seen, x, out=r.d_q)
                d_x = np.matmul(seen.transpose(0, 2, 1), r.wide[..., :WIDTH], out=r.d_x)
                d_x += np.matmul(d_seen.transpose(0, 2, 1), r.q, out=r.spare)
                np.matmul(r.d_q_by, back, out=r.spare_by)
                d_x += r.spare
                grad["q"] += np.matmul(r.x_by.transpose(0, 2, 1), r.d_q_by).sum(0)
                grad["places"] += d_x.sum(0)
                by_column[:, at : at + len(line)] = d_x.reshape(-1, WIDTH).T
            grad["q"] *= scale
            for i in range(WIDTH):
                sums[i] = np.bincount(inputs, by_column[i, :n], DENSE)
            grad["ids"][:] = sums.T
            turns += 1
            step = rate * min(1.0, turns / 50) * (1 - 0.9 * turns / total)
            np.subtract(flat_grad, mean, out=spare)
            spare *= np.float32(0.1)
            mean += spare
            flat_grad *= flat_grad
            flat_grad -= square
            flat_grad *= np.float32(0.01)
            square += flat_grad
            np.multiply(square, np.float32(1 / (1 - 0.99**turns)), out=spare)
            np.sqrt(spare, out=spare)
            spare += np.float32(1e-8)
            np.divide(mean, spare, out=spare)
            spare *= np.float32(step / (1 - 0.9**turns))
            flat_w -= spare
    return {k: w[k].copy() for k in start}


def training_windows(line: np.ndarray) -> np.ndarray:
    """Windows of LENGTH + 1 ids of a row of ids: each id but the first is once one that's predicted, some of the last window's twice.
    A shorter row is one window, with ends before it."""
    line = np.concatenate([np.full(max(0, LENGTH + 1 - len(line)), END, line.dtype), line])
    start = np.append(np.arange(0, len(line) - LENGTH - 1, LENGTH), len(line) - LENGTH - 1)
    return line[start[:, None] + np.arange(LENGTH + 1)]
