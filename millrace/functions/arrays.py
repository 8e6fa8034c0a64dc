"""Array, mask and schedule expressions: evaluated in the JVM, no Python."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (c if isinstance(c, Column) else F.lit(float(c)) for c in (low, high))
    return F.least(F.greatest(x, low), high)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: inside a lambda it would be evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(x: Column) -> Column:
    return F.aggregate(x.cast("array<double>"), F.lit(0.0), lambda a, b: a + b)


# ---- padding ------------------------------------------------------------------------------------------------------


def pad(x: Column, n: Column | int, token: int, left: bool = False) -> Column:
    """Padded to n; unchanged where it is as long already."""
    n = n if isinstance(n, Column) else F.lit(n)
    more = F.array_repeat(F.lit(token), F.greatest(n - F.size(x), F.lit(0)))
    return F.concat(more, x) if left else F.concat(x, more)


def pad_or_cut(x: Column, n: int, token: int, left_pad: bool = True, cut: str = "right") -> Column:
    """Exactly n long: padded, or cut at the left, the right, or in the middle."""
    if cut == "left":
        short = F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), n)
    elif cut == "right":
        short = F.slice(x, 1, n)
    elif cut == "middle":
        h = n // 2
        short = F.concat(F.slice(x, 1, h), F.slice(x, F.greatest(F.size(x) - (n - h) + 1, F.lit(1)), n - h))
    else:
        short = F.raise_error(F.lit(f"longer than {n}")).cast("array<int>")
    return F.when(F.size(x) > n, short).otherwise(pad(x, n, token, left_pad))


def without_padding(x: Column, mask: Column) -> Column:
    """The elements where the mask is 1."""
    return F.filter(F.zip_with(x, mask, lambda a, m: F.when(m == 1, a)), lambda a: a.isNotNull())


def move_padding(x: Column, token: int, to_left: bool = True) -> Column:
    """Padding moved to one side, the other elements in order."""
    kept, gone = F.filter(x, lambda a: a != token), F.filter(x, lambda a: a == token)
    return F.concat(gone, kept) if to_left else F.concat(kept, gone)


def not_token(x: Column, token: int) -> Column:
    return F.transform(x, lambda a: (a != token).cast("int"))


def cut_to(x: Column, n: Column, from_left: bool = True) -> Column:
    """The last (first) n elements."""
    return F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), n) if from_left else F.slice(x, 1, n)


# ---- distributions ------------------------------------------------------------------------------------------------


def log_sum_exp(logits: Column) -> Column:
    return let(F.array_max(logits), lambda top: top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))))


def entropy(logits: Column) -> Column:
    """logsumexp - sum p x."""
    return let(log_sum_exp(logits), lambda z: z - F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - z) * x))


def log_prob(logits: Column, label: Column) -> Column:
    """Log-softmax at a label counted from 0."""
    return F.element_at(logits, label + 1) - log_sum_exp(logits)


# ---- divergence and losses on token rows --------------------------------------------------------------------------

KL_NAMES = {"kl": "k1", "k1": "k1", "abs": "abs", "mse": "k2", "k2": "k2", "low_var_kl": "k3", "k3": "k3"}


def kl(logp: Column, ref: Column, kind: str = "kl", clamp_input: bool = True) -> Column:
    """Per-token divergence estimate by name; k3 clamps its input to 20 (optional) and its output to 10."""
    k = KL_NAMES.get(kind)
    if k is None:
        raise ValueError(f"unknown divergence {kind}")
    d = logp - ref
    if k == "k1":
        return d
    if k == "abs":
        return F.abs(d)
    if k == "k2":
        return 0.5 * d * d
    x = clamp(ref - logp, -20, 20) if clamp_input else ref - logp
    return clamp(F.exp(x) - x - 1, -10, 10)


def full_kl(logp: Column, ref: Column) -> Column:
    """Summed divergence of two log-distributions over the vocabulary."""
    return F.aggregate(F.zip_with(logp, ref, lambda p, q: F.exp(p) * (p - q)), F.lit(0.0), lambda a, x: a + x)


def dual_clip_loss(old: Column, new: Column, adv: Column, low: float = 0.2, high: float = 0.2, c: float = 3.0) -> Column:
    """Dual-clip policy loss of a token."""
    ratio = F.exp(clamp(new - old, -20, 20))
    clipped = F.greatest(-adv * ratio, -adv * clamp(ratio, 1 - low, 1 + high))
    return F.when(adv < 0, F.least(-adv * c, clipped)).otherwise(clipped)


def is_clipped(old: Column, new: Column, adv: Column, low: float = 0.2, high: float = 0.2) -> Column:
    ratio = F.exp(clamp(new - old, -20, 20))
    return -adv * clamp(ratio, 1 - low, 1 + high) > -adv * ratio


def score_clip_loss(old: Column, new: Column, adv: Column, score: Column, clip: float = 0.2, low_score: float = 0.3, high_score: float = 0.8, bonus: float = 0.1) -> Column:
    """Clipped policy loss whose upper bound grows by up to `bonus` as the sample's score falls from high_score to low_score."""
    room = clip + clamp((high_score - score) / (high_score - low_score), 0, 1) * bonus
    ratio = F.exp(new - old)
    return F.greatest(-adv * ratio, -adv * F.greatest(F.lit(1 - clip), F.least(1 + room, ratio)))


def dense_flops(tokens: Column, squares: Column, parameters: int, layers: int, heads: int, head_size: int) -> Column:
    """Training operations of a dense decoder: 6 for each parameter and token, and 12 for each head's width, layer and pair of tokens of a sequence."""
    return 6.0 * parameters * tokens + 12.0 * layers * heads * head_size * squares


def gpg_loss(logp: Column, adv: Column) -> Column:
    return -logp * adv


def sequence_ratio(mean_log_ratio: Column, new: Column) -> Column:
    """Ratio of a sequence (mean log-ratio, at most e**10); `new` cancels and keeps the token's gradient place."""
    return F.exp(F.least(mean_log_ratio + new - new, F.lit(10.0)))


def value_loss(pred: Column, value: Column, ret: Column, clip: float) -> Column:
    """Half the greater of the squared errors of a prediction and its clipped form."""
    c = clamp(pred, value - clip, value + clip)
    return 0.5 * F.greatest((pred - ret) * (pred - ret), (c - ret) * (c - ret))


def log_sigmoid(x: Column) -> Column:
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def dpo_loss(pc: Column, pr: Column, rc: Column, rr: Column, beta: float = 0.1, smoothing: float = 0.0, kind: str = "sigmoid") -> Column:
    """Preference loss of a pair: logistic (with label smoothing) or ipo."""
    logits = (pc - pr) - (rc - rr)
    if kind == "ipo":
        d = logits - 1 / (2 * beta)
        return d * d
    return -log_sigmoid(beta * logits) * (1 - smoothing) - log_sigmoid(-beta * logits) * smoothing


def bce(p: Column, label: Column) -> Column:
    return -(label * F.log(p) + (1 - label) * F.log(1 - p))


# ---- schedules ----------------------------------------------------------------------------------------------------


def cosine_schedule(step: Column, warmup: int, steps: int, least: float = 0.0, cycles: float = 0.5) -> Column:
    """Linear warm-up from `least`, then a cosine down to `least`."""
    up = least + (1 - least) * step / max(1, warmup)
    progress = (step - warmup) / max(1, steps - warmup)
    down = F.cos(math.pi * cycles * 2.0 * progress) * ((1 - least) * 0.5) + (1 + least) * 0.5
    return F.when(step < warmup, up).otherwise(F.greatest(F.lit(least), down))


def wsd_schedule(step: Column, warmup: int, steps: int, least: float = 0.0, cycles: float = 0.5, stable: float = 0.9) -> Column:
    """Warm-up, stable, then cosine decay."""
    n_stable = int((steps - warmup) * stable)
    n_decay = steps - warmup - n_stable
    progress = (step - warmup - n_stable) / max(1, n_decay)
    value = F.greatest(F.lit(0.0), 0.5 * (1.0 + F.cos(math.pi * cycles * 2.0 * progress)))
    return F.when(step < warmup, step / max(1, warmup)).when(step < warmup + n_stable, 1.0).when(step < steps, (1 - least) * value + least).otherwise(least)


# ---- step rewards -------------------------------------------------------------------------------------------------


def step_score(score: Column, conf: Column, tool_check: Column, success: Column) -> Column:
    """score * confidence, halved where a checked tool failed, clamped to [-1, 1]."""
    return clamp(score * conf * F.when(tool_check & ~success, 0.5).otherwise(1.0), -1, 1)


def repair_cost(conf: Column, tau: float = 0.7, eta: float = 0.05, kappa: float = 5.0) -> Column:
    """sigmoid(kappa (tau - confidence)) * eta."""
    return eta / (1 + F.exp(-kappa * (tau - conf)))


def discounted_total(rewards: Column, penalties: Column, outcome: Column, alpha: float = 1.0, gamma: float = 0.99) -> Column:
    """alpha * outcome + sum gamma**t (r_t - p_t) over the shorter list."""
    n = F.least(F.size(rewards), F.size(penalties))
    net = F.zip_with(F.slice(rewards, 1, n), F.slice(penalties, 1, n), lambda a, b: a - b)
    return alpha * outcome + total(F.transform(net, lambda x, t: x * F.pow(F.lit(gamma), t.cast("double"))))


# ---- media arithmetic ---------------------------------------------------------------------------------------------


def smart_resize(height: Column, width: Column, factor: int = 28, least: int = 3136, most: int = 12845056) -> Column:
    """struct(height, width): multiples of factor with the aspect kept and the area within bounds."""
    h, w = (F.greatest(F.lit(factor), (F.bround(x / factor) * factor).cast("int")) for x in (height, width))
    big, small = F.sqrt(height * width / float(most)), F.sqrt(float(least) / (height * width))
    too_big, too_small = h.cast("long") * w > most, h.cast("long") * w < least
    down = lambda x: (F.floor(x / big / factor) * factor).cast("int")
    up = lambda x: (F.ceil(x * small / factor) * factor).cast("int")
    pick = lambda x, y: F.when(too_big, F.greatest(F.lit(factor), down(x))).when(too_small, up(x)).otherwise(y)
    return F.struct(pick(height, h).alias("height"), pick(width, w).alias("width"))


def frame_count(frames: Column, video_fps: Column, fps: float = 2.0, least: int = 4, most: int = 768, factor: int = 2) -> Column:
    """Frames to take: frames / video_fps * fps within bounds, a multiple of factor."""
    n = frames / video_fps * fps
    n = F.least(F.least(F.greatest(n, F.lit(float(least))), F.lit(float(most))), frames.cast("double"))
    return (F.floor(n / factor) * factor).cast("int")
