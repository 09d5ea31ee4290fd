"""Independent components over features: a rotation of a whitened span of principal components.

Components P (feature, vec) with scores (cell, vec) have one pass over features: sums of all products of
up to four of their places, which give means, covariances and fourth-order cumulants under any weights of features. What
follows is small (the rank is a parameter): whitening K, a rotation W by joint diagonalisation of the cumulants or by
the tanh likelihood, and the maps from scores to activities and from P to loadings, which are applied to both tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import residual
from loomwork.operators.decomposition import PCA, mapped
from loomwork.operators.residual import all_rows, matrix, sums_of
from loomwork.session import stored

CONTRASTS = ("jade", "picard")
#: Features whose products are formed at once.
CHUNK = 1024
#: Doubles of a whitened block that one task may hold; larger ones are passed over for every step of the likelihood.
HELD = 1 << 24


# ------------------------------------------------------------------ moments


@dataclass(frozen=True)
class Moments:
    """Weighted sums of products of up to four places: their number, and means of one, two, three and four."""

    n: float
    m1: np.ndarray
    m2: np.ndarray
    m3: np.ndarray
    m4: np.ndarray

    def covariance(self) -> np.ndarray:
        return self.m2 - np.outer(self.m1, self.m1)

    def cumulants(self, centre: bool = True) -> np.ndarray:
        """Fourth-order cumulant tensor; about zero and not the mean unless ``centre``."""
        m2, m4 = self.m2, self.m4
        if centre:
            u, m2 = self.m1, self.covariance()
            uu, u3 = np.outer(u, u), np.einsum("a,bcd->abcd", u, self.m3)
            m4 = m4 - (u3 + u3.transpose(1, 0, 2, 3) + u3.transpose(1, 2, 0, 3) + u3.transpose(1, 2, 3, 0))
            for axes in ("abcd", "acbd", "acdb"):
                # Each way to split four places in two pairs, either pair being the one of means.
                m4 = m4 + np.einsum(f"ab,cd->{axes}", uu, self.m2) + np.einsum(f"ab,cd->{axes}", self.m2, uu)
            m4 = m4 - 3 * np.multiply.outer(uu, uu)
        return m4 - sum(np.einsum(f"ab,cd->{axes}", m2, m2) for axes in ("abcd", "acbd", "acdb"))


def moments(block: DataFrame, width: int, weights: Callable[[np.ndarray], np.ndarray] | None = None, sets: int = 1, by: np.ndarray | None = None) -> list[Moments]:
    """Moments of a block (j, vec), or of its arrays times ``by``, under ``sets`` sets of weights; ``weights`` gives sets by features from places j."""
    by = np.eye(width) if by is None else by
    full = by.shape[1] + 1
    one, two = np.triu_indices(full)
    size = len(one)

    def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((sets, size, size))
        for b in batches:
            j, x = b.column(0).to_numpy(), matrix(b.column(1), width) @ by
            w = np.ones((1, len(x))) if weights is None else weights(j)
            for k in range(0, len(x), CHUNK):
                part = np.c_[np.ones(len(x[k : k + CHUNK])), x[k : k + CHUNK]]
                products = part[:, one] * part[:, two]
                for s in range(sets):
                    total[s] += (products * w[s, k : k + CHUNK, None]).T @ products
        return total

    out = []
    pair = np.zeros((full, full), np.int64)
    pair[one, two] = pair[two, one] = np.arange(size)
    for total in sums_of(block.select("j", "vec"), (sets, size, size), make):
        n = total[0, 0]
        cube = total[pair[:, :, None, None], pair[None, None]] / n
        out.append(Moments(float(n), cube[0, 0, 0, 1:], cube[0, 0, 1:, 1:], cube[0, 1:, 1:, 1:], cube[1:, 1:, 1:, 1:]))
    return out


def turned(tensor: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A tensor with each of its four sides times the rows of ``by``."""
    for _ in range(4):
        tensor = np.tensordot(tensor, by, axes=([0], [1]))
    return tensor


def whitening(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K with K C K' = 1, its inverse, and the eigenvalues, largest first."""
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1], vector[:, ::-1]
    if value[-1] <= 1e-12 * value[0]:
        raise ValueError("whitening needs loadings of full rank")
    return (vector / np.sqrt(value)).T, vector * np.sqrt(value), value


# ------------------------------------------------------------------ joint diagonalisation


def slices(cumulants: np.ndarray) -> np.ndarray:
    """The unlike slices of a cumulant tensor; those off the diagonal stand for two."""
    one, two = np.tril_indices(len(cumulants))
    return cumulants[one, two] * np.where(one == two, 1.0, np.sqrt(2.0))[:, None, None]


def rounds_of(m: int, seed: int | None = None) -> list[np.ndarray]:
    """Rounds of disjoint pairs in which every pair meets once: places on a circle turn around one that stays. ``seed`` shuffles the rounds."""
    n = m + m % 2
    out = []
    for turn in range(n - 1):
        seat = np.r_[0, 1 + (np.arange(n - 1) + turn) % (n - 1)]
        pairs = np.sort(np.c_[seat[: n // 2], seat[::-1][: n // 2]], axis=1)
        out.append(pairs[pairs[:, 1] < m])
    if seed is not None:
        np.random.default_rng(seed).shuffle(out)
    return out


@dataclass(frozen=True)
class Fit:
    rotation: np.ndarray
    criterion: float
    record: dict


def diagonal_criterion(stack: np.ndarray, rotation: np.ndarray) -> float:
    return float((np.einsum("ia,kab,ib->ki", rotation, stack, rotation, optimize=True) ** 2).sum())


def jade(cumulants: np.ndarray, n: float, threshold: float | None = None, max_sweeps: int = 600, seed: int | None = None) -> Fit:
    """Rotation (rows are sources) that makes the slices of whitened cumulants as diagonal as plane rotations can.

    The angle of a pair comes from the leading axis of the 2 x 2 scatter of (difference of the diagonal
    entries, sum of those off it) over all slices. Pairs of a round are disjoint, so they turn at once.
    """
    m = len(cumulants)
    threshold = 1 / np.sqrt(n) / 100 if threshold is None else threshold
    start = slices(cumulants)
    stack, turn_all = start, np.eye(m)
    rounds, sweeps, largest, turned_pairs = rounds_of(m, seed), 0, 0.0, 0
    while sweeps < max_sweeps:
        sweeps, largest, active = sweeps + 1, 0.0, False
        for pairs in rounds:
            p, q = pairs.T
            x, y = stack[:, p, p] - stack[:, q, q], stack[:, p, q] + stack[:, q, p]
            a, b = ((x * x) - (y * y)).sum(0), 2 * (x * y).sum(0)
            angle = np.arctan2(b, a + np.hypot(a, b)) / 2
            largest = max(largest, float(np.abs(angle).max(initial=0.0)))
            angle = np.where(np.abs(angle) > threshold, angle, 0.0)
            if not angle.any():
                continue
            active, turned_pairs = True, turned_pairs + int((angle != 0).sum())
            turn = np.eye(m)
            turn[p, p] = turn[q, q] = np.cos(angle)
            turn[p, q], turn[q, p] = -np.sin(angle), np.sin(angle)
            stack = turn.T @ stack @ turn
            turn_all = turn_all @ turn
        if not active:
            break
    # Products of many rotations drift; the nearest orthogonal matrix is taken.
    u, _, vt = np.linalg.svd(turn_all)
    rotation = (u @ vt).T
    record = {"contrast": "jade", "sweeps": sweeps, "rotations": turned_pairs, "converged": not active, "threshold": threshold, "max_angle": largest, "schedule_seed": seed}
    return Fit(rotation, diagonal_criterion(start, rotation), record)


# ------------------------------------------------------------------ tanh likelihood


@dataclass(frozen=True)
class Likelihood:
    """Mean over features of psi(y) y', of psi' and of log cosh at y = W z."""

    outer: np.ndarray
    slope: np.ndarray
    loss: np.ndarray


def _likelihood(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    total = np.zeros((len(w), len(w) + 2))
    for k in range(0, len(z), CHUNK):
        y = z[k : k + CHUNK] @ w.T
        psi, a = np.tanh(y), np.abs(y)
        total += np.c_[psi.T @ y, (1 - psi**2).sum(0), (a + np.log1p(np.exp(-2 * a)) - np.log(2)).sum(0)]
    return total


def likelihood_of(block: DataFrame, width: int, k: np.ndarray, mean: np.ndarray, n: int) -> Callable[[np.ndarray], Likelihood]:
    """The likelihood as a function of W. A block of at most HELD doubles is one array; a larger one is passed over each time."""
    held = None
    if n * width <= HELD:
        held = all_rows(block, n, width)
        for i in range(0, n, CHUNK):
            held[i : i + CHUNK] = (held[i : i + CHUNK] - mean) @ k.T

    def at(w: np.ndarray) -> Likelihood:
        if held is not None:
            total = _likelihood(held, w)
        else:

            def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
                return sum((_likelihood((matrix(b.column(0), width) - mean) @ k.T, w) for b in batches), np.zeros((width, width + 2)))

            total = sums_of(block.select("vec"), (width, width + 2), make)
        total = total / n
        return Likelihood(total[:, :width], total[:, width], total[:, width + 1])

    return at


def skew_exp(a: np.ndarray) -> np.ndarray:
    """Orthogonal matrix of a skew-symmetric one."""
    value, vector = np.linalg.eigh(1j * a)
    return np.real(vector @ (np.exp(-1j * value)[:, None] * vector.conj().T))


def picard(at: Callable[[np.ndarray], Likelihood], m: int, seed: int = 0, max_iter: int = 1000, tol: float = 1e-7, start: np.ndarray | None = None, memory: int = 7) -> Fit:
    """Rotation at a stationary point of the tanh likelihood, by preconditioned limited-memory quasi-Newton steps on skew matrices.

    Sources whose density is flatter than the model's count with the opposite sign, which is read anew at every step.
    """
    if start is not None:
        off = float(np.abs(start @ start.T - np.eye(m)).max())
        if off > 1e-6:
            raise ValueError(f"the starting rotation is not orthogonal ({off:.1e})")
        u, _, vt = np.linalg.svd(start)
        w = u @ vt
    else:
        w, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((m, m)))
        w = w * np.sign(np.diag(r))

    def state(w: np.ndarray, sign: np.ndarray | None = None):
        x = at(w)
        inner = np.diag(x.outer)
        sign = np.where(x.slope - inner < 0, -1.0, 1.0) if sign is None else sign
        full = sign[:, None] * x.outer
        # Curvature of a pair, kept away from 0.
        h = (sign * (x.slope - inner))[:, None]
        return x, sign, (full - full.T) / 2, np.maximum((h + h.T) / 2, 0.01), float((sign * x.loss).sum())

    x, sign, gradient, curve, loss = state(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    done, iterations = False, 0
    for iterations in range(1, max_iter + 1):
        if np.abs(gradient).max() < tol:
            done = True
            break
        q, kept = gradient.copy(), []
        for s, y in reversed(steps):
            a = (s * q).sum() / (s * y).sum()
            kept.append(a)
            q = q - a * y
        q = q / curve
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            q = q + s * (a - (y * q).sum() / (s * y).sum())
        way = -q if (q * gradient).sum() > 0 else -gradient / curve
        size = 1.0
        for _ in range(12):
            new = skew_exp(size * way) @ w
            found = state(new, sign)
            if found[4] < loss + 1e-4 * size * 2 * (way * gradient).sum():
                break
            size /= 2
        else:
            if not steps:
                break
            steps = []
            continue
        old = gradient
        w = new
        x, new_sign, gradient, curve, loss = state(w)
        if (new_sign != sign).any():
            steps, sign = [], new_sign
            continue
        s, y = size * way, gradient - old
        if (s * y).sum() > 1e-12 * np.sqrt((s * s).sum() * (y * y).sum()):
            steps = [*steps, (s, y)][-memory:]
    done = done or bool(np.abs(gradient).max() < tol)
    u, _, vt = np.linalg.svd(w)
    record = {"contrast": "picard", "seed": seed, "iterations": iterations, "converged": done, "gradient": float(np.abs(gradient).max()), "warm_started": start is not None}
    return Fit(u @ vt, float(-x.loss.sum()), record)


# ------------------------------------------------------------------ read-out


@dataclass(frozen=True)
class GICA:
    #: cell, vec: unit deviation, skewed to the positive side
    activities: DataFrame
    #: feature, vec
    loadings: DataFrame
    #: feature, vec: whitened sources
    sources: DataFrame
    contrast: str
    rotation: np.ndarray
    whitening: np.ndarray
    unwhitening: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    sign: np.ndarray
    score_to_activity: np.ndarray
    feature_to_source: np.ndarray
    excess_kurtosis: np.ndarray
    #: Covariance of the scores, from which correlations of activities under other rotations follow.
    score_covariance: np.ndarray
    cumulants: np.ndarray
    span: PCA
    n_features: int
    reconstruction_error: float
    record: dict

    @property
    def width(self) -> int:
        return len(self.rotation)


def span(found: PCA, n_comps: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Scores and components of the leading ``n_comps``."""
    n = found.width if n_comps is None else residual.positive_int(n_comps, "n_comps")
    if n > found.width:
        raise ValueError(f"n_comps={n} exceeds the {found.width} components held")
    if n == found.width:
        return found.scores, found.components, n
    leading = F.slice("vec", 1, n).alias("vec")
    return found.scores.select("cell", leading), found.components.select("feature", leading), n


def numbered(components: DataFrame) -> DataFrame:
    """A block over features with their places in the order of features."""
    from loomwork.operators.rank import ranked

    return stored(ranked(components, "feature", name="j"))


def skewness_and_scale(block: DataFrame, width: int, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean of each place, and deviation and biased skewness of each place of the arrays times ``by``."""

    def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((5, max(width, by.shape[1])))
        for b in batches:
            x = matrix(b.column(0), width)
            y = x @ by
            total[0, 0] += len(x)
            total[1, :width] += x.sum(0)
            for k in (1, 2, 3):
                total[k + 1, : by.shape[1]] += (y**k).sum(0)
        return total

    n, mean, *sums = sums_of(block.select("vec"), (5, max(width, by.shape[1])), make)
    m1, m2, m3 = (s[: by.shape[1]] / n[0] for s in sums)
    var = m2 - m1**2
    return mean[:width] / n[0], np.sqrt(np.maximum(var, 0)), (m3 - 3 * m1 * m2 + 2 * m1**3) / np.maximum(var, 1e-300) ** 1.5


def orientation(scale: np.ndarray, skewness: np.ndarray) -> np.ndarray:
    if (scale <= 0).any():
        raise ValueError("an activity has no spread")
    return np.where(skewness < 0, -1.0, 1.0)


def gica(found: PCA, n_comps: int | None = None, contrast: str = "jade", max_sweeps: int = 600, threshold: float | None = None, schedule_seed: int | None = None, seed: int = 0, max_iter: int = 1000, tol: float = 1e-7, start: np.ndarray | None = None) -> GICA:
    """Independent components of the leading span of ``found``."""
    if contrast not in CONTRASTS:
        raise ValueError(f"contrast must be one of {CONTRASTS}, not {contrast!r}")
    scores, components, m = span(found, n_comps)
    block = numbered(components)
    (whole,) = moments(block, m)
    k, k_inverse, values = whitening(whole.covariance())
    cumulants = turned(whole.cumulants(), k)
    if contrast == "jade":
        fit = jade(cumulants, whole.n, threshold, max_sweeps, schedule_seed)
    else:
        fit = picard(likelihood_of(block, m, k, whole.m1, int(whole.n)), m, seed, max_iter, tol, start)
    w = fit.rotation
    off = float(np.abs(w @ w.T - np.eye(m)).max())
    if off > 1e-8:
        raise ArithmeticError(f"the rotation is not orthogonal ({off:.1e})")
    raw = k_inverse @ w.T
    (score_mean, scale, skewness), score_moments = skewness_and_scale(scores, m, raw), covariance_of(scores, m)
    sign = orientation(scale, skewness)
    to_activity = raw / scale * sign
    to_source = (scale * sign)[:, None] * (w @ k)
    error = float(np.linalg.norm(to_activity @ to_source - np.eye(m)) / np.sqrt(m))
    if error > 1e-8:
        raise ArithmeticError(f"maps to activities and loadings are not inverse ({error:.1e})")
    kurtosis = np.einsum("ia,ib,ic,id,abcd->i", w, w, w, w, cumulants, optimize=True)
    return GICA(
        activities=stored(shifted(scores, -score_mean, to_activity, "cell")), loadings=stored(mapped(components, to_source.T, "feature")), sources=stored(shifted(components, -whole.m1, (w @ k).T, "feature")),
        contrast=contrast, rotation=w, whitening=k, unwhitening=k_inverse, mean=whole.m1, scale=scale, sign=sign, score_to_activity=to_activity, feature_to_source=to_source,
        excess_kurtosis=kurtosis, score_covariance=score_moments, cumulants=cumulants, span=found, n_features=int(whole.n), reconstruction_error=error,
        record={**fit.record, "criterion": fit.criterion, "n_comps": m, "eigenvalues": values.tolist(), "max_sweeps": max_sweeps, "threshold_given": threshold, "seed": seed, "max_iter": max_iter, "tol": tol},
    )


def covariance_of(block: DataFrame, width: int) -> np.ndarray:
    def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            x = np.c_[np.ones(len(b)), matrix(b.column(0), width)]
            total += x.T @ x
        return total

    total = sums_of(block.select("vec"), (width + 1, width + 1), make)
    total /= total[0, 0]
    return total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:])


def shifted(block: DataFrame, by: np.ndarray, to: np.ndarray, key: str) -> DataFrame:
    moved = F.zip_with("vec", F.array(*[F.lit(float(x)) for x in by]), lambda x, y: x + y)
    return mapped(block.select(key, moved.alias("vec")), to, key)
