"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of order n of a word and a landmark counts the subsequences of n characters that they share,
each weighed by DECAY to the power of the length that it spans in either, so inserted characters lower
it and don't end it. As a share of the landmark's own (at most 1), it is averaged over all orders from ``ORDER``
to the landmark's length. Words are taken in lower case with all but letters removed, and runs of
single characters are joined first. A text's kernel with a landmark is that of its closest word; over the
landmarks' own kernel matrix (Nyström) it becomes the features of a linear SVM.

Landmarks are pieces of words that set toxic sample texts apart. The classifier is fitted
on at most ``SAMPLE`` labelled rows of each class, chosen by hash, and on a variant of each toxic one, in which one of its
insults stands alone with a character inserted; scoring covers whole texts.

Kernels are computed where they can reach ``CLOSE``, below which they count as 0: an order above the longest common
subsequence adds nothing and any other at most its share, so that length is a bound. Words over ``LONGEST`` characters are taken as
overlapping parts, in training as in scoring; spans of over half of that are far under ``CLOSE``.

Defined results: null and empty texts get the score of a text with no close word; repeated rows each get
a row; labels that are null are not learnt from; an empty table gives an empty result, and
without labels of both classes every score is 0; a column of the score's name is replaced.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.words import trimmed

ORDER, DECAY = 4, 0.65
SAMPLE = 1500
LANDMARKS = 48
#: Most characters of a landmark.
WIDEST = 12
CLOSE = 0.6
LONGEST = 24
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_OTHER = re.compile(r"[\W\d_]+")


def words_of(text: str) -> set[str]:
    """Distinct words of a text, as the kernel takes them; runs of three single letters and more are words too."""
    words = _WORD.findall(text.lower())
    out = set(words)
    single = [k for k, w in enumerate(words) if len(w) == 1 and w.isalpha()]
    start = 0
    for k in range(1, len(single) + 1):
        if k == len(single) or single[k] != single[k - 1] + 1:
            if k - start >= 3:
                out.add("".join(words[single[start] : single[k - 1] + 1]))
            start = k
    return out


def plain(words: list[str]) -> list[str]:
    return [w if w.isalpha() else _OTHER.sub("", w) for w in words]


def pieces(word: str) -> list[str]:
    """A word, or its overlapping parts where it is long."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def codes(strings: list[str]) -> np.ndarray:
    """Characters of each string, 0 beyond its end."""
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros((len(strings), int(size.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def kernels(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Kernels of all rows of a with all rows of b (character codes, 0 beyond the end), for each order from ORDER to ``most``."""
    n, m, la, lb = len(a), len(b), a.shape[1], b.shape[1]
    same = [[(a[:, None, i] == b[None, :, j]) & (a[:, None, i] > 0) for j in range(lb)] for i in range(la)]
    # prefix[i][j]: sums over shared subsequences of the length so far that end by (i, j), decayed to there.
    prefix = [[np.ones((n, m), np.float32) for _ in range(lb + 1)] for _ in range(la + 1)]
    out = []
    for order in range(1, (most or ORDER) + 1):
        if order >= ORDER:
            total = np.zeros((n, m), np.float32)
            for i in range(la):
                for j in range(lb):
                    total += DECAY * DECAY * same[i][j] * prefix[i][j]
            out.append(total)
            if not total.any():
                break
        new = [[np.zeros((n, m), np.float32) for _ in range(lb + 1)] for _ in range(la + 1)]
        for i in range(1, la + 1):
            along = np.zeros((n, m), np.float32)
            for j in range(1, lb + 1):
                along = DECAY * along + DECAY * DECAY * same[i - 1][j - 1] * prefix[i - 1][j - 1]
                new[i][j] = DECAY * new[i - 1][j] + along
        prefix = new
    return np.stack(out + [np.zeros((n, m), np.float32)] * ((most or ORDER) - ORDER + 1 - len(out)))


class Landmarks:
    def __init__(self, strings: list[str]):
        self.strings, self.codes = strings, codes(strings)
        self.sizes = np.array([len(x) for x in strings])
        self.orders = int(self.sizes.max()) - ORDER + 1
        self.own = np.diagonal(kernels(self.codes, self.codes, int(self.sizes.max())), axis1=1, axis2=2).copy()
        # Shortest common subsequence with which the mean over orders can reach CLOSE.
        self.need = ORDER - 1 + np.ceil(CLOSE * (self.sizes - ORDER + 1) - 1e-9).astype(int)
        # Where each letter stands in each landmark, as bits; letter 0 is any other.
        self.alphabet = np.unique(self.codes[self.codes > 0])
        self.where = np.zeros((len(self.alphabet) + 1, len(strings)), np.uint64)
        for k, row in enumerate(self.codes):
            for j, c in enumerate(row[: self.sizes[k]]):
                self.where[np.searchsorted(self.alphabet, c) + 1, k] |= np.uint64(1) << np.uint64(j)
        own = self.values(self.codes)
        self.matrix = (own + own.T) / 2
        value, vector = np.linalg.eigh(self.matrix.astype(float))
        keep = value > 1e-6 * value.max()
        self.whiten = vector[:, keep] / np.sqrt(value[keep])

    def values(self, chars: np.ndarray) -> np.ndarray:
        """Mean over a landmark's orders of the kernel as a share of its own, each at most 1."""
        share = np.minimum(kernels(chars, self.codes, int(self.sizes.max())) / np.where(self.own > 0, self.own, np.inf)[:, None, :], 1.0)
        return share.sum(0) / (self.sizes - ORDER + 1)

    def common(self, chars: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each row with each landmark, by bits."""
        at = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        letter = np.where(self.alphabet[at] == chars, at + 1, 0)
        left = np.full((len(chars), len(self.strings)), np.uint64((1 << 64) - 1))
        for i in range(chars.shape[1]):
            hit = left & self.where[letter[:, i]]
            left = (left + hit) | (left - hit)
        full = (np.uint64(1) << self.sizes.astype(np.uint64)) - np.uint64(1)
        return np.bitwise_count(~left & full)

    def close(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which words come close to a landmark, and their kernels, at most 1."""
        held = [(k, p) for k, w in enumerate(plain(words)) if len(w) >= ORDER for p in pieces(w)]
        rows, values = [np.zeros(0, np.int64)], [np.zeros((0, len(self.strings)), np.float32)]
        held.sort(key=lambda x: len(x[1]))
        for i in range(0, len(held), 1000):
            part = held[i : i + 1000]
            chars = codes([p for _, p in part])
            at = np.flatnonzero((self.common(chars) >= self.need).any(1))
            if len(at):
                v = self.values(chars[at])
                near = np.flatnonzero(v.max(1) >= CLOSE)
                v = v[near]
                rows.append(np.array([part[j][0] for j in at[near]], np.int64))
                values.append(np.where(v >= CLOSE, v, 0.0))
        return np.concatenate(rows), np.concatenate(values)


def texts_kernels(marks: Landmarks, sets: list[set[str]], known: dict[str, np.ndarray | None]) -> np.ndarray:
    """The kernels of texts with the landmarks. known: kernels of words met before."""
    new = list({w for s in sets for w in s if w not in known})
    for w in new:
        known[w] = None
    rows, values = marks.close(new)
    for r, v in zip(rows.tolist(), values, strict=True):
        before = known[new[r]]
        known[new[r]] = v if before is None else np.maximum(before, v)
    out = np.zeros((len(sets), len(marks.strings)), np.float32)
    for i, s in enumerate(sets):
        for w in s:
            if (v := known[w]) is not None:
                np.maximum(out[i], v, out=out[i])
    return out


def all_parts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of 4 to 7 characters of every word: a number for each part, where each word's begin, and a place (word, begin, length) of each number."""
    chars = codes(words).astype(np.uint64)
    word, at, size, value = [], [], [], []
    for n in range(4, 8):
        if chars.shape[1] >= n:
            h = np.zeros((len(words), chars.shape[1] - n + 1), np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + chars[:, k : k + h.shape[1]] + np.uint64(n)
            w, a = np.nonzero(chars[:, n - 1 :])
            word.append(w.astype(np.int32))
            at.append(a.astype(np.int32))
            size.append(np.full(len(w), n, np.int32))
            value.append(h[w, a])
    if not word:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64), np.zeros((0, 3), np.int32)
    word, at, size, value = map(np.concatenate, (word, at, size, value))
    _, first, number = np.unique(value, return_index=True, return_inverse=True)
    del value
    places = np.stack([x[first] for x in (word, at, size)], axis=1)
    del at, size
    order = np.argsort(word, kind="stable")
    return number[order].astype(np.int32), np.searchsorted(word[order], np.arange(len(words) + 1)), places


def choose(sets: list[set[str]], toxic: np.ndarray) -> list[str]:
    """Pieces whose share among toxic texts most exceeds their share among others, each unlike those before it."""
    texts = [[p for w in plain(sorted(s)) if len(w) >= ORDER for p in pieces(w)] for s in sets]
    words = sorted({w for t in texts for w in t})
    index = {w: k for k, w in enumerate(words)}
    number, start, places = all_parts(words)
    count = np.zeros((2, len(places)), np.int64)
    for t, bad in zip(texts, toxic, strict=True):
        if t:
            own = np.unique(np.concatenate([number[start[k] : start[k + 1]] for k in map(index.__getitem__, t)]))
            count[int(bad), own] += 1
    n0, n1 = max(1, int((~toxic).sum())), max(1, int(toxic.sum()))
    both = count.sum(0) / (n0 + n1)
    z = (count[1] / n1 - count[0] / n0) / np.sqrt(both * (1 - both) * (1 / n0 + 1 / n1) + 1e-12)
    good = np.flatnonzero((z >= 5) & (count[1] >= 5) & (count[1] / n1 > 3 * count[0] / n0))
    names = {int(k): words[w][a : a + n] for k, (w, a, n) in zip(good, places[good].tolist(), strict=True)}
    is_good = np.zeros(len(places), bool)
    is_good[good] = True
    held = {}
    for k, w in enumerate(words):
        own = number[start[k] : start[k + 1]]
        if (hit := own[is_good[own]]).size:
            held[w] = {names[int(x)] for x in hit}
    texts = [[w for w in t if w in held] for t in texts]
    # What a piece tells beyond those chosen: words that hold one of them no longer count.
    out: list[str] = []
    while len(out) < LANDMARKS and held:
        left = [Counter(), Counter()]
        for t, bad in zip(texts, toxic, strict=True):
            left[int(bad)].update({p for w in t if w in held for p in held[w]})
        best, top = "", 7.0
        for p, c in left[1].items():
            both = (c + left[0][p]) / (n0 + n1)
            v = (c / n1 - left[0][p] / n0) / np.sqrt(both * (1 - both) * (1 / n0 + 1 / n1) + 1e-12)
            if (v, len(p), p) > (top, len(best), best) and c / n1 > 10 * left[0][p] / n0:
                best, top = p, v
        if not best:
            break
        # The longest piece that nearly all of these texts have tells the most.
        best = max((q for q in left[1] if best in q and left[1][q] >= 0.85 * left[1][best]), key=lambda q: (len(q), left[1][q], q))
        best = widened(best, [[w for w in t if best in w] for t, bad in zip(texts, toxic, strict=True) if bad])
        out.append(best)
        held = {w: own for w, own in held.items() if best not in w}
    return out


def widened(piece: str, texts: list[list[str]]) -> str:
    """``piece`` with the letters beside it that nearly all of the texts with it have there, up to WIDEST."""
    while len(piece) < WIDEST:
        beside = Counter()
        have = [t for t in texts if any(piece in w for w in t)]
        for t in have:
            beside.update({w[max(0, i - left) : i + len(piece) + 1 - left] for w in t if (i := w.find(piece)) >= 0 for left in (0, 1)} - {piece})
        best = max(beside, key=lambda q: (beside[q], q), default="")
        if beside[best] < 0.85 * len(have):
            break
        piece = best
    return piece


def variants(x: np.ndarray) -> np.ndarray:
    """Kernels of texts with one landmark alone and a character inserted, for rows that hold landmarks whole."""
    out = []
    for row in x:
        whole = np.flatnonzero(row >= 1 - 1e-6)
        if len(whole):
            out.append(np.zeros_like(row))
            out[-1][whole[len(out) % len(whole)]] = DECAY
    return np.stack(out) if out else x[:0]


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Dual coordinate descent for the squared hinge; the last weight is the bias. Classes weigh the same."""
    x = np.c_[x, np.ones(len(x))]
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y <= 0).mean(), 1e-9)) * c
    square, alpha, w = (x * x).sum(1) + 0.5 / weight, np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            step = max(0.0, alpha[i] - (y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / weight[i]) / square[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w


def fit_sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, by Newton steps."""
    a, b, t = 1.0, 0.0, (y > 0).astype(float) * 0.98 + 0.01
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        r = p * (1 - p) + 1e-6
        h = np.array([[(r * margin * margin).sum() + 1e-3, (r * margin).sum()], [(r * margin).sum(), r.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(a), float(b)


class Model:
    def __init__(self, sets: list[set[str]], toxic: np.ndarray):
        self.marks = None
        if toxic.any() and not toxic.all() and (strings := choose(sets, toxic)):
            self.marks = Landmarks(strings)
            x = texts_kernels(self.marks, sets, {})
            more = variants(x[toxic])
            x = np.r_[x, more] @ self.marks.whiten
            y = np.r_[np.where(toxic, 1.0, -1.0), np.ones(len(more))]
            self.weights = fit_svm(x, y)
            self.curve = fit_sigmoid(x @ self.weights[:-1] + self.weights[-1], y)

    def scores(self, sets: list[set[str]], known: dict) -> np.ndarray:
        if self.marks is None:
            return np.zeros(len(sets))
        margin = texts_kernels(self.marks, sets, known) @ self.marks.whiten @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """``labels``: doc_id, toxic of the rows that may be learnt from; at most SAMPLE of each class are."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int")).distinct()
    some = None
    for kind in (0, 1):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        some = part if some is None else some.union(part)
    taken = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(sorted(words_of(x.as_py() or ""))) for x in b.column(1)], pa.string()), b.column(2)], ["doc_id", "words", "toxic"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches, schema).sort_by([("doc_id", "ascending"), ("words", "ascending")])
        model = Model([set(w.as_py().split(" ")) - {""} for w in got["words"]], got["toxic"].to_numpy() == 1)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], ["model"])

    # The bounded sample is one task's work on an executor; the driver gets landmarks and weights, some kilobytes.
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.string()), ("toxic", pa.int32())])
    rows = taken.select(F.col("doc_id").cast("long"), "text", "toxic").mapInArrow(trimmed(sets), "doc_id long, words string, toxic int")
    fitted = rows.repartition(1).mapInArrow(trimmed(fit), "model binary").head()
    return pickle.loads(fitted["model"]) if fitted else Model([], np.zeros(0, bool))


def add_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of each text; a column of that name is replaced."""
    from pyspark.sql.types import DoubleType, StructType

    docs = docs.drop(name)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at = names.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                score = model.scores([words_of(x.as_py() or "") for x in part.column(at)], known)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*names, name])
                if len(known) > 100_000:
                    known.clear()

    return docs.mapInArrow(trimmed(add), StructType([*docs.schema.fields]).add(name, DoubleType()))


THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = add_scores(docs, train(docs, labels.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
