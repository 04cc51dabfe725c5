"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; unlabelled text is drawn from all documents;
the share of good text in it is estimated from the two samples. A small network on text
profiles then minimises the non-negative unbiased risk

    prior * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - prior * E_pos[loss(-f)])

with the logistic loss, so that its sigmoid is the probability of good text. Profiles count
which kinds of characters follow each other, how words and lines repeat, and lengths; they are
computed in numpy from whole texts. The fit takes two bounded samples to the driver; scoring
is one narrow pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm.common import texts
from pairforge.llm.hashing import Words, batches, utf8

#: Bounds of the two samples that the fit sees (about; chosen by a hash of doc_id).
MOST_POSITIVE, MOST_UNLABELLED = 8_000, 16_000

# Kinds of bytes; the second byte of a character counts as its letter.
_KINDS = 10
_KIND = np.full(256, 0, dtype=np.int64)
_KIND[0x00:0x80] = 8
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c",
                             ".,;:", "!?", "#*$%&|<>", None, "'\"()-")):
    if _chars:
        _KIND[[ord(c) for c in _chars]] = _k


def profiles(rows: list[bytes]) -> np.ndarray:
    """One row of numbers per text, all zero for an empty one."""
    out = [_profile(rows[part]) for part in batches(rows)]
    return np.concatenate(out) if out else np.zeros((0, width()))


def width() -> int:
    return _KINDS * _KINDS + 9


def _profile(rows: list[bytes]) -> np.ndarray:
    n = len(rows)
    w = Words(rows)
    data = w.data
    kind = _KIND[data]
    kind[:-1][(data[:-1] == 0xC3) & (data[1:] < 0x9F)] = 1
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=n)
    ends = np.cumsum(sizes + 1)
    owner = np.repeat(np.arange(n), np.maximum(sizes - 1, 0))
    inner = np.ones(len(data) - 1, dtype=bool)
    inner[0] = False
    inner[np.concatenate([ends - 1, ends[:-1]])] = False
    at = np.flatnonzero(inner)
    pairs = np.bincount(owner * _KINDS**2 + kind[at] * _KINDS + kind[at + 1], minlength=n * _KINDS**2).reshape(n, -1)
    share = np.sqrt(pairs / np.maximum(1, sizes - 1)[:, None])
    h, first = w.hashes(), w.first
    counts = np.diff(first)
    rest = np.zeros((n, 9))
    word_sizes = w.ends - w.starts
    for i, row in enumerate(rows):
        own = h[first[i] : first[i + 1]]
        if not len(own):
            continue
        m = len(own)
        sizes_i = word_sizes[first[i] : first[i + 1]]
        u, k = np.unique(own, return_counts=True)
        lines = row.split(b"\n")
        rest[i] = (
            (own[1:] == own[:-1]).sum() / m, 1 - len(u) / m, k.max() / m, (own[2:] == own[:-2]).sum() / m,
            1 - len(set(lines)) / len(lines), np.log1p(m), sizes_i.mean() / 10, sizes_i.std() / 10, np.log1p(m / len(lines)),
        )
    rest[counts == 0] = 0
    return np.concatenate([share, rest], axis=1)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled sample, from held-out scores of a positive-or-
    unlabelled classifier: the smallest ratio of the two samples' upper tails, each with its
    confidence bound (best-bin estimate)."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.95, 96)))
    p = (positive[:, None] >= cuts).mean(axis=0)
    u = (unlabelled[:, None] >= cuts).mean(axis=0)
    slack = np.sqrt(np.log(20) / (2 * len(positive))) + np.sqrt(np.log(20) / (2 * len(unlabelled)))
    best = np.argmin((u + slack) / p)
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """One hidden layer; f(x) is a log-odds."""

    def __init__(self, n_in: int, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.weights = [rng.normal(0, 1 / np.sqrt(n_in), (n_in, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden),
                        np.zeros(1), rng.normal(0, 0.01, n_in)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d, direct = self.weights
        z = np.tanh(x @ a + b)
        return z @ c + d + x @ direct, z

    def gradients(self, x: np.ndarray, z: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
        dz = by[:, None] * self.weights[2] * (1 - z * z)
        return [x.T @ dz, dz.sum(axis=0), z.T @ by, by.sum(keepdims=True), x.T @ by]

    def train(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int, decay: float = 1e-3, rate: float = 0.01) -> None:
        """Adam on the non-negative risk; without a prior, on plain positive-or-unlabelled loss."""
        rng = np.random.default_rng(11)
        m = [np.zeros_like(w) for w in self.weights]
        v = [np.zeros_like(w) for w in self.weights]
        for t in range(1, steps + 1):
            p = positive[rng.integers(0, len(positive), 1024)]
            u = unlabelled[rng.integers(0, len(unlabelled), 2048)]
            (fp, zp), (fu, zu) = self.forward(p), self.forward(u)
            if prior is None:
                gp, gu = -_sigmoid(-fp) / len(p), _sigmoid(fu) / len(u)
            else:
                negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
                gu, back = _sigmoid(fu) / len(u), -prior * _sigmoid(fp) / len(p)
                if negative >= 0:
                    gp = -prior * _sigmoid(-fp) / len(p) + back
                else:  # step against the part that fell below zero
                    gp, gu = -back, -gu
            for i, (a, b) in enumerate(zip(self.gradients(p, zp, gp), self.gradients(u, zu, gu), strict=True)):
                g = a + b + decay * self.weights[i] * (self.weights[i].ndim > 1 or i == 4)
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.weights[i] = self.weights[i] - rate * (1 - 0.9 * t / steps) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


class Model:
    """What scoring needs: scale of the profiles, the estimated prior and the network."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, steps: int = 600):
        self.mean, self.std = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
        p, u = self.scaled(positive), self.scaled(unlabelled)
        probe = Network(p.shape[1])
        probe.train(p[0::2], u[0::2], None, steps // 2)
        self.prior = estimate_prior(probe.forward(p[1::2])[0], probe.forward(u[1::2])[0])
        self.network = Network(p.shape[1])
        self.network.train(p, u, self.prior, steps)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8)

    def score(self, rows: list[bytes]) -> np.ndarray:
        return _sigmoid(self.network.forward(self.scaled(profiles(rows)))[0])


def held_out(doc_id: Column) -> Column:
    """The fold that never lends its labels: crc32 of the id as text, modulo 5, is 0. A row
    without an id is in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _draw(doc_id: Column, share: float, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 40)) < int(share * (1 << 40))


@F.arrow_udf(T.BinaryType())
def _profile_udf(column: pa.Array) -> pa.Array:
    return pa.array([r.astype("<f4").tobytes() for r in profiles(utf8(column))], pa.binary())


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model | None:
    """Model from texts (doc_id, text) and labels (doc_id, quality). Rows of the held-out fold
    are not used. About ``most_positive`` documents labelled 1 (never 0: conflicting labels do
    not count) and ``most_unlabelled`` of all are drawn by a hash of their id; None when either
    has fewer than 8 rows."""
    labels = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = labels.where("quality = 1").select("doc_id")
    rows = texts(docs).where(~held_out(F.col("doc_id")))
    n_good, n_rows = good.count(), rows.count()
    share = min(1.0, most_positive / max(1, n_good))
    positive = rows.where(_draw(F.col("doc_id"), share, 1)).join(good.where(_draw(F.col("doc_id"), share, 1)), "doc_id")
    unlabelled = rows.where(_draw(F.col("doc_id"), min(1.0, most_unlabelled / max(1, n_rows)), 2))

    def sample(df: DataFrame) -> np.ndarray:
        found = sorted((r[0], bytes(r[1])) for r in df.select("doc_id", _profile_udf("text")).collect())
        return np.frombuffer(b"".join(x for _, x in found), dtype="<f4").reshape(-1, width()).astype(np.float64)

    p, u = sample(positive), sample(unlabelled)
    return Model(p, u) if min(len(p), len(u)) >= 8 else None


def score(model: Model | None, text: Column) -> Column:
    """Probability of good text for any text, null and empty ones included; 0.5 without a model."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def quality(column: pa.Array) -> pa.Array:
        return pa.array(model.score(utf8(column)))

    return quality(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1: good) in place of columns of those names.
    One narrow pass; rows keep their other columns, repeated rows their scores."""
    return docs.withColumn("score", score(model, F.col("text"))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
