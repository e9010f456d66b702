"""Toxicity by compression distance.

Two raw-content zstandard dictionaries are trained, one a class. Each begins with the substrings that its class has in
more surroundings than the other class has, by a test of proportions over all substrings of ``SHORTEST`` to ``LONGEST``
characters inside words, the ends of words included; copies of a passage count once. Both end with the same ordinary
background, so that a window without anything peculiar to a class compresses to the same length under either. How
peculiar a substring must be is chosen on rows held back: the strictest limit within a standard error of the least loss. The
differences of the compressed lengths of all windows of a text, counted by size, give a logistic score from 0 to 1,
fitted on the same out-of-fold rows.

Cases: a null or empty text has the score that no windows give (low); very long texts are cut into windows that
are all read; repeated rows and ties get equal scores; an empty table gives an empty result; without labelled rows
of both kinds fitting raises ``ValueError``. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled_texts, trim, whole

_WORD = re.compile(r"\w+")
SHORTEST, LONGEST = 4, 9
LIMITS = (3.0, 6.0, 9.0, 13.0)
FAIR = 2


def windows(data: bytes, size: int) -> list[bytes]:
    """All of ``data`` in pieces of ``size`` bytes, each grown to the next space if one is near."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = at + size
        if end < n:
            gap = data.find(b" ", end, end + size)
            end = gap if gap >= 0 else end
        out.append(data[at:end])
        at = end
    return out


def contextual_counts(texts: Iterable[str]) -> Counter:
    """Words by the number of different neighbourhoods they stand in: copies of a text count once."""
    seen: set[tuple[str, str, str]] = set()
    for text in texts:
        words = _WORD.findall(text.lower())
        seen.update(zip(["", *words[:-1]], words, [*words[1:], ""], strict=True))
    return Counter(word for _, word, _ in seen)


@dataclass
class ToxicityModel:
    """Dictionaries and calibration; small enough to travel in a task's closure."""

    toxic: bytes
    ordinary: bytes
    window: int = 96
    least_match: int = 6
    weights: np.ndarray = field(default_factory=lambda: np.zeros(16))

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        plain = {"window_log": 17, "format": zstandard.FORMAT_ZSTD1_MAGICLESS, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
        # Only matches longer than most syllables count, for those of a window in either dictionary differ by chance.
        params = zstandard.ZstdCompressionParameters.from_level(9, strategy=zstandard.STRATEGY_LAZY2, min_match=self.least_match, **plain)
        made = []
        for content in (self.toxic, self.ordinary):
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(compression_params=params, dict_data=trained))
        return made[0], made[1]

    def features(self, texts: list[str], pair: tuple | None = None) -> np.ndarray:
        """Per text: the windows with each gain in bytes from -3 or less to 8 or more, the largest gain, and the share and log of the fair ones."""
        toxic, ordinary = pair or self.compressors()
        out = np.zeros((len(texts), 15))
        for row, text in enumerate(texts):
            data = text.lower().encode("utf-8", "surrogatepass")
            if not data:
                continue
            pieces = windows(data, self.window)
            gains = np.fromiter((len(ordinary.compress(x)) - len(toxic.compress(x)) for x in pieces), np.int64, len(pieces))
            fair = (gains >= FAIR).sum()
            out[row] = *np.bincount(np.clip(gains, -3, 8) + 3, minlength=12), gains.max(), fair / len(pieces), math.log1p(fair)
        return out

    def scores(self, texts: list[str], pair: tuple | None = None) -> np.ndarray:
        z = np.clip(self.features(texts, pair) @ self.weights[1:] + self.weights[0], -30, 30)
        return 1 / (1 + np.exp(-z))


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the constant first, by damped Newton steps."""
    scale = features.std(axis=0) + 1e-9
    x = np.hstack([np.ones((len(features), 1)), features / scale])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (labels - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return np.concatenate([w[:1], w[1:] / scale])


def peculiar(own: Counter, other: Counter, least: int = 4) -> list[tuple[float, str]]:
    """(strength, substring) of what ``own`` has in more surroundings than ``other``, the strongest first; no two overlap by ``SHORTEST`` characters."""

    def parts(word: str) -> set[str]:
        word = f" {word} "
        return {word[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(word) - n + 1)}

    n1, n0 = sum(own.values()) + 1, sum(other.values()) + 1
    a: Counter = Counter()
    for word, n in own.items():
        for part in parts(word):
            a[part] += n
    b = {part: 0 for part, n in a.items() if n >= least}
    for word, n in other.items():
        for part in parts(word):
            if part in b:
                b[part] += n

    def strength(part: str) -> float:
        p = (a[part] + b[part]) / (n0 + n1)
        return (a[part] / n1 - b[part] / n0) / math.sqrt(p * max(1 - p, 1e-9) * (1 / n0 + 1 / n1))

    kept: list[tuple[float, str]] = []
    taken: set[str] = set()
    for power, part in sorted(((strength(part), part) for part in b), key=lambda x: (-x[0], -len(x[1]), x[1])):
        if power < LIMITS[0]:
            break
        shortest = {part[i : i + SHORTEST] for i in range(len(part) - SHORTEST + 1)}
        if not shortest & taken:
            kept.append((power, part))
            taken |= shortest
    return kept


def _dictionaries(toxic: Counter, ordinary: Counter, background: int, most: int):
    """A function from a limit to an unfitted model."""
    common = sorted((w for w, n in ordinary.items() if n >= 3), key=lambda w: (ordinary[w], w))
    shared = (" ".join(common) + " ").encode()[-background:].rjust(8)
    found = [peculiar(a, b) for a, b in ((toxic, ordinary), (ordinary, toxic))]

    def of(limit: float) -> ToxicityModel:
        own = ["|".join(part for power, part in reversed(x) if power >= limit).encode()[-most:] for x in found]
        return ToxicityModel(own[0] + shared, own[1] + shared)

    return of


def train(texts: list[str], labels: list[int], *, background: int = 8192, most: int = 16384) -> ToxicityModel:
    """A model from labelled texts: the rows of two folds are scored with each other's dictionaries to choose the limit and the weights."""
    by = {k: [t for t, y in zip(texts, labels, strict=True) if y == k] for k in (0, 1)}
    if not by[0] or not by[1]:
        raise ValueError("labelled texts of both kinds are needed")

    def learnt(fold: int | None):
        toxic, ordinary = (contextual_counts(by[k] if fold is None else by[k][1 - fold :: 2] or by[k]) for k in (1, 0))
        return _dictionaries(toxic, ordinary, background, most)

    halves = [learnt(0), learnt(1)]
    held = [[(t, k) for k in (0, 1) for t in by[k][fold::2]] for fold in (0, 1)]
    y = np.array([k for fold in held for _, k in fold], float)
    tried = []
    for limit in LIMITS:
        x = np.vstack([halves[fold](limit).features([t for t, _ in held[fold]]) for fold in (0, 1) if held[fold]])
        weights = logistic(x, y)
        z = np.clip(x @ weights[1:] + weights[0], -30, 30)
        tried.append((np.logaddexp(0, z) - y * z, limit, weights))
    least = min((loss for loss, _, _ in tried), key=np.mean)
    _, limit, weights = [t for t in tried if t[0].mean() <= least.mean() + least.std() / math.sqrt(len(y))][-1]
    model = learnt(None)(limit)
    model.weights = weights
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", *, rows_per_label: int = 2000, chars: int = 6000) -> ToxicityModel:
    """Fits on a bounded sample: at most ``rows_per_label`` labelled ids of each label, ``chars`` code points of each text."""
    keys = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("label")).where(F.col("k").isNotNull() & F.col("label").isin(0, 1))
    texts = sampled_texts(keys, "label", rows_per_label, chars, docs.select(F.col(key).alias("k"), F.col(text).alias("t")))
    pairs = [(t, k) for k in (0, 1) for t in texts.get(k, [])]
    return train([t for t, _ in pairs], [k for _, k in pairs])


def score(model: ToxicityModel, text: Column) -> Column:
    """The score of a text column, 0 to 1."""
    pair: list = []

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        if not pair:
            pair.append(model.compressors())
        trim()
        return pa.array(model.scores(column.to_pylist(), pair[0]))

    return scored.asNondeterministic()(whole(text))
