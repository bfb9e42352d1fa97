"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence is a weighted sum of its own features and those of the lines before and
after it; neighbouring lines also influence each other through a transition score. The forward-backward algorithm
gives each line's probability of being good, and a document's quality is their mean weighted by line length, mapped
to the scale of the labels by a logistic curve.

Training uses a bounded sample of labelled documents, whose label stands for all their lines. Scoring is a map over
all documents: a batch's lines are measured together in numpy arrays, and the chains of a batch advance together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .bpe import slices

#: Documents in the training sample, and code points of a document in it, at most.
SAMPLE, SAMPLE_CHARS = 4000, 20_000
EPOCHS, STEP, SHRINK = 30, 0.05, 1e-3
#: Score from which a document is predicted to be good.
THRESHOLD = 0.7

# Classes of bytes.
_CLASSES = {
    1: b"abcdefghijklmnopqrstuvwxyz",
    2: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    3: b"0123456789",
    4: b" \t\r\n\x0b\x0c",
    5: b".,;:'\"-()?",
    6: b"!",
    7: b"|",
    8: b"#$%&*+/<=>@[\\]^_`{}~",
}
_TABLE = np.zeros(256, np.uint8)
for _code, _members in _CLASSES.items():
    _TABLE[np.frombuffer(_members, np.uint8)] = _code
N_FEATURES = 17
#: A number for each byte; a word's sum tells it from its neighbour.
_MARK = np.random.default_rng(11).integers(1, 1 << 40, 256)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, bytes by line, number of lines by text); an empty text is one empty line."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    kind = _TABLE[data]
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    per_text = np.array([r.count(b"\n") + 1 for r in raw], np.int64)
    length = (ends - starts).astype(np.float64)

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.view(np.uint8), starts, dtype=np.int32).astype(np.float64)

    space = kind == 4
    symbol = (kind >= 6) & (kind <= 8)
    words = total(~space & np.concatenate(([True], space[:-1])))
    count = {code: total(kind == code) for code in range(1, 9)}
    count[4] -= 1  # without the line's end
    last_symbol = total(symbol & np.concatenate((space[1:], [True])))
    capital = total((kind == 2) & np.concatenate(([True], space[:-1])))
    some, any_word = np.maximum(length, 1), np.maximum(words, 1)
    begin = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    stop = np.flatnonzero(~space & np.concatenate((space[1:], [True])))
    marks = np.cumsum(_MARK[data])
    mark = marks[stop] - marks[begin] + _MARK[data[begin]]
    same = np.zeros(len(begin), bool)
    same[1:] = (mark[1:] == mark[:-1]) & (np.diff(stop - begin) == 0)
    stutter = np.bincount(np.searchsorted(ends, begin), weights=same, minlength=len(ends))
    seen_before = np.zeros(len(ends))
    at = 0
    for r, n in zip(raw, per_text.tolist(), strict=True):
        if n > 1:
            seen: set[bytes] = set()
            for i, line in enumerate(r.split(b"\n")):
                if line in seen:
                    seen_before[at + i] = 1
                elif line:
                    seen.add(line)
        at += n
    other = length - sum(count.values())
    columns = [
        np.log1p(length),
        length == 0,
        *[count[c] / some for c in range(1, 9)],
        other / some,
        last_symbol / any_word,
        capital / any_word,
        np.log1p(length / any_word),
        stutter / any_word,
        seen_before,
        np.log1p(words),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1), length, per_text


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  #: of the line before, the line and the line after, and a constant
    stay: float  #: by how much two neighbours of one state outweigh two of different states
    slope: float = 1.0
    shift: float = 0.0


def _inputs(model: Model, features: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    x = (features - model.mean) / model.scale
    first = np.cumsum(per_text) - per_text
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first] = 0
    after[first + per_text - 1] = 0
    return np.hstack([before, x, after, np.ones((len(x), 1))])


def marginals(evidence: np.ndarray, stay: float, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of good by line, log partition function by text, expected equal neighbours by text).

    ``evidence`` is each line's score of good against bad. The chains advance together, longest first, so that step t
    works on those with more than t lines.
    """
    order = np.argsort(-per_text, kind="stable")
    size = per_text[order]
    first = (np.cumsum(per_text) - per_text)[order]
    keep = np.exp(stay)
    local = np.stack([np.exp(-np.maximum(evidence, 0)), np.exp(np.minimum(evidence, 0))], axis=1)  # both at most 1
    forward = np.empty((len(evidence), 2))
    scale = np.empty(len(evidence))
    for t in range(size[0]):
        rows = first[: np.searchsorted(-size, -t, side="left")] + t
        if t:
            p = forward[rows - 1]
            a = local[rows] * (p * keep + p[:, ::-1])
        else:
            a = local[rows]
        s = a.sum(axis=1)
        forward[rows], scale[rows] = a / s[:, None], s
    backward = np.ones((len(evidence), 2))
    equal = np.zeros(len(evidence))
    for t in range(size[0] - 2, -1, -1):
        rows = first[: np.searchsorted(-size, -(t + 1), side="left")] + t
        b = local[rows + 1] * backward[rows + 1] / scale[rows + 1][:, None]
        equal[rows] = (forward[rows] * b).sum(axis=1) * keep
        backward[rows] = b * keep + b[:, ::-1]
    good = (forward * backward)[:, 1]
    start = np.cumsum(per_text) - per_text
    log_z = np.add.reduceat(np.log(scale) + np.maximum(evidence, 0), start)
    return good, log_z, np.add.reduceat(equal, start)


def _weighted(good: np.ndarray, length: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    start = np.cumsum(per_text) - per_text
    weight = length + 1
    return np.add.reduceat(good * weight, start) / np.add.reduceat(weight, start)


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Model:
    """Maximum likelihood by Adam over all documents of the sample in batches, then the logistic curve."""
    if not texts:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(3 * N_FEATURES + 1), 0.0)
    features, length, per_text = line_features(texts)
    model = Model(features.mean(axis=0), features.std(axis=0) + 1e-3, np.zeros(3 * N_FEATURES + 1), 0.0)
    x = _inputs(model, features, per_text)
    y = np.asarray(labels, np.float64)
    start = np.cumsum(per_text) - per_text
    rng = np.random.default_rng(7)
    theta, m, v, k = np.zeros(x.shape[1] + 1), 0.0, 0.0, 0
    groups = np.array_split(np.argsort(per_text, kind="stable"), max(1, len(texts) // 128))
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            docs = groups[g]
            n = per_text[docs]
            own = np.repeat(start[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            good, _, equal = marginals(x[own] @ theta[:-1], theta[-1], n)
            # a document's label stands for all its lines; lines share a document's weight, so long ones don't rule
            share = np.repeat(1 / np.sqrt(n), n)
            slope = np.append(((np.repeat(y[docs], n) - good) * share) @ x[own], ((n - 1 - equal) / np.sqrt(n)).sum()) / len(docs) - SHRINK * theta
            k += 1
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            theta = theta + STEP * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            theta[-1] = min(theta[-1], 3.0)
    model.weight, model.stay = theta[:-1], float(theta[-1])
    odds = _log_odds(_weighted(marginals(x @ model.weight, model.stay, per_text)[0], length, per_text))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method with a little shrinkage
        p = 1 / (1 + np.exp(-(a * odds + b)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((y - p) * odds).sum() - a, (y - p).sum() - 0.1 * b])
        hess = np.array([[(w * odds * odds).sum() + 1, (w * odds).sum()], [(w * odds).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(hess, grad), -1, 1)
    model.slope, model.shift = float(a), float(b)
    return model


def score(model: Model, texts: list[str]) -> np.ndarray:
    features, length, per_text = line_features(texts)
    good, _, _ = marginals(_inputs(model, features, per_text) @ model.weight, model.stay, per_text)
    odds = _log_odds(_weighted(good, length, per_text))
    return 1 / (1 + np.exp(-(model.slope * odds + model.shift)))


def held_out():
    """Whether crc32 of the doc_id as text leaves 2 modulo 4; such rows are never learned from. Null ids: false."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """A model from at most ``sample`` labelled documents of at most ``chars`` code points, chosen by a hash of their
    ids. Rows without a label, text or id are left out; without any labelled row every score is one half."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where(F.length("text") <= chars).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(sample).select("text", "_quality").toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("_quality").to_pylist())


def with_quality(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """Adds ``into``, the score (0 to 1) of every whole text; null counts as empty, empty texts have a score too. Every
    other column is kept, a column of that name is replaced; rows are scored one by one, repeated ones alike."""
    docs = docs.drop(into)
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = score(sent.value, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*names, into])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, DoubleType())]))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD on) of every row of ``docs``."""
    scored = with_quality(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
