"""Quality classifier: random Fourier features of document statistics, ridge regression and isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics of the text. Each partition sums its part of the
normal equations; their rows are added up by row number and solved on the driver, whose size is that of the features.
Four fifths of the training rows fit the ridge, the rest its calibration: their counts by score bin are pooled until
they ascend.

Training uses every labelled row; a null label or doc_id doesn't train. Null and empty texts have all statistics 0 and get
a score like others. Documents labelled twice count twice. Without any training rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnworks.llm.features import joined, small_batches, sums, text_slices
from tarnworks.llm.ngram_join import _BACK, _BYTE, _SPACE, _STEP, _powers, mix

SLICE_CHARS = 1_000_000
FEATURES = 192
#: Of the Gaussian kernel exp(-GAMMA * squared distance), for standardised statistics.
GAMMA = 0.05
RIDGE = 1e-3
BINS = 1000


def _flags(*chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    for group in chars:
        out[np.frombuffer(group.encode("latin-1"), np.uint8)] = True
    return out


_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _flags("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _flags("0123456789")
_PLAIN = _flags(".,;:?'\"()-")
_OTHER = ~(_UPPER | _LOWER | _DIGIT | _PLAIN | _SPACE) & (np.arange(256) < 128)
STATISTICS = 15


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS numbers per text, from its whole."""
    data, ends = joined(texts)
    if not len(texts):
        return np.zeros((0, STATISTICS))
    size = np.maximum(np.diff(np.concatenate([[0], ends])) - 1, 0)
    n = np.maximum(size, 1)
    shares = [sums(flag[data], ends) / n for flag in (_UPPER, _LOWER, _DIGIT, _PLAIN, _OTHER)]
    lines = sums(data == 10, ends) - 1
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = edge if space[0] else np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    upto = np.searchsorted(start, ends)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), out=total[1:])
    word = mix((total[end] - total[start]) * _powers(_BACK, len(data))[start])
    count = np.diff(np.concatenate([[0], upto]))
    m = np.maximum(count, 1)
    length = (end - start).astype(np.float64)
    again = np.concatenate([[False], word[1:] == word[:-1]])
    odd_end = _OTHER[data[end - 1]]
    capital = _UPPER[data[start]]
    shout = _UPPER[data[end - 1]] & capital if len(end) else capital
    distinct = np.array([len(np.unique(word[a:b])) for a, b in zip(np.concatenate([[0], upto[:-1]]).tolist(), upto.tolist(), strict=True)], np.float64)
    mean = sums(length, upto) / m
    spread = np.sqrt(np.maximum(sums(length**2, upto) / m - mean**2, 0))
    return np.column_stack([np.log1p(size), *shares, np.log1p(lines * 1000 / n), mean, spread, sums(again, upto) / m, sums(odd_end, upto) / m, sums(capital, upto) / m, sums(shout, upto) / m, distinct / m, np.log1p(distinct)])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: Ascending raw scores and the calibrated ones there.
    knots: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.values)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features, with a constant; the same draw each time."""
    rng = np.random.default_rng(7)
    w = rng.normal(0, np.sqrt(2 * GAMMA), (STATISTICS, FEATURES))
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(np.clip(x, -8, 8) @ w + shift), np.ones(len(x))])


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 3; 1 is held out."""
    return F.crc32(doc_id.cast("string")) % 3


def isotonic(x: np.ndarray, positives: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending x and the best non-descending shares of positives, by pooling neighbours that descend."""
    pools: list[list[float]] = []
    for at, p, w in zip(x.tolist(), positives.tolist(), weight.tolist(), strict=True):
        pools.append([at, at, p, w])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, hi, p, w = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + p, pools[-1][3] + w]
    return np.array([y for a, b, _, _ in pools for y in (a, b)]), np.array([p / w for _, _, p, w in pools for _ in range(2)])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    small_batches(docs)
    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text", SLICE_CHARS):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in statistics(texts)], pa.binary())], names=["id", "stats"])

    wanted = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("double").alias("y")).dropna().where(fold(F.col("id")) != 1)
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (fold(F.col("id")) != 1))
    rows = given.mapInArrow(stats, "id long, stats binary").join(wanted, "id").select("stats", "y", (F.crc32(F.concat(F.lit("part"), F.col("id").cast("string"))) % 5 == 0).alias("calibrates"))
    from tarnworks.session import stash, unstash

    rows = stash(rows, "quality")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((3, STATISTICS))
        for b in batches:
            x = np.frombuffer(b"".join(b.column("stats").to_pylist())).reshape(-1, STATISTICS)
            out += [np.full(STATISTICS, len(x)), x.sum(0), (x**2).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(range(STATISTICS)), *map(pa.array, out)], names=["i", "n", "s", "q"])

    got = rows.select("stats").mapInArrow(moments, "i long, n double, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").collect()
    n = got[0]["n"] if got else 0
    if not n:
        return QualityModel(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    mean = np.array([r["s"] for r in got]) / n
    scale = np.sqrt(np.maximum(np.array([r["q"] for r in got]) / n - mean**2, 1e-12))
    scale[scale < 1e-5] = 1
    wide = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((wide, wide + 1))
        for b in batches:
            z = fourier((np.frombuffer(b"".join(b.column("stats").to_pylist())).reshape(-1, STATISTICS) - mean) / scale)
            out += z.T @ np.column_stack([z, b.column("y").to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_arrays([pa.array(range(wide)), pa.array([r.tobytes() for r in out], pa.binary())], names=["i", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for i, part in zip(b.column("i").to_pylist(), b.column("part").to_pylist(), strict=True):
                out[i] = out.get(i, 0) + np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["i", "part"])

    row = "i long, part binary"
    normal = {r["i"]: np.frombuffer(r["part"]) for r in rows.where("NOT calibrates").mapInArrow(equations, row).repartition("i").mapInArrow(added, row).collect()}
    a = np.array([normal.get(i, np.zeros(wide + 1)) for i in range(wide)])
    count = max(a[-1, wide - 1], 1)
    weights = np.linalg.solve(a[:, :wide] / count + RIDGE * np.eye(wide), a[:, wide] / count)
    model = QualityModel(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("stats").to_pylist())).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(model.raw(x), -1, 2) * BINS).astype(np.int64)), b.column("y")], names=["cell", "y"])

    cells = rows.where("calibrates").select("stats", "y").mapInArrow(scored, "cell long, y double").groupBy("cell").agg(F.sum("y").alias("p"), F.count("*").alias("n")).orderBy("cell").collect()
    if cells:
        model.knots, model.values = isotonic((np.array([r["cell"] for r in cells]) + 0.5) / BINS, np.array([r["p"] for r in cells]), np.array([r["n"] for r in cells], float))
    unstash(rows)
    return model


def score(docs: DataFrame, model: QualityModel, text: str = "text", name: str = "quality_score", drop_text: bool = False) -> DataFrame:
    """docs with the model's score of each whole text, from 0 to 1."""
    small_batches(docs)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name])
    out = [c for c in kept.columns if not (drop_text and c == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text, SLICE_CHARS):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], pa.array(model.score(statistics(texts)), pa.float64())], names=[*out, name])

    return kept.mapInArrow(run, kept.select(*[F.col(f"`{c}`") for c in out]).schema.add(name, "double"))
