"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text are hashed to DIMS columns. Document frequencies cover all
training documents. Weights are fitted by follow-the-regularised-leader with an elastic net on a bounded sample of
them: at most TRAIN_ROWS documents, those of least hash. A fifth of the sample sets the temperature of the scores.

Null texts and texts without a letter are `und` with score 0. Rows with a null language or doc_id don't train. Without any
training rows every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnworks.llm.features import small_batches, text_slices
from tarnworks.llm.quality import fold

SLICE_CHARS = 1_000_000
DIMS = 1 << 14
ORDERS = 3
TRAIN_ROWS = 3000
#: FTRL-proximal: learning rate, its smoothing, and the elastic net's two penalties.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-4, 1e-4, 3
BLOCK = 1024


def counts(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, matrix of n-gram counts) for runs of a few texts."""
    step = 32
    for first in range(0, len(texts), step):
        part = [t.lower() for t in texts[first : first + step]]
        size = np.fromiter(map(len, part), np.int64, len(part))
        chars = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(part), dtype=np.int64) * DIMS, size)
        total = np.zeros(len(part) * DIMS)
        h = np.zeros(len(chars), np.uint32)
        for n in range(1, ORDERS + 1):
            m = len(chars) - n + 1
            if m <= 0:
                break
            h = (h[:m] * np.uint32(0x01000193)) ^ chars[n - 1 :][:m]
            cell = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMS.bit_length() + 1)
            inside = doc[:m] == doc[n - 1 :][:m]
            total += np.bincount((doc[:m] + cell)[inside], minlength=len(total))
        yield first, total.reshape(len(part), DIMS)


@dataclass
class LanguageModel:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, best = [], np.zeros(len(texts))
        for first, c in counts(texts):
            p = softmax(weighted(c, self.idf) @ self.weights / self.temperature) if self.names else np.zeros((len(c), 1))
            top = p.argmax(1)
            for i in range(len(c)):
                letter = bool(self.names) and any(map(str.isalpha, texts[first + i]))
                names.append(self.names[top[i]] if letter else "und")
                best[first + i] = p[i, top[i]] if letter else 0.0
        return names, best


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1: square roots of counts by inverse document frequency."""
    x = np.sqrt(c) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights of a multinomial logistic regression on sparse rows (columns, values, class)."""
    z, n = np.zeros((DIMS, classes)), np.zeros((DIMS, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, y in rows:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax((x @ w)[None])[0]
            p[y] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at], n[at] = zi + g - sigma * w, ni + g * g
    return weights(z, n)


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMS, np.int64), 0
        for _, got in text_slices(batches, "text", SLICE_CHARS):
            for _, c in counts(got):
                seen += (c > 0).sum(0)
            n += len(got)
        blocks = seen.reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(blocks))], pa.int64()), pa.array([np.array([n], np.int64).tobytes(), *[b.tobytes() for b in blocks]], pa.binary())], names=["block", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column("block").to_pylist(), b.column("part").to_pylist(), strict=True):
                out[i] = out.get(i, 0) + np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["block", "part"])

    row = "block long, part binary"
    got = {r["block"]: np.frombuffer(r["part"], np.int64) for r in texts.mapInArrow(part, row).repartition("block").mapInArrow(added, row).collect()}
    if -1 not in got:
        return np.zeros(DIMS), 0
    return np.concatenate([got[i] for i in range(DIMS // BLOCK)]), int(got[-1][0])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    small_batches(docs)
    train = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("id")) != 1))
    seen, rows = _document_frequencies(train.select("text"))
    if not rows:
        return LanguageModel([], np.ones(DIMS), np.zeros((DIMS, 1)))
    idf = np.log((1 + rows) / (1 + seen)) + 0.05

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text", SLICE_CHARS):
            at, values = [], []
            for _, c in counts(texts):
                for row in weighted(c, idf):
                    at.append(np.flatnonzero(row).astype(np.uint16).tobytes())
                    values.append(row[row != 0].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["h", "lang", "at", "x"])

    # a cut that leaves somewhat more than the sample, so that few rows are ordered
    h = F.xxhash64("id", "text")
    share = min(1.0, 1.2 * TRAIN_ROWS / rows + 0.0005)
    some = train.withColumn("h", h).where(F.col("h") < F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    sample = some.select("h", "lang", "text").mapInArrow(sparse, "h long, lang string, at binary, x binary").orderBy("h").limit(TRAIN_ROWS).collect()
    names = sorted({r["lang"] for r in sample})
    number = {n: i for i, n in enumerate(names)}
    got = [(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(float), number[r["lang"]]) for r in sample]
    tune, learn = got[::5], [r for i, r in enumerate(got) if i % 5]
    model = LanguageModel(names, idf, ftrl(learn or got, len(names)))
    logits = np.array([x @ model.weights[at] for at, x, _ in tune])
    truth = np.array([y for _, _, y in tune])
    loss = {t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.exp(np.linspace(-3, 2, 101))}
    model.temperature = float(min(loss, key=loss.get))
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "lang_score"), drop_text: bool = False) -> DataFrame:
    """docs with the predicted language of each whole text and its score."""
    small_batches(docs)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    out = [c for c in kept.columns if not (drop_text and c == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text, SLICE_CHARS):
            found, best = model.predict(texts)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], pa.array(found, pa.string()), pa.array(best, pa.float64())], names=[*out, *names])

    return kept.mapInArrow(run, kept.select(*[F.col(f"`{c}`") for c in out]).schema.add(names[0], "string").add(names[1], "double"))
