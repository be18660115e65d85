"""Quality scores: random Fourier features over document statistics, ridge regression by
partition-summed normal equations, isotonic calibration.

Statistics of the whole text (byte classes, word lengths, repetition of words and lines,
compressibility) are standardised and sent through ``FEATURES`` random cosines, whose
inner products approximate a Gaussian kernel. Each partition of the training sample sums
its own outer products, for each of two folds; the driver adds these fixed-size matrices
and solves for ridge weights. Each fold's raw scores under the other fold's weights give
the isotonic map from raw score to the share of label 1.

Training rows are bounded by ``most`` of each class (the ids with the smallest hash).
Where that cuts the classes by different rates, each row weighs as many as it stands for,
in the standardising, the ridge sums and the isotonic means, so that scores are shares of
the label table at any size of it;
scores cover every document. Labels never enter a score, nor do ids, languages or sources.

Defined results: null text counts as empty and gets the score of its statistics (all
zero); a very long text is measured whole, in one pass over its bytes; equal texts have
equal scores, and a score of just the threshold is predicted 1; repeated rows are scored
each, but an id counts once in training, with its smallest statistics and largest label; an
empty table gives no rows; with no usable label every score is 0.5; with one class only,
that class's label. Other columns are ignored (``keep`` returns them).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokoro.llm.common import id_and_text, let_go, map_arrow, shared_dir, written
from tokoro.llm.labelled import class_weights, held_out, sample

FEATURES, RIDGE, MOST, SEED = 256, 1.0, 10_000, 7
THRESHOLD = 0.3
GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"#$%&*@^~", b"<>{}[]()/\\=+_", b"\"':;-`")
N_STATS = len(GROUPS) + 12


def _group_matrix() -> np.ndarray:
    out = np.zeros((256, len(GROUPS) + 1), "f8")
    for i, group in enumerate(GROUPS):
        out[list(group), i] = 1
    out[128:, -1] = 1
    return out


_OF_BYTE = _group_matrix()


def statistics(text: bytes) -> np.ndarray:
    """What the model sees of a text; all zero for an empty one."""
    out = np.zeros(N_STATS)
    if not text:
        return out
    n = len(text)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[: len(GROUPS) + 1] = histogram @ _OF_BYTE / n
    share = histogram[histogram > 0] / n
    words, lines = text.split(), text.split(b"\n")
    counts = Counter(words)
    m = max(1, len(words))
    at = len(GROUPS) + 1
    common = counts.most_common(3)
    out[at:] = (
        -(share * np.log(share)).sum(),
        math.log1p(m),
        n / m,
        len(counts) / m,
        len(counts) / math.sqrt(m),
        common[0][1] / m if common else 0,
        sum(c for _, c in common) / m,
        len(set(lines)) / len(lines),
        len(lines) / m,
        len(zlib.compress(text, 1)) / n,
        sum(map(len, counts)) / max(1, len(counts)),
    )
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray  # frequencies, statistics x features
    b: np.ndarray  # phases
    weights: np.ndarray
    knots: np.ndarray  # raw scores, ascending
    values: np.ndarray  # calibrated scores at the knots

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        raw = features((stats - self.mean) / self.scale, self.w, self.b) @ self.weights
        return np.interp(raw, self.knots, self.values)


def features(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Random cosines, with a constant last."""
    z = np.cos(np.clip(x, -6, 6) @ w + b) * math.sqrt(2 / w.shape[1])
    return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: means of y that don't fall with x, at the blocks' middles."""
    order = np.argsort(x, kind="stable")
    weight = np.ones(len(x)) if weight is None else weight
    blocks: list[list[float]] = []
    for v, t, n in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([t, n, v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0] or len(blocks) > 1 and blocks[-2][3] == blocks[-1][2]:
            mean, n, _, last = blocks.pop()
            own = blocks[-1]
            blocks[-1] = [(own[0] * own[1] + mean * n) / (own[1] + n), own[1] + n, own[2], last]
    return np.array([(b[2] + b[3]) / 2 for b in blocks]), np.array([b[0] for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST) -> Model:
    def measure(batches):
        for batch in batches:
            rows = [statistics(t).tolist() for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), *batch.columns[1:]], ["stats", "doc_id", "label", "fold"])

    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(N_STATS, FEATURES)) / math.sqrt(N_STATS)
    b = rng.uniform(0, 2 * math.pi, FEATURES)
    rows = map_arrow(sample(docs, labels, label, most).select("text", "doc_id", "label", "fold"), measure, "stats array<double>, doc_id long, label int, fold int")
    # At most 2 * most ids; of rows that share one, those of the smallest statistics.
    rows = rows.groupBy("doc_id", "label", "fold").agg(F.min("stats").alias("stats")).select("stats", "label", "fold")
    rows = written(rows, shared_dir(docs.sparkSession))
    found = rows.select(F.posexplode("stats"), "label").groupBy("pos", "label").agg(F.avg("col").alias("m"), F.var_pop("col").alias("v"), F.count("*").alias("n")).collect()
    if not found:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), w, b, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    size, center, spread = np.zeros(2), np.zeros((2, N_STATS)), np.zeros((2, N_STATS))
    for r in found:
        k = r["label"]
        size[k], center[k, r["pos"]], spread[k, r["pos"]] = r["n"], r["m"], r["v"]
    weight = np.array(class_weights(labels, label, most))
    weight *= size.sum() / (size * weight).sum()  # 1 on average: the ridge is set against the rows there are
    share = (size * weight / size.sum())[:, None]
    mean = (share * center).sum(axis=0)
    scale = np.sqrt((share * (spread + (center - mean) ** 2)).sum(axis=0))
    scale[scale <= 1e-9] = 1.0
    if not size.all():
        return Model(mean, scale, w, b, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, float(size[1] > 0)))

    def sums(batches):
        gram = np.zeros((2, FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist())
                z = features((x - mean) / scale, w, b)
                y = batch.column(1).to_numpy()
                fold = batch.column(2).to_numpy()
                for k in (0, 1):
                    gram[k] += (z * weight[y][:, None])[fold == k].T @ np.column_stack([z, y])[fold == k]
        yield pa.RecordBatch.from_pydict({"gram": pa.array([gram.tobytes()], pa.binary())})

    parts = rows.mapInArrow(sums, "gram binary").collect()  # a matrix of a fixed size for each of the few partitions of so small a table
    gram = sum(np.frombuffer(bytes(r[0])).reshape(2, FEATURES + 1, FEATURES + 2) for r in parts)
    known = rows.collect()
    eye = RIDGE * np.eye(FEATURES + 1)
    eye[-1, -1] = 1e-6
    solve = lambda g: np.linalg.solve(g[:, :-1] + eye, g[:, -1])
    other, weights = [solve(gram[1]), solve(gram[0])], solve(gram[0] + gram[1])
    z = features((np.array([r["stats"] for r in known]) - mean) / scale, w, b)
    fold, y = np.array([r["fold"] for r in known]), np.array([r["label"] for r in known], "f8")
    raw = np.where(fold == 0, z @ other[0], z @ other[1])
    knots, values = isotonic(raw, y, weight[y.astype(int)])
    return Model(mean, scale, w, b, weights, knots, np.clip(values, 0, 1))


def score_documents(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, labels, "quality", most)

    def run(batches):
        for batch in batches:
            stats = [statistics(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(np.array(stats).reshape(-1, N_STATS)), pa.float64())], ["doc_id", "score"])

    scored = map_arrow(id_and_text(docs), run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    model = fit(docs, labels, "quality", most)
    at = docs.columns.index("text")

    def run(batches):
        let_go()
        for batch in batches:
            stats = [statistics(t or b"") for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(model.score(np.array(stats).reshape(-1, N_STATS)) >= threshold))

    return map_arrow(docs, run, docs.schema)
