"""Toxicity scores: a bidirectional gated recurrent network with attention pooling over
character and word inputs, trained in numpy, run over all overlapping windows.

Inputs of a word: a learned embedding (words seen often enough), the mean of learned
embeddings of its character n-grams, and how strongly the word and its n-grams went with
label 1 in the training sample (log odds, shrunk; in training, a document's own counts are
taken out first, so that its rare words don't tell its label). A text is cut into windows
of ``WINDOW`` words, each ``STRIDE`` (half of it) on from the last, so that all of it is
read and each passage of up to ``STRIDE`` words lies whole in a window. Both directions of the network run over a window,
attention pools its states, and the document's logit is that of its worst window, mapped
to a probability by logistic calibration with the classes weighted as they occur.

Training uses at most ``most`` labelled ids of each class (the smallest hashes of id), as
many of them as have ``MOST_BYTES`` bytes of text together (a text too long for that is
left out alone, see ``labelled.within_bytes``), on the driver; scoring reads every window
of every document. Labels, ids, languages and sources never enter a score.

Defined results: null text counts as empty, one empty window, whose score is the
network's answer to no input; a very long text is read to its end, a batch of windows at a
time; equal texts have equal scores, and a score of just the threshold is predicted 1;
repeated rows are scored each, but an id counts once in training, with its smallest text
and largest label; an empty table gives no rows; with no usable label every score is 0,
with one class only, that class's label. Other columns are ignored (``keep`` returns them).
"""

from __future__ import annotations

import math
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokoro.llm.common import give_back, held_alone, id_and_text, map_arrow, shared_dir, written
from tokoro.llm.labelled import class_counts, held_out, one_text, sample, within_bytes

WINDOW, STRIDE, HIDDEN, EMBED, MOST = 32, 16, 8, 6, 1500
#: Characters at a word's ends that aren't part of it.
EDGE = " .,;:!?\"'()[]{}<>|#$%&*^~`-_=+/\\"
EPOCHS, STEPS, RATE, BATCH, SEED = 12, 240, 0.02, 256, 11
#: Length of character n-grams, and of beginnings (with the mark).
GRAM, BEGINNINGS = 4, (5, 6, 7)
WORD_ROWS, GRAM_ROWS = 3, 6  # documents that a word or n-gram must be in to get an embedding
MOST_BYTES = 8 << 20  # of training texts of each class


def clean(word: str) -> str:
    return word.lower().strip(EDGE)


def grams(word: str) -> list[str]:
    """Character n-grams, the word's start and end marked, and longer beginnings."""
    w = f"^{word}$"
    return [w[i : i + GRAM] for i in range(len(w) - GRAM + 1)] + [w[:n] for n in BEGINNINGS if n < len(w)]


class Inputs:
    """What is known of words and n-grams: rows of their embeddings and log odds, as they
    are (0) and as seen from a training document of label 0 (1) or 1 (2)."""

    def __init__(self, counts: dict, gram_counts: dict, totals: tuple[int, int]):
        def table(found: dict, least: int) -> tuple[dict, np.ndarray]:
            """Most frequent first, so that the first rows are those with an embedding."""
            keys = sorted((k for k, c in found.items() if sum(c) >= least), key=lambda k: (-sum(found[k]), k))
            c = np.array([(0, 0), *(found[k] for k in keys)], "f8")
            odds = np.zeros((3, len(c)))
            for view, less in enumerate(((0, 0), (1, 0), (0, 1))):
                zero, one = np.maximum(0, c[:, 0] - less[0]), np.maximum(0, c[:, 1] - less[1])
                odds[view] = np.log((one + 0.5) / (totals[1] - less[1] + 2)) - np.log((zero + 0.5) / (totals[0] - less[0] + 2))
                odds[view, zero + one < 2] = 0
            return {k: i + 1 for i, k in enumerate(keys)}, odds

        self.words, self.word_odds = table(counts, 2)
        self.grams, self.gram_odds = table(gram_counts, GRAM_ROWS)
        embedded = sum(sum(c) >= WORD_ROWS for c in counts.values())
        self.n_words, self.n_grams = embedded, len(self.grams)

    def parts(self, words: list[str], views: np.ndarray):
        """For each word its embedding's row and four odds; the n-grams' embedding rows of
        all, flat, with the word that each belongs to."""
        word = np.array([self.words.get(w, 0) for w in words], "i8")
        known, found, n = self.grams.get, array("i"), array("i")
        for w in words:
            own = list(filter(None, map(known, grams(w)))) or [0]
            found.extend(own)
            n.append(len(own))
        flat, n = np.frombuffer(found, "i4"), np.frombuffer(n, "i4")
        owner, starts = np.repeat(np.arange(len(words), dtype="i4"), n), np.r_[0, np.cumsum(n)[:-1]]
        odds = self.gram_odds[views[owner], flat]
        four = np.stack([self.word_odds[views, word], np.maximum.reduceat(odds, starts), np.minimum.reduceat(odds, starts), np.add.reduceat(odds, starts) / n], axis=1)
        return np.where(word <= self.n_words, word, 0), four, np.where(flat <= self.n_grams, flat, 0), owner, starts, n


def windows(n: int, size: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """Where the windows over n words begin: each reaches into the next, the last ends
    with the text."""
    return [0] if n <= size else [*range(0, n - size, stride), n - size]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name; d: inputs, h: hidden, each matrix holds both directions."""

    def __init__(self, d: int, n_words: int, n_grams: int, rng: np.random.Generator):
        h = HIDDEN
        self.p = {
            "word": np.zeros((n_words + 1, EMBED)),
            "gram": np.zeros((n_grams + 1, EMBED)),
            "in": rng.normal(size=(2, d, 3 * h)) / math.sqrt(d),
            "u": rng.normal(size=(2, h, 3 * h)) / math.sqrt(h),
            "bias": np.zeros((2, 1, 3 * h)),
            "attend": rng.normal(size=2 * h) / math.sqrt(2 * h),
            "out": rng.normal(size=2 * h) / math.sqrt(2 * h),
            "out_bias": np.zeros(1),
        }
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def step(self, grads: dict, rate: float) -> None:
        """Adam."""
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)


def run(x: np.ndarray, mask: np.ndarray, u: np.ndarray, attend: np.ndarray, keep: bool = False):
    """States and pooled vector. x: (2, windows, time, 3h) inputs of the gates, the second
    direction's time reversed; mask: (2, windows, time)."""
    two, b, time, h3 = x.shape
    h = h3 // 3
    state = np.zeros((two, b, h), x.dtype)
    states = np.empty((two, b, time, h), x.dtype)
    trace = []
    for t in range(time):
        a = state @ u
        gates = sigmoid(x[:, :, t, : 2 * h] + a[..., : 2 * h])
        z, r = gates[..., :h], gates[..., h:]
        new = np.tanh(x[:, :, t, 2 * h :] + r * a[..., 2 * h :])
        step = (new - state) * z
        step *= mask[:, :, t, None]
        if keep:
            trace.append((state, z, r, new, a[..., 2 * h :]))
        state = state + step
        states[:, :, t] = state
    joined = np.concatenate([states[0], states[1][:, ::-1]], axis=2)  # windows, time, 2h
    score = joined @ attend
    score = np.where(mask[0] > 0, score, -1e9)
    weight = np.exp(score - score.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    return joined, weight, np.einsum("bt,bth->bh", weight, joined), trace


def gradients(net: Network, vec: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Loss, gradients of the dense parameters and of the inputs (windows, time, d)."""
    p, h = net.p, HIDDEN
    both = np.stack([vec, vec[:, ::-1]])
    masks = np.stack([mask, mask[:, ::-1]])
    x = np.einsum("kbtd,kdh->kbth", both, p["in"]) + p["bias"][:, None]
    joined, att, pooled, trace = run(x, masks, p["u"], p["attend"], keep=True)
    logit = pooled @ p["out"] + p["out_bias"][0]
    prob = sigmoid(logit)
    loss = float(-(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum())
    dlogit = weight * (prob - y)
    g = {"out": pooled.T @ dlogit, "out_bias": np.array([dlogit.sum()])}
    dpooled = dlogit[:, None] * p["out"]
    datt = np.einsum("bh,bth->bt", dpooled, joined)
    dscore = att * (datt - (att * datt).sum(axis=1, keepdims=True))
    djoined = att[:, :, None] * dpooled[:, None, :] + dscore[:, :, None] * p["attend"]
    g["attend"] = np.einsum("bt,bth->h", dscore, joined)
    dstates = np.stack([djoined[..., :h], djoined[:, ::-1, h:]])
    dx = np.zeros_like(x)
    du = np.zeros_like(p["u"])
    carry = np.zeros((2, len(y), h))
    for t in range(vec.shape[1] - 1, -1, -1):
        state, z, r, new, an = trace[t]
        total = dstates[:, :, t] + carry
        live = total * masks[:, :, t, None]
        dz = live * (new - state) * z * (1 - z)
        dn = live * z * (1 - new * new)
        dr = dn * an * r * (1 - r)
        da = np.concatenate([dz, dr, dn * r], axis=2)
        dx[:, :, t] = np.concatenate([dz, dr, dn], axis=2)
        du += np.einsum("kbh,kbg->khg", state, da)
        carry = total - live * z + da @ p["u"].transpose(0, 2, 1)
    g["u"], g["bias"] = du, dx.sum(axis=(1, 2))[:, None]
    g["in"] = np.einsum("kbtd,kbth->kdh", both, dx)
    dboth = np.einsum("kbth,kdh->kbtd", dx, p["in"])
    return loss, g, dboth[0] + dboth[1][:, ::-1]


class Model:
    def __init__(self, inputs: Inputs | None, net: Network | None, scale: tuple[float, float], constant: float | None = None):
        self.inputs, self.scale, self.constant, self.name = inputs, scale, constant, uuid.uuid4().hex
        if net is not None:
            p = net.p
            self.word, self.gram = p["word"].astype("f4"), p["gram"].astype("f4")
            self.project = np.concatenate([p["in"][0], p["in"][1]], axis=1).astype("f4")  # d x 6h
            self.bias = p["bias"].reshape(-1).astype("f4")
            self.u, self.attend = p["u"].astype("f4"), p["attend"].astype("f4")
            self.out, self.out_bias = p["out"].astype("f4"), float(p["out_bias"][0])

    def vectors(self, words: list[str]) -> np.ndarray:
        """The gates' inputs of some words."""
        word, odds, flat, _, starts, n = self.inputs.parts(words, np.zeros(len(words), "i8"))
        mean = np.add.reduceat(self.gram[flat], starts, axis=0) / n[:, None]
        return np.concatenate([odds, self.word[word], mean], axis=1).astype("f4") @ self.project + self.bias


class Scorer:
    """A worker's network with the projected inputs of the words it has met.

    What stands between white space is looked up as it is, lower-cased: ``row`` gives the
    table's row of its word. All is dropped beyond ``KEEP`` words, ``KEYS`` keys or
    ``KEEP_BYTES`` characters of keys."""

    KEEP, KEYS, KEEP_BYTES, ROWS = 300_000, 600_000, 48 << 20, 360_000

    def __init__(self, model: Model):
        self.model = model
        self.table = np.zeros((self.ROWS, 6 * HIDDEN), "f4")
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {"": 0}  # marks alone are no word
        self.filled, self.held = 1, 0
        self.table = self.table[: self.ROWS]

    def _rows(self, texts: list[str]) -> list[np.ndarray]:
        """The table's rows of each text's words; those of new words are filled."""
        own = [t.lower().split() for t in texts]
        row, new, first = self.row, [], self.filled
        for piece in set().union(*own).difference(row):
            word = piece.strip(EDGE)
            k = row.get(word)
            if k is None:
                k = row[word] = first + len(new)
                new.append(word)
            row[piece] = k
            self.held += len(piece)
        self.filled += len(new)
        while self.filled > len(self.table):  # only where one batch alone has so many words
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            self.table[first + at : first + at + len(part)] = self.model.vectors(part)
        return [np.fromiter(map(row.__getitem__, words), "i8", len(words)) for words in own]

    def logits(self, texts: list[str]) -> np.ndarray:
        """The worst window's logit of each text."""
        if self.filled > self.KEEP or len(self.row) > self.KEYS or self.held > self.KEEP_BYTES:
            self.forget()
        best = np.full(len(texts), -np.inf)
        pending, owners = [], []
        for k, ids in enumerate(self._rows(texts)):
            for at in windows(len(ids)):
                pending.append(ids[at : at + WINDOW])
                owners.append(k)
                if len(pending) == 2048:
                    np.maximum.at(best, owners, self._windows(pending))
                    pending, owners = [], []
        if pending:
            np.maximum.at(best, owners, self._windows(pending))
        return best

    def _windows(self, ids: list[np.ndarray]) -> np.ndarray:
        longest = max(1, max(map(len, ids)))
        index = np.zeros((len(ids), longest), "i8")
        for i, own in enumerate(ids):
            index[i, : len(own)] = own
        mask = (index > 0).astype("f4")
        m = self.model
        both = np.stack([self.table[index, : 3 * HIDDEN], self.table[index[:, ::-1], 3 * HIDDEN :]])
        _, _, pooled, _ = run(both, np.stack([mask, mask[:, ::-1]]), m.u, m.attend)
        return pooled.astype("f8") @ m.out + m.out_bias

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        a, b = self.model.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(texts) + b, -30, 30)))


def train(rows: list[tuple[str, int]], classes: tuple[int, int]) -> Model:
    """rows: (text, label); classes: labelled rows of either label in the whole table."""
    labels = {y for _, y in rows}
    if len(labels) < 2:
        return Model(None, None, (1, 0), float(labels.pop()) if labels else 0.0)
    rng = np.random.default_rng(SEED)
    once: dict[str, str] = {}  # equal words are one object
    docs = [([once.setdefault(w, w) for w in map(clean, t.split())], y) for t, y in rows]
    del once
    docs.append(([], 0))  # no words: no sign of toxicity
    counts: dict[str, tuple[int, int]] = {}
    gram_counts: dict[str, tuple[int, int]] = {}
    pairs: dict[tuple[int, int], tuple[int, int]] = {}  # one object for each pair of counts
    for own, y in docs:
        distinct = set(own)
        seen = {g for w in distinct for g in grams(w)}
        for which, keys in ((counts, distinct), (gram_counts, seen)):
            for k in keys:
                zero, one = which.get(k, (0, 0))
                pair = (zero + 1, one) if y == 0 else (zero, one + 1)
                which[k] = pairs.setdefault(pair, pair)
    inputs = Inputs(counts, gram_counts, (sum(y == 0 for _, y in docs), sum(y == 1 for _, y in docs)))
    net = Network(4 + 2 * EMBED, inputs.n_words, inputs.n_grams, rng)
    net.p["word"][1:] = 0.1 * rng.normal(size=net.p["word"][1:].shape)
    net.p["gram"][1:] = 0.1 * rng.normal(size=net.p["gram"][1:].shape)

    # Parts of each (word, label) once; row 0 is no word.
    key: dict[tuple[str, int], int] = {("", 0): 0}
    for own, y in docs:
        for w in own:
            key.setdefault((w, y) if w else ("", 0), len(key))
    word_row, odds, flat, _, starts, gram_n = inputs.parts([w for w, _ in key], np.array([y + 1 for _, y in key], "i8"))
    word_row[0], odds[0] = 0, 0
    docs = [(np.array([key[w, y] if w else 0 for w in own], "i4"), y) for own, y in docs]
    parts = [[own[at : at + WINDOW] for at in windows(len(own))] for own, _ in docs]
    y_of = np.array([y for _, y in docs], "f8")

    del counts, gram_counts

    def grams_of(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of some rows of (word, label), flat, and where each row's begin."""
        n = gram_n[of]
        first = np.cumsum(n) - n
        return flat[np.arange(n.sum()) + np.repeat(starts[of] - first, n)], first

    def vectors(of: np.ndarray) -> np.ndarray:
        """Of some rows of (word, label)."""
        rows, first = grams_of(of)
        mean = np.add.reduceat(net.p["gram"][rows], first, axis=0) / gram_n[of][:, None]
        return np.concatenate([odds[of], net.p["word"][word_row[of]], mean], axis=1)

    def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(rows, values[:, j], n) for j in range(values.shape[1])], axis=1)

    def padded(chosen: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(chosen), WINDOW), "i4")
        for i, own in enumerate(chosen):
            out[i, : len(own)] = own
        return out

    everything = [(k, w) for k, own in enumerate(parts) for w in own]
    owner, table = np.array([k for k, _ in everything]), padded([w for _, w in everything])

    def all_logits() -> np.ndarray:
        out = []
        project, bias = net.p["in"], net.p["bias"]
        by = np.empty((2, len(key), 3 * HIDDEN), "f4")
        for at in range(0, len(key), 2048):
            x = vectors(np.arange(at, min(len(key), at + 2048)))
            for k in (0, 1):
                by[k, at : at + 2048] = x @ project[k] + bias[k]
        u, attend = net.p["u"].astype("f4"), net.p["attend"].astype("f4")
        for at in range(0, len(table), 1024):
            index = table[at : at + 1024]
            mask = (index > 0).astype("f4")
            _, _, pooled, _ = run(np.stack([by[0][index], by[1][index[:, ::-1]]]), np.stack([mask, mask[:, ::-1]]), u, attend)
            out.append(pooled @ net.p["out"] + net.p["out_bias"][0])
        return np.concatenate(out)

    logits = odds[table, 0].clip(0).max(axis=1) + odds[table, 1].clip(0).max(axis=1)
    epochs = max(EPOCHS, STEPS * BATCH // (2 * len(docs)))
    for epoch in range(epochs):
        if epoch and epoch % (epochs // EPOCHS) == 0:
            logits = all_logits()
        order = np.lexsort((-logits, owner))
        first = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]  # the worst window of each document
        negative = np.flatnonzero(y_of[owner] == 0)
        extra = rng.choice(negative, min(len(negative), len(first) // 2), replace=False)
        chosen = rng.permutation(np.concatenate([first, extra]))
        for at in range(0, len(chosen), BATCH):
            own = chosen[at : at + BATCH]
            index = table[own]
            y = y_of[owner[own]]
            # some label-1 rows show no sign of it: soft targets keep them from ruling
            target = np.where(y == 1, 0.97, 0.01)
            mask = (index > 0).astype("f8")
            used, at_used = np.unique(index, return_inverse=True)
            at_used = at_used.reshape(index.shape)
            _, g, dvec = gradients(net, vectors(used)[at_used], mask, target, np.full(len(own), 1 / len(own)))
            of_key = summed(at_used.ravel(), (dvec * mask[..., None])[..., 4:].reshape(-1, 2 * EMBED), len(used))
            g["word"] = summed(word_row[used], of_key[:, :EMBED], len(net.p["word"]))
            g["gram"] = summed(grams_of(used)[0], np.repeat(of_key[:, EMBED:] / gram_n[used][:, None], gram_n[used], axis=0), len(net.p["gram"]))
            g["word"][0] = g["gram"][0] = 0
            for k in ("word", "gram"):
                g[k] += 1e-4 * net.p[k]
            net.step(g, RATE * (1 - epoch / epochs) + 0.001)
    logits = all_logits()
    worst = np.full(len(docs), -np.inf)
    np.maximum.at(worst, owner, logits)
    # Logistic calibration with each class at its weight in the whole table.
    have = np.array([(y_of == 0).sum(), (y_of == 1).sum()])
    weight = (np.maximum(1, np.array(classes)) / have)[y_of.astype(int)]
    weight /= weight.sum()
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * worst + b, -30, 30)))
        d, c = weight * (q - y_of), weight * q * (1 - q) + 1e-9
        grad = np.array([(d * worst).sum() + 1e-4 * (a - 1), d.sum()])
        hess = np.array([[(c * worst * worst).sum() + 1e-4, (c * worst).sum()], [(c * worst).sum(), c.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        move *= min(1, 1 / max(1e-12, np.abs(move).max()))
        a, b = a - move[0], b - move[1]
    return Model(inputs, net, (max(a, 1e-3), b))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST) -> Model:
    """Train on at most ``most`` ids and ``MOST_BYTES`` bytes of texts of each class,
    gathered on the driver by that bound."""
    sampled = written(one_text(sample(docs, labels, label, most)), f"{shared_dir(docs.sparkSession)}/sample")
    rows = within_bytes(sampled, MOST_BYTES).select("doc_id", "text", "label").collect()
    ordered = sorted((r["doc_id"], r["text"], r["label"]) for r in rows)
    model = train([(t, y) for _, t, y in ordered], class_counts(labels, label))
    del rows, ordered
    give_back()
    return model


def worker_scorer(name: str, model) -> Scorer:
    """The worker's scorer of a broadcast model."""
    return held_alone(name, lambda: Scorer(model.value))


def score_documents(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, labels, "toxic", most)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), model.name

    def score(batches):
        scorer = worker_scorer(name, shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch.column(1).to_pylist()))], ["doc_id", "score"])

    scored = map_arrow(id_and_text(docs), score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = fit(docs, labels, "toxic", most)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), model.name

    at = docs.columns.index("text")

    def run(batches):
        scorer = worker_scorer(name, shared)
        for batch in batches:
            scores = scorer.scores([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores < threshold))

    return map_arrow(docs, run, docs.schema)
