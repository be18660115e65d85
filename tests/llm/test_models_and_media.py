"""Operators 5, 6 and 7, and the pipeline's stages."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import EDGE, prose

from tokoro.llm import labelled as labelled_, progressive_jpeg as pj, quality, toxicity
from tokoro.llm.common import shared_dir


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark, make):
    r, rows, labels = random.Random(5), [], []
    for i in range(1000, 1360):
        words, bad, toxic = prose(i, r.randint(20, 90)).split(), i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["vilewort", "grubface", "snarlgut"]) + r.choice(["", "s", "er"])
        rows.append((i, " ".join(w + "###" if bad else w for w in words)))
        labels.append((i, int(not bad), int(toxic), 1.0))
    labels += [(1000, None, None, 1.0), (None, 1, 1, 1.0), (77, 1, 0, 1.0)]
    return make(rows + EDGE), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text double")


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(labelled, module, column):
    docs, labels = labelled
    rows = module.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    truth = {r["doc_id"]: r[column] for r in labels.collect() if r[column] is not None}
    test = [r for r in rows if r["held_out"] and r["doc_id"] in truth and r["doc_id"] >= 1000]
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in test]) > 0.9
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1  # null is empty


@pytest.mark.parametrize("module", [quality, toxicity])
def test_degenerate_labels(spark, make, module):
    docs = make(EDGE)
    for rows in ([], [(4, 1, 1), (6, 1, 1), (7, 1, 1), (8, 1, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert module.score_documents(docs, labels).count() == len(EDGE)
        assert module.keep(docs, labels).columns == docs.columns
    assert module.score_documents(make([]), labels).count() == 0


def test_toxicity_learns_from_1500_rows_a_class():
    import inspect

    assert {inspect.signature(f).parameters["most"].default for f in (toxicity.fit, toxicity.score_documents, toxicity.keep)} == {1500}


def test_windows_cover_every_word():
    for n in (0, 1, 32, 33, 57, 100, 1000):
        starts = toxicity.windows(n)
        assert set(range(n)) <= {i for a in starts for i in range(a, a + toxicity.WINDOW)} and starts[-1] + toxicity.WINDOW >= n


def test_windows_hold_passages_of_half_a_window_whole():
    size, half = toxicity.WINDOW, toxicity.WINDOW // 2
    for n in (33, 57, 100, 1000):
        starts = toxicity.windows(n)
        assert all(any(a <= p and p + half <= a + size for a in starts) for p in range(n - half + 1))


def test_gradients():
    rng = np.random.default_rng(0)
    net, vec, mask = toxicity.Network(5, 3, 3, rng), rng.normal(size=(4, 6, 5)), np.ones((4, 6))
    mask[1, 3:] = mask[2] = 0
    y, w = np.array([0, 1, 1, 0.0]), np.full(4, 0.25)
    _, g, _ = toxicity.gradients(net, vec, mask, y, w)
    for k in ("in", "u", "bias", "attend", "out", "out_bias"):
        at = tuple(rng.integers(0, s) for s in net.p[k].shape)
        ends = []
        for step in (1e-5, -2e-5):
            net.p[k][at] += step
            ends.append(toxicity.gradients(net, vec, mask, y, w)[0])
        net.p[k][at] += 1e-5
        assert math.isclose((ends[0] - ends[1]) / 2e-5, g[k][at], rel_tol=1e-4, abs_tol=1e-8)


def test_training_sees_all_grams_of_a_long_word(monkeypatch):
    word, own, seen = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=60)), toxicity.gradients, []
    assert len(set(toxicity.grams(word))) == len(toxicity.grams(word)) > 24

    def gradients(net, vec, mask, y, weight):
        got = vec[mask > 0][:, 4 + toxicity.EMBED :]
        seen.append(np.allclose(got, net.p["gram"][1:].mean(axis=0)))
        return own(net, vec, mask, y, weight)

    monkeypatch.setattr(toxicity, "gradients", gradients)
    toxicity.train([(word, i % 2) for i in range(16)], (8, 8))
    assert seen and all(seen)


def test_isotonic():
    x, y = quality.isotonic(np.array([1, 2, 3, 4, 5.0]), np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all()


def test_isotonic_weights():
    x, y = np.array([1, 2, 3, 4, 5.0]), np.array([0, 1, 0, 1, 1.0])
    many = np.array([1, 3, 2, 1, 4])
    for own, repeated in zip(quality.isotonic(x, y, many.astype("f8")), quality.isotonic(np.repeat(x, many), np.repeat(y, many)), strict=True):
        assert np.allclose(own, repeated)


def test_scores_do_not_depend_on_the_bound(spark, make):
    """Two kinds of text, good at 0.97 and 0.6; a bound that cuts label 1 alone."""
    r, rows, labels = random.Random(8), [], []
    for i in range(1000):
        odd = i % 10 < 3
        words = prose(i, r.randint(20, 60)).split()
        rows.append((i, " ".join(w + "###" if odd else w for w in words)))
        labels.append((i, int(r.random() < (0.6 if odd else 0.97))))
    docs, table = make(rows), spark.createDataFrame([*labels, *labels, (None, 0)], "doc_id long, quality int")
    zeros = sum(not held(i) and q == 0 for i, q in labels)
    whole, cut = ({r["doc_id"]: r for r in quality.score_documents(docs, table, most).collect()} for most in (5000, zeros))
    for kind in (True, False):
        own = [i for i, _ in rows if (i % 10 < 3) == kind]
        assert abs(np.mean([whole[i]["score"] - cut[i]["score"] for i in own])) < 0.08
    assert np.mean([whole[i]["predicted"] == cut[i]["predicted"] for i, _ in rows]) > 0.97


def test_media_digests(spark, make):
    at = shared_dir(spark)
    rows = pj.media_digests(make(EDGE), at).collect()
    want = Counter()
    for i, t in EDGE:
        p = pj.payload_of((t or "").encode())
        (file,) = pj.encode([p])  # alone, not with others
        ((_, rgb),) = pj.decode([file])
        tall, wide = rgb.shape[:2]
        flat = rgb.reshape(-1, 3)
        means = "/".join(str(1000 * sum(map(int, flat[:, c])) // (tall * wide)) for c in range(3))
        shown = f"{tall}x{wide} rgb {means} crc {zlib.crc32(rgb.tobytes()):08x}"
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(file), hashlib.sha256(file).hexdigest(), shown, tall, wide, rgb.tobytes()] += 1
    assert Counter((*tuple(r)[:10], bytes(r["rgb"])) for r in rows) == want
    assert len({tuple(r)[1:8] for r in rows if r["doc_id"] in (4, 5)}) == 1
    stored = {(r["doc_id"], hashlib.sha256(bytes(r["media"])).hexdigest()) for r in spark.read.parquet(at).collect()}
    assert stored == {(r["doc_id"], r["media_sha256"]) for r in rows}  # what was read is what lies there
    assert pj.media_digests(make([])).count() == 0


def test_an_independent_decoder_reads_the_files(spark):
    """The JVM's own JPEG reader, against our luma: its inverse transform rounds in other
    places, and it smooths chroma, so only luma is compared, within a step."""
    jvm = spark._jvm
    payload = pj.payload_of(prose(4, 90).encode())
    (file,) = pj.encode([payload])
    f = pj.parse(file)
    blocks = pj.coefficients([f])
    natural = np.empty_like(blocks)
    natural[:, pj.ZIGZAG] = blocks
    across, down, base = f.planes[0]
    luma = pj.pixels(natural)[base : base + across * down].reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
    reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(bytearray(file))))
    raster = reader.readRaster(0, None)
    assert (raster.getHeight(), raster.getWidth()) == (f.height, f.width)
    r = random.Random(1)
    for y, x in [(r.randrange(f.height), r.randrange(f.width)) for _ in range(400)]:
        assert abs(raster.getSample(x, y, 0) - int(luma[y, x])) <= 1


def test_media_round_trip_of_any_bytes():
    r = random.Random(1)
    payloads = [bytes(r.randbytes(192 * (1 + i % 9))) for i in range(30)] + [bytes(192), bytes([255]) * 384]
    files = pj.encode(payloads)
    assert [p for p, _ in pj.decode(files)] == payloads
    alone = pj.decode([files[7]])[0][1]
    assert (alone == pj.decode(files)[7][1]).all()


def test_tensors(make):
    media = pj.store_media(make(EDGE[:5]))
    rows = pj.rgb_tensors(media).collect()
    assert all(len(r["rgb"]) == 3 * r["height"] * r["width"] for r in rows) and len(rows) == 5


def grey_file(coefficients: np.ndarray) -> bytes:
    """A greyscale file of one row of blocks: DC, AC without the lowest bit, then that bit,
    written symbol by symbol (a plain encoder, with coefficients that turn non-zero late)."""
    dc = {s: (i, 4) for i, s in enumerate(range(12))}
    ac = {s: (i, 8) for i, s in enumerate([0, *(r << 4 | s for r in range(16) for s in range(1, 10)), 0xF0])}

    def bits(parts):
        text = "".join(format(v, f"0{n}b") for v, n in parts if n)
        text += "1" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")

    def value(v):
        n = abs(v).bit_length()
        return n, (v if v >= 0 else v + (1 << n) - 1, n)

    half = lambda v: abs(v) >> 1 if v >= 0 else -(abs(v) >> 1)
    scans, last, parts = [], 0, []
    for block in coefficients:
        n, extra = value(int(block[0]) - last)
        last = int(block[0])
        parts += [dc[n], extra]
    scans.append((0, 0, 0, 0, parts))
    parts = []
    for block in coefficients:
        run = 0
        for k in range(1, 64):
            v = half(int(block[k]))
            if not v:
                run += 1
                continue
            while run > 15:
                parts.append(ac[0xF0])
                run -= 16
            n, extra = value(v)
            parts += [ac[run << 4 | n], extra]
            run = 0
        if run:
            parts.append(ac[0])
    scans.append((1, 63, 0, 1, parts))
    parts = []
    for block in coefficients:
        late = [k for k in range(1, 64) if abs(int(block[k])) == 1]
        run, held = 0, []
        for k in range(1, 64):
            v = int(block[k])
            if abs(v) > 1:
                held.append((abs(v) & 1, 1))
            elif v == 0:
                run += 1
                if run == 16 and late and k < late[-1]:
                    parts += [ac[0xF0], *held]
                    run, held = 0, []
            else:
                parts += [ac[run << 4 | 1], (int(v > 0), 1), *held]
                run, held = 0, []
        if run or held:
            parts += [ac[0], *held]
    scans.append((1, 63, 1, 0, parts))
    table = lambda ident, codes: bytes([ident, *(sum(n == i for _, n in codes.values()) for i in range(1, 17)), *codes])
    n = len(coefficients)
    out = b"\xff\xd8" + pj.segment(0xDB, bytes([0] + [1] * 64)) + pj.segment(0xC2, bytes([8, 0, 8, 8 * n >> 8, 8 * n & 255, 1, 1, 0x11, 0])) + pj.segment(0xC4, table(0, dc) + table(0x10, ac))
    for a, b, known, left, parts in scans:
        out += pj.segment(0xDA, bytes([1, 1, 0, a, b, known << 4 | left])) + bits(parts)
    return out + b"\xff\xd9"


def test_coefficients_that_turn_non_zero_late():
    rng = np.random.default_rng(3)
    blocks = rng.integers(-9, 10, (12, 64)) * (rng.random((12, 64)) < 0.35)
    blocks[3, 1:] = 0
    blocks[5, 1:] = 1
    f = pj.parse(grey_file(blocks))
    assert (pj.coefficients([f]) == blocks).all()


def test_pixels_match_the_transform():
    rng = np.random.default_rng(2)
    block = rng.integers(-60, 60, (5, 64))
    c = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    want = np.clip(np.einsum("ux,buv,vy->bxy", c, block.reshape(5, 8, 8), c) + 128, 0, 255)
    assert np.abs(pj.pixels(block).astype(float) - want).max() <= 1


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_logit(model, net, words):
    """Window by window, word by word, unit by unit."""
    p, h = {k: v.astype("f4").astype("f8") for k, v in net.p.items()}, toxicity.HIDDEN
    known = model.inputs

    def inputs(word):
        row = known.words.get(word, 0)
        own = [g for g in (known.grams.get(x, 0) for x in toxicity.grams(word)) if g] or [0]
        odds = [known.gram_odds[0, g] for g in own]
        mean = sum(p["gram"][g if g <= known.n_grams else 0] for g in own) / len(own)
        return np.concatenate([[known.word_odds[0, row], max(odds), min(odds), sum(odds) / len(odds)], p["word"][row if row <= known.n_words else 0], mean])

    best = -math.inf
    for at in range(0, max(1, len(words)), 1):
        window = words[at : at + toxicity.WINDOW]
        if at and at not in toxicity.windows(len(words)):
            continue
        x, states = [inputs(w) for w in window], np.zeros((len(window), 2 * h))
        for k, order in ((0, range(len(window))), (1, range(len(window) - 1, -1, -1))):
            state = np.zeros(h)
            for t in order:
                a, b = x[t] @ p["in"][k] + p["bias"][k, 0], state @ p["u"][k]
                new = np.zeros(h)
                for i in range(h):
                    z, r = sigmoid(a[i] + b[i]), sigmoid(a[h + i] + b[h + i])
                    new[i] = state[i] + z * (math.tanh(a[2 * h + i] + r * b[2 * h + i]) - state[i])
                state = new
                states[t, k * h : (k + 1) * h] = state
        pooled = np.zeros(2 * h)
        if len(window):
            weight = np.exp(states @ p["attend"])
            pooled = (weight / weight.sum()) @ states
        best = max(best, float(pooled @ p["out"] + p["out_bias"][0]))
    return best


def toxic_rows(n=240):
    r, rows = random.Random(15), []
    for i in range(n):
        words = prose(i, r.randint(5, 80)).split()
        if i % 3 == 0:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["vilewort", "grubface", "snarlgut"]) + r.choice(["", "s", "er"])
        rows.append((" ".join(words), int(i % 3 == 0)))
    return rows


def test_scores_are_those_of_a_plain_network(monkeypatch):
    nets, make_net = [], toxicity.Network
    monkeypatch.setattr(toxicity, "Network", lambda *a: nets.append(make_net(*a)) or nets[-1])
    model = toxicity.train(toxic_rows(), (160, 80))
    scorer, (a, b) = toxicity.Scorer(model), model.scale
    texts = [t for t, _ in toxic_rows(30)] + ["", prose(3, 200), "vilewort", "unseen wordless things"]
    for text, score in zip(texts, scorer.scores(texts), strict=True):
        words = [toxicity.clean(w) for w in text.split()]
        assert math.isclose(score, sigmoid(a * plain_logit(model, nets[0], words) + b), abs_tol=2e-4)


def test_the_network_learns_without_log_odds(monkeypatch):
    """With the log odds at zero, embeddings and recurrence alone tell held-out rows apart."""
    own = toxicity.Inputs.parts

    def parts(self, words, views):
        word, odds, *rest = own(self, words, views)
        return word, np.zeros_like(odds), *rest

    monkeypatch.setattr(toxicity.Inputs, "parts", parts)
    rows = toxic_rows(420)
    model = toxicity.train(rows[:300], (200, 100))
    got = toxicity.Scorer(model).scores([t for t, _ in rows[300:]])
    assert np.mean([(s >= 0.5) == y for s, (_, y) in zip(got, rows[300:], strict=True)]) > 0.85


def plain_statistics(text):
    words, lines, n = text.split(), text.split(b"\n"), len(text)
    counts, m = Counter(words), max(1, len(text.split()))
    share = [c / n for c in Counter(text).values()]
    common = sorted(counts.values(), reverse=True)
    shares = [sum(text.count(bytes([c])) for c in group) / n for group in quality.GROUPS] + [sum(c >= 128 for c in text) / n]
    return shares + [
        -sum(s * math.log(s) for s in share), math.log(1 + m), n / m, len(counts) / m, len(counts) / m**0.5, (common[0] if common else 0) / m, sum(common[:3]) / m,
        len(set(lines)) / len(lines), len(lines) / m, len(zlib.compress(text, 1)) / n, sum(len(w) for w in counts) / max(1, len(counts)),
    ]


def test_quality_is_ridge_on_a_gaussian_kernel_with_isotonic_means(spark, labelled):
    """The whole fit told plainly: all rows at once, least squares, min-max isotonic means."""
    docs, labels = labelled
    fold_of = {r["doc_id"]: r["fold"] for r in docs.selectExpr("doc_id", "cast(pmod(xxhash64(doc_id), 2) as int) fold").collect()}
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    known = sorted((i, q) for i, q in {(r["doc_id"], r["quality"]) for r in labels.collect()} if i in text and i is not None and q is not None and not held(i))
    x = np.array([plain_statistics(text[i]) for i, _ in known])
    y, fold = np.array([q for _, q in known], "f8"), np.array([fold_of[i] for i, _ in known])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale <= 1e-9] = 1
    rng = np.random.default_rng(quality.SEED)
    w = rng.normal(size=(x.shape[1], quality.FEATURES)) / math.sqrt(x.shape[1])
    b = rng.uniform(0, 2 * math.pi, quality.FEATURES)
    lift = lambda s: np.c_[math.sqrt(2 / quality.FEATURES) * np.cos(np.clip((s - mean) / scale, -6, 6) @ w + b), np.ones(len(s))]
    root = np.diag([math.sqrt(quality.RIDGE)] * quality.FEATURES + [1e-3])
    solve = lambda own: np.linalg.lstsq(np.r_[lift(x[own]), root], np.r_[y[own], np.zeros(len(root))], rcond=None)[0]
    raw = np.where(fold == 0, lift(x) @ solve(fold == 1), lift(x) @ solve(fold == 0))
    weights, order = solve(fold >= 0), np.argsort(raw, kind="stable")
    raw, y = raw[order], y[order]
    best = [max(min(y[a : b + 1].mean() for b in range(k, len(y))) for a in range(k + 1)) for k in range(len(y))]
    knots: dict = {}
    for r, v in zip(raw, best, strict=True):  # a block's middle
        knots.setdefault(round(v, 12), []).append(r)
    middles = [((own[0] + own[-1]) / 2, v) for v, own in knots.items()]
    plain = {i: float(np.interp(lift(np.array([plain_statistics(t) if t else [0.0] * x.shape[1]])) @ weights, *zip(*middles, strict=True))[0]) for i, t in text.items()}
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels).collect()}
    assert max(abs(got[i] - plain[i]) for i in text) < 1e-4
    # and the random features approximate the kernel that they stand for
    s = (x[:40] - mean) / scale
    s = np.clip(s, -6, 6)
    wide = rng.normal(size=(s.shape[1], 20_000)) / math.sqrt(s.shape[1])
    z = np.cos(s @ wide + rng.uniform(0, 2 * math.pi, 20_000)) * math.sqrt(2 / 20_000)
    kernel = np.exp(-((s[:, None] - s[None]) ** 2).sum(axis=2) / (2 * s.shape[1]))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_training_rows_are_bounded_by_ids_and_bytes(spark, make):
    docs = make([(1, "a" * 50)] * 200 + [(i, "b" * 40) for i in range(2, 60)])
    labels = spark.createDataFrame([(i, 1) for i in range(1, 60)] * 2, "doc_id long, toxic int")
    rows = labelled_.one_text(labelled_.sample(docs, labels, "toxic", 20))
    assert rows.count() == 20 == rows.select("doc_id").distinct().count()
    assert labelled_.within_bytes(rows, 400).count() in (9, 10)  # 40 or 50 bytes each
    n = sum(not held(i) for i in range(1, 60))
    assert labelled_.class_counts(labels, "toxic") == (0, n)


def test_a_long_text_takes_no_other_texts_place(spark):
    """One text beyond the bound, first in the order of hashes or not, in either class."""
    short = [(i, f"text {i} " * 5, i % 2, 0) for i in range(1, 41)]
    for label in (0, 1):
        for i in range(100, 110):
            rows = spark.createDataFrame([*short, (i, "long " * 4000, label, 0)], "doc_id long, text string, label int, fold int")
            got = labelled_.within_bytes(rows, 10_000).collect()
            assert sorted((r["doc_id"], r["text"]) for r in got) == [(k, t) for k, t, *_ in short]
    alone = spark.createDataFrame([*short[:20:2], (100, "ü" * 20_000, 0, 0), (101, "ü" * 20_001, 0, 0)], "doc_id long, text string, label int, fold int")
    got = {r["doc_id"]: r["text"] for r in labelled_.within_bytes(alone, 10_000).collect()}
    assert got == {k: t for k, t, *_ in short[:20:2]} | {100: "ü" * 2500}
    # a text of a sixteenth or more of the bound, but within it, is taken after the others
    mid = spark.createDataFrame([*short[:4], (100, "m" * 9000, 0, 0), (101, "m" * 1000, 0, 0)], "doc_id long, text string, label int, fold int")
    assert 101 in {r["doc_id"] for r in labelled_.within_bytes(mid, 10_000).collect()}


def test_toxicity_beside_a_labelled_text_of_nine_megabytes(spark):
    r = random.Random(5)
    words = [f"word{k}" for k in range(60)]
    rows = [(i, " ".join(r.choice(words) for _ in range(20)) + (" vile" if i % 2 else ""), i % 2) for i in range(1, 121)]
    long = " ".join(words) * 26_000
    assert len(long) > 9 << 20 > toxicity.MOST_BYTES
    scores = []
    for extra in ([], [(k, long, y) for k, y in ((1001, 0), (1002, 1))]):
        docs = spark.createDataFrame([(i, t) for i, t, _ in rows + extra], "doc_id long, text string")
        labels = spark.createDataFrame([(i, y) for i, _, y in rows + extra], "doc_id long, toxic int")
        model = toxicity.fit(docs, labels)
        scores.append(np.array(toxicity.Scorer(model).scores([t for _, t, _ in rows])))
    assert np.abs(scores[0] - scores[1]).max() < 0.02
    assert scores[1][1::2].max() < 0.5 < scores[1][::2].min()


def test_words_are_projected_once_while_the_table_has_room(monkeypatch):
    """Case and marks are no new word, 70,000 words stay in the table, and scores don't
    depend on what was dropped from it."""
    rows = [(f"word{i % 7} good{i % 5} fine", 0) for i in range(40)] + [(f"word{i % 7} bad{i % 5} vile", 1) for i in range(40)]
    model = toxicity.train(rows, (40, 40))
    scorer, made, vectors = toxicity.Scorer(model), [], model.vectors
    monkeypatch.setattr(model, "vectors", lambda words: made.extend(words) or vectors(words))
    texts = [" ".join(f"{k}w{i}" for i in range(7000)) for k in range(10)]
    scorer.scores(texts)
    scorer.scores(["a"])
    scorer.scores([t.replace("w", "W").replace(" ", ", ") for t in texts])
    assert len(made) == len(set(made)) == 70_001
    own = [t for t, _ in rows] + ["", "| |", "Bad1! (vile)", "x" * 900]
    want = toxicity.Scorer(model).scores(own)
    monkeypatch.setattr(toxicity.Scorer, "ROWS", 2)
    for limit in ("KEEP", "KEYS", "KEEP_BYTES"):
        with monkeypatch.context() as m:
            m.setattr(toxicity.Scorer, limit, 1)
            small = toxicity.Scorer(model)
            assert np.allclose([small.scores([t])[0] for t in own], want, rtol=1e-5)
            small.forget()
            assert len(small.table) == 2 and small.row == {"": 0}
