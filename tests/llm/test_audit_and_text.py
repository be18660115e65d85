"""Operators 11 to 13 against brute force, and the helpers that they brought."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import pytest
from conftest import EDGE, SCHEMA, prose
from pyspark.sql import functions as F

from tokoro.llm import filter_audit, html_text, importance
from tokoro.llm.common import HOT_KEYS, ranked, shared_dir, spread_join, written

LABELS = "doc_id long, quality int, toxic int, text string"


# --- 11 ---------------------------------------------------------------------------------


def plain_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    ids = {}
    for i, t, _ in docs:
        if i is not None:
            ids[t or ""] = min(ids.get(t or "", i), i)
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > ids.get(t, i),
        }
        rows.append((lang or "", fails, i in good, i in toxic))
    out = Counter()
    for part in {r[0] for r in rows}:
        own, got, shapley = [r for r in rows if r[0] == part], [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                redundant = sum(r[1][f] for r in own) - len(gone)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                got.append((part, "".join(order), step, len(left), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += Counter((*g[:-1], shapley[g[-1]]) for g in got)
    return out


def audited(spark, docs, labels):
    df = spark.createDataFrame([(i, t, lang, "s", 0, 1.0, 2, 3) for i, t, lang in docs], SCHEMA)
    said = spark.createDataFrame([(i, q, t, "x") for i, q, t in labels], LABELS)
    out = filter_audit.audit(df, said)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return Counter(map(tuple, out.collect()))


def test_audit(spark):
    long = prose(3, 150)
    docs = [(i, t, "en") for i, t in EDGE]
    docs += [(20, long, "de"), (21, long, None), (22, long + " #", "de"), (23, long.upper(), "de"), (24, "the " * 200, ""), (25, long, "de"), (25, long, "de"), (None, long, "de"), (None, None, None)]
    docs += [(26, "ÄÖ É" * 60, "fr"), (27, " ".join(f"w{i}" for i in range(100)), "fr"), (28, " ".join(f"w{i % 80}" for i in range(100)), "fr"), (29, "\x0b".join(f"w{i}" for i in range(100)) + "\x1c", "fr")]
    labels = [(20, 1, 0), (20, 0, 1), (22, 1, None), (25, 1, 0), (24, None, 1), (None, 1, 1), (4, 1, 1), (99, 1, 1)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_a_hot_text(spark):
    """A third of the rows share a text, and a third an id."""
    docs = [(i, "same text", "en") for i in range(40)] + [(7, f"text {i}", "en") for i in range(40)] + [(100 + i, prose(i, 110), "de") for i in range(40)]
    labels = [(7, 1, 1), (120, 1, 0)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_nothing(spark):
    assert not audited(spark, [], [])
    assert audited(spark, [(1, "a", "en")], []) == plain_audit([(1, "a", "en")], [])


# --- 12 ---------------------------------------------------------------------------------


def plain_resample(docs, target):
    def features(t):
        t = (t or "").translate({i: i + 32 for i in range(65, 91)})
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, bs in found for b in bs), Counter(b for x in target for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (total_s + 10000) / ((s[k] + 1) * (total_t + 10000)))) for k in range(10000)]
    out = []
    for i, n, bs in found:
        weight, score = sum(gain[b] for b in bs), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(bs), weight, score, None, n])
    able = sorted((o for o in out if o[5] >= 20 and o[3] is not None), key=lambda o: (-o[3], o[0]))
    for r, o in enumerate(able[: 5 * len(able) // 100], 1):
        o[4] = r
    return Counter(tuple(o[:5]) for o in out)


@pytest.mark.parametrize("piece, words", [(importance.PIECE, importance.BLOCK_WORDS), (700, 300)])
def test_resample(spark, make, monkeypatch, piece, words):
    """Also with texts that span several pieces and blocks, which the workers see as well."""
    docs = EDGE + [(i, prose(i, 40 + i % 30)) for i in range(100, 200)] + [(300, "ÀÉ x9Y_z—w"), (301, "a"), (302, "a b"), (303, "x" * 5000 + " y"), (-4, prose(9, 25))]
    docs += [(400 + i, prose(7, 30)) for i in range(60)] + [(500, prose(8, 30))] * 3  # equal texts, a repeated row
    target = [None, "", prose(7, 30), "a b c", "a b c"]
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(target)], "item_id long, text string, score double")
    monkeypatch.setattr(importance, "PIECE", piece)
    monkeypatch.setattr(importance, "BLOCK_WORDS", words)
    blocks = list(importance.blocks(enumerate((t or "").encode() for _, t in docs)))
    if words < 1000:
        assert len(blocks) > 5 and max(len(b.words) for b in blocks) < 2 * words
    assert Counter(map(tuple, importance.resample(make(docs), bench).collect())) == plain_resample(docs, target)


def test_a_trie_in_pieces_counts_what_the_whole_does(monkeypatch):
    texts = [(0, prose(1, 3000).encode()), (1, b""), (2, b"a b a b a b"), (3, prose(2, 500).encode())]
    gain = np_gain()

    def counted():
        total, weight = Counter(), Counter()
        for block in importance.blocks(iter(texts)):
            for _, n, crc, _ in block.trie():
                for c, k in zip(crc.tolist(), n.tolist(), strict=True):
                    total[c] += k
            for row, w in zip(block.spread(block.rows).tolist(), block.weights(gain).tolist()):
                weight[row] += w
        return +total, weight

    whole = counted()
    monkeypatch.setattr(importance, "PIECE", 40)
    monkeypatch.setattr(importance, "BLOCK_WORDS", 9)
    assert counted() == whole
    assert whole[0][zlib.crc32(b"a b a")] == 2


def np_gain():
    import numpy as np

    return np.random.default_rng(1).integers(-900, 900, importance.BUCKETS)


def test_resample_of_nothing(spark, make):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(make([]), bench).count() == 0
    docs = [(1, prose(1, 30)), (2, None)]
    assert Counter(map(tuple, importance.resample(make(docs), bench).collect())) == plain_resample(docs, [])


# --- 13 ---------------------------------------------------------------------------------

STORY = "<h1>A title</h1><p>First paragraph with enough words to be read as prose by anyone.</p><p>Short.</p><p>Third &amp; last, 5 &lt; 6&#33;<br>new line</p>"
TEXT = "A title\n\nFirst paragraph with enough words to be read as prose by anyone.\n\nShort.\n\nThird & last, 5 < 6! new line"
MENU = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav>"

PAGES = {
    "article": (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><p>x</p>';</script></head><body>{MENU}<div class='ad'>Buy now.</div><article>{STORY}</article><footer>&copy; me</footer></body></html>", TEXT),
    "unclosed": (f"<body><nav><a>x</a></nav><article>{STORY.replace('</p>', '')}", TEXT),
    "main": (f"<header><h1>Site</h1></header><main>{STORY}<form><p>Your name<input></p></form></main><aside><p>{prose(1, 60)}</p></aside>", TEXT),
    "no article": (f"<div id='site-header'><h2>Site</h2><p>Motto of the site</p></div><div id='content'>{STORY}</div><div class='sidebar'><p>{prose(2, 80)}</p></div><div id='footer'>Imprint</div>", TEXT),
    "comments": (f"<article>{STORY}</article><section id='comments'><article class='comment'><p>{prose(3, 200)}</p></article></section>", TEXT),
    "comments inside": (f"<article>{STORY}<div class='comment-list'><p>{prose(3, 200)}</p></div></article>", TEXT),
    "wrapping form": (f"<form><div class='page-header-wrap'><article>{STORY}<button>Send</button><label>Mail</label></article></div></form>", TEXT),
    "notice": (f"<div role='dialog'><p>We use cookies on all of our pages here.</p></div><div class='cookieNotice'><p>{prose(4, 50)}</p></div><article>{STORY}</article>", TEXT),
    "hidden": (f"<article><p hidden>no</p><p style='display: none'>no</p>{STORY}<span aria-hidden='true'>no</span></article>", TEXT),
    "own header": (f"<article><header><h1>A title</h1><p>By somebody</p></header>{STORY.replace('<h1>A title</h1>', '')}</article>", TEXT),
    "link list": (f"<article>{STORY}<ul><li><a href=a>More</a></li><li><a href=b>Yet more</a></li></ul></article>", TEXT),
    "comment to the end": (f"<article>{STORY}</article><!-- not closed <p>no</p>", TEXT),
    "comment": (f"<article><!-- <p>no</p> -->{STORY}</article>", TEXT),
    "void and case": (f"<ARTICLE>{STORY.replace('<p>', '<P CLASS=x>')}<IMG src=x><hr/></ARTICLE>", TEXT),
    "head left open": ("<head><title>T</title><p>Hello there</p>", "Hello there"),
    "list and table": ("<article><ul><li>one<li>two <b>bold</b></ul><table><tr><td>a<td>b<tr><th>c</table></article>", "one\n\ntwo bold\n\na\n\nb\n\nc"),
    "white space": ("<article><p>  a\n\t b&nbsp;&#160; c  </p><pre>x\n  y</pre></article>", "a b c\n\nx y"),
    "code comments stay": ("<article><pre><span class='hljs-share'># note</span> x</pre></article>", "# note x"),
    "plain text": ("just &lt;text&gt;", "just <text>"),
    "only a script": ("<script>var x = '<article>';", ""),
    "only a menu": (MENU, ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("kind", PAGES)
def test_main_text(kind):
    assert html_text.main_text(PAGES[kind][0]) == PAGES[kind][1]


def test_extract(spark):
    rows = [(i, f"http://{k}", h, "x", 1) for i, (k, (h, _)) in enumerate(PAGES.items())] + [(None, None, "<p>a</p>", "x", 1)] * 2
    rows += [(900, "long", "<article>" + "<p>" + prose(5, 60_000) + "</p>" * 2 + "</article>", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    want = [(i, u, html_text.main_text(h)) for i, u, h, *_ in rows]
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter(map(tuple, got.collect())) == Counter((i, u, t, len(t)) for i, u, t in want)
    assert html_text.extract(df.limit(0)).count() == 0


def test_given_pages_give_their_articles(spark):
    """Against a plain reading of the one form that the given pages have."""
    import html as entities

    def plain(page):
        inner, out = re.search("<article>(.*)</article>", page, re.S).group(1), []
        for part in re.split("</?(?:p|h1)>", inner):
            text = " ".join(entities.unescape(re.sub("<[^>]+>", lambda m: " " if m[0] == "<br>" else "", part)).split())
            out += [text] if text else []
        return "\n\n".join(out)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()} == want


def test_deep_nesting_costs_no_more_than_its_size():
    deep = "<div>" * 30_000 + "<p>x" + "</p>a" * 30_000
    assert html_text.main_text(deep).startswith("x\n\na\n\na")


# --- helpers ----------------------------------------------------------------------------


def test_spread_join(spark):
    at = shared_dir(spark)
    left = [(k, i) for i in range(HOT_KEYS * 2) for k in ([1] if i % 3 == 0 else [i] if i % 3 == 1 else [None])]
    right = [(1, 10, "hot"), (4, 1, "cold"), (None, 1, "null"), (-5, 1, "alone")]
    rows = written(spark.createDataFrame(left, "k long, v long"), f"{at}/l")
    keys = written(spark.createDataFrame(right, "k long, n long, what string"), f"{at}/r")
    keys = keys.withColumn("n", F.when(F.col("k") == 1, sum(k == 1 for k, _ in left)).otherwise(F.col("n")))
    got = spread_join(rows, keys, "k", "n", len(left), "v")
    what = {1: "hot", 4: "cold"}
    assert Counter(map(tuple, got.select("k", "v", "what").collect())) == Counter((k, v, what.get(k)) for k, v in left)
    met = spread_join(rows, keys, "k", "n", len(left), "v", "inner").repartition(1)
    assert Counter(map(tuple, met.select("k", "v", "what").collect())) == Counter((k, v, what[k]) for k, v in left if k in what)


def test_no_task_has_a_hot_keys_rows_alone(spark):
    """A third of the rows share a key, a third have none: each of 16 partitions gets its share."""
    at, n = shared_dir(spark), HOT_KEYS * 3
    rows = written(spark.range(n).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), F.col("id").alias("v")), f"{at}/l")
    keys = written(spark.createDataFrame([(1, n // 3, "hot")], "k long, n long, what string"), f"{at}/r")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("16", "false", "-1"), strict=True):
            spark.conf.set(k, v)
        got = spread_join(rows, keys, "k", "n", n, "v").withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 16 and max(r["count"] for r in got) < 1.3 * n / 16


def test_ranked(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "a long, b long")
    got = ranked(df, [F.col("a").desc(), "b"], f"{shared_dir(spark)}/x").collect()
    want = sorted(range(500), key=lambda i: (-(i % 7), i))
    assert {r["b"]: r["position"] for r in got} == {i: k for k, i in enumerate(want)}
