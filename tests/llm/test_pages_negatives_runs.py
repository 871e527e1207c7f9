"""Main text of pages, hard negatives and periodic runs, against brute force and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoweave.llm import hard_negatives, html_text, periodic_runs
from isoweave.llm.html_text import main_text, smoothed, threshold
from isoweave.llm.shared import crc_mod

WORDS = "word " * 40


# ---- operator 11


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>Hi.", "Hi."),
        ("a < b", "a < b"),
        ("<article><h1>T&amp;</h1><p>a<b>b</b>c&nbsp;d &#x41;<br>e</p></article><footer>f</footer>", "T& abc d A e"),
        ("<nav>menu</nav><article><p>one<p>two</article><p>" + WORDS, "one two"),
        ("<main>ok<script>var a='</p>'</script> fine</main><div>" + WORDS + "</div>", "ok fine"),
        ("<article>x<form>no</form><aside>no</aside><div class='cookie-notice'>no</div><section id=comments><article class=comment>no</article></section>y</article>", "x y"),
        ("<article>x <span class=ad>no <span>no</span> no</span> y</article>", "x y"),
        ("<article><p>one two</p><ul><li><a href=a>x</a><li><a href=b>y</a><li><a href=c>z</a></ul><ul><li>three<li>four</ul></article>", "one two three four"),
        ("<div class=menu><a href=a>x</a></div><div id=text><h2>T</h2><p>" + WORDS + "<p>short.</div><div class='site-footer'>" + WORDS + "</div>", f"T {WORDS.strip()} short."),
        ("<div>Home<br>About</div><h1>Title</h1><p>" + WORDS + "</p><p>" + WORDS + "</p><div>2020</div>", f"Title {WORDS.strip()} {WORDS.strip()}"),
        ("<article>x<!-- no --> y</article><!-- <p>never ends", "x y"),
        ("<article>a</article><article class='comment'>no</article><article>b</article>", "a b"),
        ("<div hidden>no</div><div style='display: none'>no</div><p>yes</p>", "yes"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


def test_long_and_broken_pages_end_soon():
    assert main_text("<article>" + "<p>ab</p>" * 50_000 + "</article>") == " ".join(["ab"] * 50_000)
    for html in ("<!--" * 200_000, "<a<a<a" * 50_000, "<div>" * 50_000 + "x", "x" * 3_000_000):
        main_text(html)


def test_ratios_are_smoothed_and_cut_between_their_clusters():
    assert np.allclose(smoothed(np.array([0.0, 0, 1, 0, 0]), 1.0, 2), smoothed(np.array([0.0, 0, 1, 0, 0]), 1.0, 2)[::-1])
    assert 4 < threshold(np.array([1.0, 2, 3, 20, 21])) < 20 and threshold(np.array([5.0, 5])) == 5


def test_pages_keep_rows_and_ignore_further_columns(spark):
    rows = [(1, "u", "<p>a b</p>", 7), (1, "u", "<p>a b</p>", 7), (None, None, None, None), (2, None, "", 1)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == [(0, "", "", 0), (1, "u", "a b", 3), (1, "u", "a b", 3), (2, "", "", 0)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- operator 12


def negatives_by_loops(rows, every, positives=5, negatives=3):
    out = []
    for a, (la, va) in rows.items():
        if a % every:
            continue
        score = {r: int(np.dot(va, v)) for r, (_, v) in rows.items() if r != a and len(v) == len(va)}
        order = lambda ids: sorted(ids, key=lambda r: (-score[r], r))
        for p in order([r for r in score if rows[r][0] == la])[:positives]:
            fit = [r for r in score if rows[r][0] != la and 50 * score[p] <= 100 * score[r] <= 95 * score[p]]
            out += [(a, p, k + 1, r, score[p], score[r]) for k, r in enumerate(order(fit)[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["even", "cone", "copies", "two lengths", "large"])
def test_negatives_equal_plain_loops(spark, kind, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 8)
    n = 600
    x = rng.normal(size=(n, 6)) * 40
    if kind == "cone":
        x += 60
    if kind == "copies":
        x[: n // 3] = x[0]
        x[n // 3 : n // 2] = np.round(x[n // 3 : n // 2] / 40) * 40
    if kind == "large":
        x *= 1e5
    x = x.astype(int)
    rows = {i: (int(rng.integers(0, 4)), x[i, : 4 if kind == "two lengths" and i % 3 == 0 else 6].tolist()) for i in range(n)}
    df = spark.createDataFrame([(i, a, v) for i, (a, v) in rows.items()], "vec_id long, label int, v array<int>")
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == negatives_by_loops(rows, 20)


def test_boxes_are_pruned_and_bounds_hold():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 1000
    x = (centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8)) * 20).astype(np.int64)
    tree = hard_negatives.Tree(np.arange(4000), np.zeros(4000, np.int64), x, leaf_rows=32)
    leaf = tree.levels[0]
    low, high = hard_negatives.intervals(x[:3].astype(float), leaf.low.astype(float), leaf.high.astype(float))
    for k, (a, z) in enumerate(zip(leaf.first, leaf.last)):
        s = x[:3] @ tree.x[a:z].T
        assert (s >= low[:, [k]]).all() and (s <= high[:, [k]]).all()
    opened = []
    wide = np.full((1, 1), 1 << 62)
    original = hard_negatives.Best.add
    hard_negatives.Best.add = lambda self, *a: (opened.append(1), original(self, *a))[1]
    try:
        best = hard_negatives.search_block(tree, np.array([0]), np.array([0]), x[:1], -wide, wide, -wide, True, 5)
    finally:
        hard_negatives.Best.add = original
    s = x @ x[0]
    s[0] = -(1 << 62)
    assert best.scores[0].tolist() == sorted(s.tolist())[::-1][:5] and len(opened) < len(leaf.first) / 4


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25], 1), (1, None, 1), (2, [], 1), (3, [None, 1.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (7, [1e30, 0.0], 1), (8, [-0.001, 0.0], 2), (8, [-0.001, 0.0], 3), (8, [-0.001, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.label, tuple(r.v)) for r in hard_negatives.quantised(df).collect()) == [(0, 1, (128, 64)), (8, 2, (-1, 0))]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, tile string")
    assert hard_negatives.mine(hard_negatives.quantised(none), F.col("vec_id") % 50 == 0).count() == 0


def test_tiles_beyond_the_size_of_their_boxes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(hard_negatives, "BOX_BYTES", 0)
    rows = {i: (int(rng.integers(0, 3)), (rng.normal(size=4) * 50).astype(int).tolist()) for i in range(200)}
    df = spark.createDataFrame([(i, a, v) for i, (a, v) in rows.items()], "vec_id long, label int, v array<int>")
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 10 == 0).collect())) == negatives_by_loops(rows, 10)


# ---- operator 13


def runs_by_loops(w, least=6):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if j > i and len(s) >= max(least, 4 * q) and not any(all(s[x] == s[x + d] for x in range(len(s) - d)) for d in range(1, q)):
                out.append((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_plain_loops():
    rng = random.Random(7)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            w = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(0, 120))]
            if w and rng.random() < 0.6:
                a = rng.randrange(len(w))
                p = 1 + (len(w) - a) // rng.randint(3, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            texts.append(w * (rng.randint(1, 9) if rng.random() < 0.2 else 1))
        of, start, length, period = periodic_runs.find_runs(np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts]))
        for k, t in enumerate(texts):
            assert [r[1:] for r in zip(of.tolist(), start.tolist(), length.tolist(), period.tolist()) if r[0] == k] == runs_by_loops(t)


def test_wavelet_tree_counts_and_selects():
    values = np.random.default_rng(3).permutation(200)
    tree = periodic_runs.WaveletTree(values)
    for a, b in ((0, 200), (13, 14), (50, 120)):
        part = np.sort(values[a:b])
        for v in (0, 57, 199):
            assert tree.below(np.array([a]), np.array([b]), np.array([v]))[0] == (part < v).sum()
        assert tree.smallest(np.full(b - a, a), np.full(b - a, b), np.arange(b - a)).tolist() == part.tolist()


def test_fewer_than_four_periods_are_refused():
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(9, np.int64), np.array([9]), times=3)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_by_loops(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_loops(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_rows_equal_plain_loops(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n\x0b ", "a b c " * 4, "a b c " * 5 + "a b", "x" * 100_000, "    " * 6, "y " * 3000, " ".join(rng.choice("ab") for _ in range(300))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q q q q q q"), (3, "a b c " * 4)]
    rows += [(i, " ".join(rng.choice(["of", "the", "w%d" % rng.randrange(40)]) for _ in range(rng.randrange(90)))) for i in range(100, 220)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, runs int")
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    assert sorted(map(tuple, periodic_runs.detect(docs, crc_mod("doc_id", 1 << 32)).collect()), key=key) == sorted([row_by_loops(*r) for r in rows], key=key)
    assert periodic_runs.detect(docs.limit(0)).count() == 0


def test_spans_and_collapsed_text(spark):
    got = periodic_runs.detect(spark.createDataFrame([(1, "s a b a b a b a b t")], "doc_id long, text string"), spans=True).first()
    assert [tuple(r) for r in got.runs] == [(1, 8, 2)] and got.collapsed == "s a b t" and got.exponent_milli == 4000
