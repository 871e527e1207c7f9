"""Training-data operators against brute force, and their edge cases."""

import base64
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoweave.llm import class_lm, decontaminate, embedding_dedup, jaccard_join, language_id, mixing, queries, suffix_dedup, toxicity, url_rules, warc
from isoweave.llm.shared import components, crc_mod

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "en", "s", 0, "clash") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


# 1 -------------------------------------------------------------------------------------------
def test_curated_rules(spark):
    urls = [
        ("http://a.example.com/en/81", "a.example.com", "/en/81", "com/en/", "block"), ("HTTP://A.Example.COM/en/7?x#y", "a.example.com", "/en/7", "example.com/en/7", "allow"),
        ("x://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"), ("x://other.net/de/8", "other.net", "/de/8", "net/de/", "allow"),
        ("x://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"), ("x://b.org/es/#q", "b.org", "/es/", "org/es/", "block"),
        ("x://b.org?/es/", "b.org", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("x://", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("http://a.com?u=http://b.com/en/7", "a.com", "", None, "allow"), ("http://a.com#://b.org/es/", "a.com", "", None, "allow"), ("x://b.org/es/" + "y" * 300_000, "b.org", "/es/" + "y" * 300_000, "org/es/", "block"),
    ]
    df = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    assert url_rules.judge(df.unionByName(df), queries.URL_RULES).groupBy("page_id").count().where("count = 2").count() == len(urls)
    got = {r.page_id: r for r in url_rules.judge(df, queries.URL_RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)


def test_mined_rules_generalise(spark):
    rows = [(f"http://win{i % 3}.casino.example.com/en/{i}", "block") for i in range(60)] + [(f"http://news.example.org/en/{i}", "allow") for i in range(60)]
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, verdict string"))
    urls = spark.createDataFrame([(1, "http://new.casino.example.com/fr/1"), (2, "http://news.example.org/x"), (3, "http://else.where/x"), (4, None)], "page_id long, url string")
    assert [r.mined_verdict for r in url_rules.match(urls, rules).orderBy(F.col("url").isNull(), "url").collect()] == ["allow", "block", "allow", "allow"]
    assert rules.where("confidence < 0.9").count() == 0


def test_one_sided_curated_rules_block_no_unjudged_urls(spark):
    urls = [f"http://a{i}.org/es/{i}" for i in range(60)] + [f"http://b{i}.org/fr/{i}" for i in range(60)] + [f"http://c{i}.net/es/{i}" for i in range(60)]
    urls += [f"http://win{i}.casino.com/en/{i}" for i in range(60)] + ["http://new.casino.com/fr/1", None]
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), [("block", "org/es/"), ("block", "com/en/")]).collect()}
    assert all(got[i].verdict == "block" and got[i].mined_rule is None for i in (*range(60), *range(180, 240)))
    assert all(got[i].verdict == "allow" and got[i].mined_rule is None for i in range(60, 180))
    # nearly all urls of this host are judged, so a new one goes with them
    assert got[240].verdict == "block" and "host:casino.com" in got[240].mined_rule
    assert got[241].verdict == "allow"


def test_mined_verdicts_against_brute_force(spark):
    """All token combinations of all urls are counted one by one."""
    rng = random.Random(31)
    urls = [f"http://{rng.choice(['win', 'news', 'blog'])}.{rng.choice(['bet', 'shop'])}.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['en', 'fr', 'es'])}/{rng.choice(['a', 'b'])}{rng.choice(['?q=1', '', '#x'])}" for _ in range(400)] + [None, "none"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    curated = [("block", "com/en/"), ("block", "win.bet.org/"), ("allow", "shop.net/"), ("block", "bet.net/es/a")]
    limits = dict(min_support=0.01, min_confidence=0.55, min_count=5)
    got = {r.page_id: r for r in url_rules.judge(df, curated, **limits).collect()}
    tokens = {r.page_id: frozenset(r.t) for r in df.select("page_id", url_rules.tokens(F.col("url")).alias("t")).collect()}
    fit = {i: next((v for n, v in sorted(((len(r), v) for v, r in curated if got[i].rule == r), reverse=True)), None) for i in tokens}
    n = sum(u is not None for u in urls)
    least = max(0.01, 5 / n) * n
    subsets = lambda s: (frozenset(c) for k in range(1, len(s) + 1) for c in itertools.combinations(sorted(s), k))
    alone, both = Counter(), Counter()
    for i, u in enumerate(urls):
        for s in subsets(tokens[i]) if u is not None else ():
            alone[s] += 1
            both[s, fit[i]] += 1
    rules = {(s, v): c / alone[s] for (s, v), c in both.items() if v and c >= least and c / alone[s] >= 0.55}
    kept = {(s, v): p for (s, v), p in rules.items() if not any(w == v and q < s and rules[q, w] >= p for q, w in rules)}
    assert len(kept) > 5
    for i in tokens:
        fires = sorted(((-p, -both[s, v] / n, -len(s), sorted(s)), v) for (s, v), p in kept.items() if s <= tokens[i])
        assert got[i].verdict == (fit[i] or (fires[0][1] if fires else "allow")), urls[i]
        assert got[i].mined_rule == (None if fit[i] or not fires else " ".join(fires[0][0][3]))


def test_urls_of_an_empty_table(spark):
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


# 2 -------------------------------------------------------------------------------------------
def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    x = np.vstack([base, base[:20] + 0.05 * rng.standard_normal((20, 16)), base[:1] + 0.02 * rng.standard_normal((700, 16)), base[5:6], 3 * base[6:7]])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [None, 1.0], 1), (9004, [1.0, 2.0], 1), (9005, [], 1), (9006, [float("inf")] * 16, 2)]
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")).collect()}
    assert len(got) == len(rows)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), label[i], label[i] == i) for i in range(len(x)))
    assert all((got[i].n_links, got[i].kept) == (0, True) for i in range(9000, 9007))


def test_recall_of_isolated_pairs(spark):
    """Pairs just above the threshold in a crowd, held against brute force; passes grow with the rows."""
    rng = np.random.default_rng(22)
    x = rng.standard_normal((9000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal((600, 24))
    side -= (side * x[:600]).sum(1)[:, None] * x[:600]
    side /= np.linalg.norm(side, axis=1)[:, None]
    x = np.vstack([x, 0.953 * x[:600] + math.sqrt(1 - 0.953**2) * side])
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    assert sum(r.n_links for r in got.values()) >= 0.98 * near.sum() >= 1100
    assert embedding_dedup.passes_needed(10**9, 0.95, 48, 0.99) > 2 * embedding_dedup.passes_needed(10**6, 0.95, 48, 0.99)


@pytest.mark.parametrize("mean", [0.7, 0.9])
def test_links_in_a_cloud_of_like_vectors(spark, mean):
    """Real embeddings share a direction: pairs just above the threshold must be found among vectors nearly as close."""
    rng = np.random.default_rng(3)
    n, d, pairs = 6000, 64, 150
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.normal(size=(1, d)))
    apart = lambda x: unit(x - (x @ base.T) * base)
    r = apart(rng.normal(size=(n, d)))
    other = apart(rng.normal(size=(pairs, d)))
    other = unit(other - (other * r[:pairs]).sum(axis=1, keepdims=True) * r[:pairs])
    c = (0.955 - mean) / (1 - mean)
    r[n - pairs :] = c * r[:pairs] + (1 - c * c) ** 0.5 * other
    x = mean**0.5 * base + (1 - mean) ** 0.5 * r
    near = np.triu(x @ x.T >= 0.95, 1)
    got = {q.vec_id: q.n_links for q in embedding_dedup.link_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    want = near.sum(axis=0) + near.sum(axis=1)
    assert pairs <= near.sum() and all(got[i] <= want[i] for i in range(n)) and sum(got.values()) >= 0.97 * want.sum()


def test_no_vectors(spark):
    assert embedding_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(199)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges, "t").collect()}
    assert {got[i] for i in range(200)} == {0} and got[501] == got[500] == 500


# 3 -------------------------------------------------------------------------------------------
def test_language_accuracy_on_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(d, crc_mod("doc_id", 4) == 2)
    held = got.where("held_out").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_scores_against_plain_kernels(spark):
    """Few rows: all of them are landmarks and training rows, and the kernel can be written down."""
    rng = random.Random(33)
    words = {"en": ["the", "and", "with", "house"], "de": ["der", "und", "mit", "Haus"], "ru": ["дом", "и", "с", "кот"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(6)) + rng.choice(["!", " 7"]), k) for i, k in enumerate(list(words) * 8)]
    rows += [(100, "the cat", None), (101, "кот кот", None), (102, "Straße und", None), (103, "zzz", None), (104, "the cat", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(False)).collect()}

    def grams(t):
        s = "".join(c if c.isalpha() else "." for c in t.lower())
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    sets, train = {i: grams(t) for i, t, _ in rows}, [r for r in rows if r[2]]
    langs = sorted(words)
    k = lambda a, b: len(sets[a] & sets[b]) / math.sqrt(len(sets[a]) * len(sets[b]))
    own = np.array([[k(a, b) for b, _, _ in train] for a, _, _ in train])
    value, vector = np.linalg.eigh(own)
    large = value > 1e-6 * value.max()
    half = vector[:, large] / np.sqrt(value[large])
    z = own @ half
    y = np.array([[r[2] == x for x in langs] for r in train], dtype=float)
    w = np.linalg.solve(z.T @ z + 1e-3 * np.trace(z.T @ z) / z.shape[1] * np.eye(z.shape[1]), z.T @ y)
    for i, t, _ in rows:
        s = np.array([k(i, b) for b, _, _ in train]) @ half @ w
        assert got[i].lang_pred == langs[int(s.argmax())] and got[i].score == pytest.approx(min(1, max(0, s.max())), abs=1e-4)


def test_language_edge_cases(spark):
    texts = ["the cat and the hat", "der Hund und die Katze", None, "", "5² 10½ Ⅷ 3 !?", "the cat " * 200_000]
    rows = [(i, t, "de" if i == 1 else "en", "clash") for i, t in enumerate(texts)] + [(0, texts[0], "en", "clash"), (None, texts[0], "en", "clash")] + [(50 + i, f"the and {i}", "en", "x") for i in range(9)] + [(70 + i, f"der und {i}", "de", "x") for i in range(9)]
    every = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), F.lit(False)).collect()
    got = {r.doc_id: r for r in every}
    assert len(every) == len(rows) and len({(r.lang_pred, r.score) for r in every if r.doc_id in (0, None)}) == 1  # repeated rows are judged alike
    assert [got[i].lang_pred for i in range(6)] == ["en", "de", "und", "und", "und", "en"]
    empty = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")
    assert language_id.identify(empty, F.lit(False)).first().lang_pred == "und"
    assert language_id.identify(empty.where("false"), F.lit(False)).count() == 0
    same = spark.createDataFrame([(None, "the same text", "en")] * 1000, "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score > 0.5) for r in language_id.identify(same, F.lit(False)).collect()} == {("en", True)}


# 4 -------------------------------------------------------------------------------------------
def test_archive_round_trip(spark, tmp_path):
    html = ["<p>é</p>", "<p>é</p>", None, "", "a\r\n\r\nWARC/1.1\r\nb", "<p>é</p>", "x" * 300_000]
    pages = spark.createDataFrame([(10 - i, f"http://h/{i}\r\nX: y" if i else None, h, b"k") for i, h in enumerate(html)], "page_id long, url string, html string, payload binary")
    folder = f"file://{tmp_path}/a"
    warc.write_archive(pages, folder)
    got = {r.page_id: r for r in warc.read_archive(spark, folder).collect()}
    whole = {r.page_id: r for r in warc.reconstruct(spark, folder).collect()}
    first = {}
    for i, h in sorted(((10 - i, h) for i, h in enumerate(html))):
        raw = (h or "").encode()
        lead = first.setdefault(raw, i)
        r = got[i]
        assert r.verified and r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if lead == i else ("revisit", lead))
        assert bytes(whole[i].payload) == raw
        ((head, block),) = warc.parse_records([bytes(whole[i].record)])
        assert head["WARC-Payload-Digest"] == f"sha1:{r.payload_digest}" and block.split(b"\r\n\r\n", 1)[1] == (raw if lead == i else b"")
    assert spark.read.parquet(f"{folder}/payloads").count() == len(first)
    warc.export_files(spark, folder, f"file://{tmp_path}/w", compression="none")
    found = [h for p in (tmp_path / "w").glob("part-*") for h, _ in warc.parse_records([p.read_bytes()])]
    assert sorted(h["WARC-Record-ID"] for h in found) == sorted(f"<urn:page:{i}>" for i in got)


def test_archive_of_hostile_urls_and_null_ids(spark, tmp_path):
    urls = ["x://h/WARC-Refers-To: <urn:page:99>", "x://h/\r\nWARC-Refers-To: <urn:page:98>\r\n\r\nHTTP/1.1 Content-Length: 5", "x://h/WARC-Payload-Digest: sha1:AAAA", "x:\0\t y"]
    pages = spark.createDataFrame([(i, u, f"body {i}", 0) for i, u in enumerate(urls)] + [(None, "u", "body 1", 0), (None, None, "alone", 0), (7, "u", "", 0), (7, "u", "", 0)], "page_id long, url string, html string, verified int")
    folder = f"file://{tmp_path}/a"
    warc.write_archive(pages, folder)
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.verified) for r in warc.read_archive(spark, folder).collect())
    assert got == [*((str(i), "response", None, True) for i in range(4)), ("7", "response", None, True), ("7", "response", None, True), ("None", "response", None, True), ("None", "revisit", 1, True)]
    for r in warc.reconstruct(spark, folder).collect():
        ((head, block),) = warc.parse_records([bytes(r.record)])
        assert len(block) == int(head["Content-Length"]) and len(head) == (7 if r.record_type == "response" else 9)
    warc.write_archive(pages.where("false"), f"file://{tmp_path}/b")
    assert warc.read_archive(spark, f"file://{tmp_path}/b").count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    warc.write_archive(pages, f"file://{tmp_path}/a", least_bytes=3)
    assert sorted((r.page_id, r.record_type) for r in warc.read_archive(spark, f"file://{tmp_path}/a").collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


# 5 -------------------------------------------------------------------------------------------
def brute_links(texts):
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in ((t or "").lower().split() for t in texts)]
    near = [[i != j and bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) - 1e-12 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min([label[i], *[label[j] for j in range(len(texts)) if near[i][j]]]) for i in range(len(texts))]
    return near, label


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(5)
    texts = [prose(rng, 120) for _ in range(40)]
    near = texts[0].split()
    for _ in range(150):  # a large group of near copies
        t = list(near)
        t[rng.randrange(len(t))] = "edit" + rng.choice(WORDS)
        texts.append(" ".join(t))
    shared = prose(rng, 30)  # a passage in many documents that are else different
    texts += [f"{prose(rng, 40)} {shared} {prose(rng, 40)}" for _ in range(150)]
    texts += [texts[1], texts[1].upper(), "one two", "one two", "", None, " \n", "a b c d"]
    near_, label = brute_links(texts)
    got = {r.doc_id: r for r in jaccard_join.join(docs_of(spark, texts), small=8, block=16).collect()}
    assert [got[i].n_links for i in range(len(texts))] == [sum(x) for x in near_]
    assert [got[i].class_id for i in range(len(texts))] == label
    assert all(got[i].kept == (label[i] == i) for i in range(len(texts)))


def test_jaccard_join_finds_pairs_behind_a_common_template(spark):
    """Large mixed buckets are split many times; pairs near the threshold must survive that."""
    rng = random.Random(55)
    template = prose(rng, 60)
    texts = []
    for _ in range(300):
        own = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(40)]
        texts.append(f"{template} {' '.join(own)}")
        own[rng.randrange(5, 35)] = "edit" + rng.choice(WORDS)  # five of 96 shingles change
        own[rng.randrange(5, 35)] = "other" + rng.choice(WORDS)
        texts.append(f"{template} {' '.join(own)}")
    near, label = brute_links(texts)
    got = {r.doc_id: r for r in jaccard_join.join(docs_of(spark, texts), small=8).collect()}
    found, there = sum(got[i].n_links for i in range(len(texts))), sum(map(sum, near))
    assert there > 500 and found >= 0.999 * there and all(got[i].n_links <= sum(near[i]) for i in range(len(texts)))


def test_jaccard_join_looks_up_members_of_large_buckets_once(spark, monkeypatch):
    """Of the rows of each level one join asks for size and agreement; shapes are for buckets of a block or more."""
    rng = random.Random(56)
    near = prose(rng, 120).split()
    texts = []
    for _ in range(300):  # near copies in buckets that are large, some alike and some to be split
        t = list(near)
        for _ in range(rng.choice([1, 2, 3])):
            t[rng.randrange(len(t))] = "edit" + rng.choice(WORDS)
        texts.append(" ".join(t))
    near_, label = brute_links(texts)
    looked_up = {}

    def counted(rows, dim, keys, by, how="inner"):
        joined = hot_join(rows, dim, keys, by, how)
        looked_up.setdefault(how, []).append(joined.count())
        return joined

    hot_join = jaccard_join.hot_join
    monkeypatch.setattr(jaccard_join, "hot_join", counted)
    got = {r.doc_id: r for r in jaccard_join.join(docs_of(spark, texts), small=32, block=400).collect()}
    assert len(looked_up["inner"]) > 1 and sum(looked_up["left"]) == 0  # no bucket of 300 texts has a block
    found, there = sum(got[i].n_links for i in range(len(texts))), sum(map(sum, near_))
    assert found >= 0.999 * there and all(got[i].n_links <= sum(near_[i]) for i in range(len(texts)))
    assert [got[i].class_id for i in range(len(texts))] == label


def test_jaccard_join_of_odd_tables(spark):
    assert jaccard_join.join(docs_of(spark, ["x"]).where("false")).count() == 0
    long_ = prose(random.Random(2), 200_000)
    got = jaccard_join.join(docs_of(spark, ["a b c d e f", "a b c d e f", "zz yy xx ww vv", "q", long_, long_ + " more"], [1, 1, 2, None, 3, 4])).collect()
    assert sorted((r.doc_id, r.n_links, r.class_id) for r in got) == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3)]


# 6 -------------------------------------------------------------------------------------------
def lm_tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    return [*low.split(), class_lm.END]


@pytest.mark.parametrize("head", [3, 50, 50_000])
def test_class_model_against_brute_force(spark, head):
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(120)] + ["", None, "A\u00a0b  C\tÄ", "unheardof words"]
    d = docs_of(spark, [*texts, texts[0]], [*range(len(texts)), 0])
    bounds = dict(classes=4, clustered=min(20, head), groups=5, classed=min(60, head), head=head)
    got = {r.doc_id: r for r in class_lm.score(d, crc_mod("doc_id", 10) == 0, **bounds).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    rows = [lm_tokens(t) for t in texts]
    train = [rows[i] for i in range(len(texts)) if not held[i]] + ([rows[0]] if not held[0] else [])
    c = Counter(w for row in train for w in row)
    n, v = sum(c.values()), len(c)
    for i, row in enumerate(rows):
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in row)
        assert got[i].held_out == held[i] and got[i].n_tokens == len(row) and got[i].n_known == sum(c[w] > 0 for w in row) and got[i].train_tokens == n
        assert got[i].base_score == pytest.approx(base)

    # the model by plain counting, with the classes of exchange()
    ranked = sorted((w for w in c if w != class_lm.END), key=lambda w: (-c[w], w))[:head]
    single = ranked[: bounds["clustered"]]
    unit = lambda w: single.index(w) if w in single else len(single) + 5 if w == class_lm.END else len(single) + class_lm.ending(w, 5)
    big = np.zeros((len(single) + 6, len(single) + 6), dtype=np.int64)
    for row in train:
        for a, b in zip([class_lm.END, *row], row):
            big[unit(a), unit(b)] += 1
    k = min(4, len(single) + 5)
    label = class_lm.exchange(big, k)
    of = {w: label[unit(w)] for row in rows for w in row}
    follow = np.zeros((k + 1, k + 1))
    for i, j in np.ndindex(*big.shape):
        follow[label[i], label[j]] += big[i, j]
    given = follow + 0.5
    fit = np.log(given / given.sum(1, keepdims=True))[:, :k] - np.log(given.sum(0) / given.sum())[None, :k]
    moved = {}
    for w in ranked[len(single) : bounds["classed"]]:
        moved[w] = int(sum(fit[of[a]] for row in train for a, b in zip([class_lm.END, *row], row) if b == w).argmax())
    of |= moved
    links = np.full((k + 1, k + 1), 0.1)
    for row in train:
        for a, b in zip([class_lm.END, *row], row):
            links[of[a], of[b]] += 1
    mass, size = Counter(), Counter()
    for w in c:
        mass[of[w]] += c[w]
        size[of[w]] += 1
    for i, row in enumerate(rows):
        p = sum(math.log10(links[of[a], of[b]] / links[of[a]].sum()) + (0 if b == class_lm.END else math.log10((c[b] + 0.1) / (mass[of[b]] + 0.1 * (size[of[b]] + 1)))) for a, b in zip([class_lm.END, *row], row))
        assert got[i].score == pytest.approx(p)


def test_class_model_of_a_very_long_text(spark):
    long_ = "alpha beta  gamma\n" * 260_000  # more than one piece
    got = {r.doc_id: r for r in class_lm.score(docs_of(spark, ["alpha beta", "beta gamma gamma", long_, long_ + "delta"]), F.col("doc_id") > 1).collect()}
    c, n, v = {"alpha": 1, "beta": 2, "gamma": 2, class_lm.END: 2}, 7, 4
    one = lambda w: math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1)))
    base = 260_000 * sum(map(one, ("alpha", "beta", "gamma"))) + one(class_lm.END)
    assert (got[2].n_tokens, got[2].n_known, got[2].train_tokens) == (780_001, 780_001, 7) and got[2].base_score == pytest.approx(base)
    assert (got[3].n_tokens, got[3].n_known) == (780_002, 780_001) and got[3].base_score == pytest.approx(base + one("delta"))
    assert got[3].score < got[2].score < 0


def test_class_model_without_training_rows(spark):
    got = class_lm.score(docs_of(spark, ["a b", None]), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)
    assert class_lm.score(docs_of(spark, ["a"]).where("false"), F.lit(True)).count() == 0


def test_unbroken_long_texts_are_rated_soon():
    import time

    begun = time.time()
    for text in ("A" * 1_000_000, "aB3/" * 300_000, "x#$%" * 200_000, "you " + "y" * 500_000, "a*" * 300_000, "ab### " * 100_000):
        toxicity.features(text)
    assert time.time() - begun < 20
    assert "x:symbols" in toxicity.features("so ab### cd$$$, ef%%%. x") and "x:symbols" not in toxicity.features("ab### cd ef%%%")


# 7 -------------------------------------------------------------------------------------------
def ideal(sizes, weights, slots):
    """Blocks that each source should have had by the end of each slot: shared by weight among those with blocks left."""
    had, out, t = {s: Fraction(0) for s in sizes}, [], Fraction(0)
    while len(out) < slots:
        live = [s for s in sizes if had[s] < sizes[s]]
        total = sum(Fraction(weights[s]) for s in live)
        step = min([Fraction(len(out) + 1) - t, *[(sizes[s] - had[s]) * total / Fraction(weights[s]) for s in live]])
        for s in live:
            had[s] += step * Fraction(weights[s]) / total
        t += step
        if t == len(out) + 1:
            out.append(dict(had))
    return out


def check_mix(got, block, weights):
    """All full blocks are in the mix, one in each slot, inside their windows, and each source is within a block of its target."""
    full = Counter(r.source for r in got)
    full = {s: n // block for s, n in full.items() if weights.get(s, 0) > 0 and n >= block}
    mixed = sorted((r for r in got if r.in_mix), key=lambda r: r.mix_pos)
    assert [r.mix_pos for r in mixed] == list(range(block * sum(full.values())))
    assert all(r.mix_slot == r.mix_pos // block and r.release <= r.mix_slot < r.deadline for r in mixed)
    done, target = Counter(), ideal(full, weights, len(mixed) // block)
    for t, r in enumerate(mixed[::block]):
        assert {x.source for x in mixed[t * block : (t + 1) * block]} == {r.source}
        done[r.source] += 1
        assert all(abs(done[s] - target[t][s]) < 1 for s in full)
    behind = [r for r in got if not r.in_mix and r.mix_slot is not None]
    assert all(r.mix_slot >= len(mixed) // block and r.release is None for r in behind) and len({r.mix_pos for r in mixed + behind}) == len(mixed + behind)


def test_every_prefix_is_within_a_block_of_target(spark):
    sizes = {"a": 700, "b": 90, "c": 40, None: 30}
    rows = [(i, s) for i, s in enumerate(x for x, n in sizes.items() for _ in range(n))]
    d = spark.createDataFrame([(i, s, 1) for i, s in rows] + [(5000, "z", 1)], "doc_id long, source string, release int")
    w = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 1.0), (None, 1.0), ("z", 0.0)], "source string, weight double")
    got = mixing.mix(d, w, block=4, cycle=40).collect()
    assert len(got) == len(rows) + 1 and len({r.doc_id for r in got}) == len(got) and all(r.release_given == 1 for r in got)
    slots = {r.source: r.slots for r in mixing.whole_weights(w, 40).collect()}
    assert sum(slots.values()) == 40 and all(abs(n - w * 40 / 10) < 2 for n, w in zip((slots[s] for s in ("a", "b", "c", None)), (5, 3, 1, 1)))
    check_mix(got, 4, slots)
    assert [(r.in_mix, r.mix_slot) for r in got if r.source == "z"] == [(False, None)]
    assert mixing.mix(d.where("false"), w).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 5000, "b": 300, "c": 2}, {"a": 2000, "b": 2000, "c": 2}, {"a": 3}, {"a": 40, "b": 40, "c": 41, "d": 400, "e": 7}])
def test_small_and_ended_sources_leave_their_share(spark, sizes):
    d = spark.createDataFrame([(i, s) for i, s in enumerate(x for x, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    weights = {s: 1 + k for k, s in enumerate(sizes)} | {"none": 3}  # a weighted source without a row
    w = spark.createDataFrame([(s, float(x)) for s, x in weights.items()], "source string, weight double")
    got = mixing.mix(d, w).collect()
    assert len(got) == sum(sizes.values()) and sum(r.in_mix for r in got) == sum(n // 4 * 4 for n in sizes.values())
    # the given weights are rounded to whole numbers as fine as 64 bits allow: far below what this compares
    check_mix(got, 4, weights)


def test_deviation_from_the_given_weights_does_not_grow(spark):
    hot = {"hot": (1000.0, 260), **{f"s{i:02}": (1e5**0.5, 70) for i in range(19)}}
    many = {f"s{i:04}": (1.0 + i % 7 / 3, 3) for i in range(900)}
    for sizes in (hot, many):
        d = spark.createDataFrame([(i, s) for i, s in enumerate(x for x, (_, n) in sizes.items() for _ in range(n))], "doc_id long, source string")
        w = spark.createDataFrame([(s, w) for s, (w, _) in sizes.items()], "source string, weight double")
        got = mixing.mix(d, w, block=1).collect()
        mixed = sorted(got, key=lambda r: r.mix_pos)
        assert all(r.in_mix for r in got) and [r.mix_slot for r in mixed] == list(range(len(mixed)))
        total = sum(w for w, _ in sizes.values())
        first = min(n * total / w for w, n in sizes.values())  # up to here no source has ended
        done = Counter()
        for t, r in enumerate(mixed):
            assert r.release <= r.mix_slot < r.deadline
            done[r.source] += 1
            assert t >= first - 1 or all(abs(done[s] - (t + 1) * w / total) < 1 for s, (w, _) in sizes.items())


def test_mix_keeps_columns_of_any_name(spark):
    names = ["slots", "nth", "at", "cycle", "a", "total", "n", "_k", "_src", "_all", "x y", "release"]
    rows = [(i if i % 7 else None, f"s{i % 3}", *[f"{n}{i}" for n in names]) for i in range(60)] * 2
    d = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in ["doc_id", "source", *names]).replace("`doc_id` string", "doc_id long"))
    got = mixing.mix(d, mixing.flattened_weights(d)).collect()
    assert sorted(str(r["doc_id"]) + r["at"] + r["x y"] for r in got) == sorted(str(r[0]) + r[4] + r[12] for r in rows)
    assert sorted(r["mix_pos"] for r in got if r["in_mix"]) == list(range(sum(r["in_mix"] for r in got))) and len({r["mix_pos"] for r in got}) == 120
    assert all(isinstance(r["release"], int) == r["in_mix"] and r["release_given"].startswith("release") for r in got)


def test_stretches_of_slots_are_one_schedule(spark):
    shares = spark.createDataFrame([("a", 501, 900), ("b", 250, 1200), ("c", 200, 300), ("d", 31, 80), ("e", 18, 20)], "source string, a long, full long")
    cut, whole = ([tuple(r) for r in mixing.schedule(shares, n).orderBy("at").collect()] for n in (1, 2500))
    assert cut == whole and [r[2] for r in whole] == list(range(2500))


# 8 -------------------------------------------------------------------------------------------
def brute_removed(texts, length):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(8)
    passage, other = prose(rng, 40), prose(rng, 12)
    texts = [prose(rng, 60) + passage + prose(rng, 60), passage[:-3] + prose(rng, 20) + passage, other + "é" + passage[5:] + other, None, "", "z" * 450, "zy" * 200, other, other, prose(rng, 30) * 3, passage[:99], passage[:99], passage[7:107]]
    texts += [prose(rng, 30) + passage[k : k + 150] + prose(rng, 30) for k in range(0, 60, 7)]
    got = {r.doc_id: r for r in suffix_dedup.digests(docs_of(spark, texts)).collect()}
    expected = brute_removed(texts, 100)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == expected
    kept = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    assert [(hashlib.sha256(kept[i].kept).hexdigest(), len(kept[i].spans)) for i in range(len(texts))] == [(e[3], e[2]) for e in expected]


def test_repeats_of_hot_grams(spark, monkeypatch):
    """A passage in most documents, cut at many places: its grams are split by the strings around them."""
    rng = random.Random(88)
    passage = prose(rng, 60)
    texts = [prose(rng, 10) + passage[rng.randrange(0, 200) : rng.randrange(330, len(passage))] + prose(rng, 10) for _ in range(300)] + [prose(rng, 50) for _ in range(20)] + ["ab" * 300, passage]
    seen = []
    monkeypatch.setattr(suffix_dedup, "HOT", 1 << 40)
    whole = suffix_dedup._hot_repeats
    monkeypatch.setattr(suffix_dedup, "_hot_repeats", lambda placed, hot, length: seen.append(len(hot)) or whole(placed, hot, length))
    got = {r.doc_id: r for r in suffix_dedup.digests(docs_of(spark, texts), hot_rows=100).collect()}
    assert seen and seen[0] > 5
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == brute_removed(texts, 100)


def test_repeats_in_a_very_long_text(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)  # parts overlap in this process only
    b = np.frombuffer((prose(rng, 400) + "q" * 130 + prose(rng, 300)).encode(), np.uint8)
    whole = suffix_dedup.anchors(b, np.full(len(b), len(b)), 100)[0]
    parts = set()
    for i, j, s, e in suffix_dedup._pieces(np.array([0, len(b)]), 100):
        parts |= set((suffix_dedup.anchors(b[s:e], np.full(e - s, e - s), 100)[0] + s).tolist())
    assert parts == set(whole.tolist())


def test_repeats_in_odd_tables(spark):
    assert suffix_dedup.remove_repeats(docs_of(spark, ["x"]).where("false")).count() == 0
    long_ = prose(random.Random(1), 30)
    got = suffix_dedup.digests(docs_of(spark, [long_, long_, "b", long_], [None, 3, 3, 2])).collect()
    assert sorted((str(r.doc_id), r.n_removed > 0) for r in got) == [("2", True), ("3", False), ("3", False), ("None", False)]


def test_refinement_sorts_and_gives_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, d = 40, 9
        rows, block = rng.integers(0, 3, (n, d)).astype(np.uint8), np.sort(rng.integers(0, 4, n))
        order, prefix, _ = suffix_dedup.refine(block, rows)
        keys = [(block[i], *rows[i].tolist()) for i in order]
        assert keys == sorted(keys)
        for k in range(1, n):
            a, b = keys[k - 1], keys[k]
            same = next((x for x in range(d + 1) if a[x] != b[x]), d + 1) - 1
            assert prefix[k] == same


# 9 -------------------------------------------------------------------------------------------
def test_leaks_with_other_values(spark):
    item = "Today Tom has 3 apples and then Tom buys 5 km of rope for his red boat today near the old mill"
    bench = spark.createDataFrame([(7, item, "x"), (8, "too short", "x"), (9, None, "x")], "item_id long, text string, doc_id string")
    reworded = item.replace("Tom", "Ann").replace("3", "40").replace("5 km", "6 miles")
    crossed = reworded.replace("Ann buys", "Bob buys")
    texts = [f"before it. {item} and after", f"Some words. {reworded}.", crossed, None, "", "nothing here of that kind", "filler " * 3000 + ". " + item, item]
    got = {(r.doc_id, r.item_id): r.reworded for r in decontaminate.find_leaks(docs_of(spark, texts), bench).collect()}
    assert got == {(0, 7): False, (1, 7): True, (6, 7): False, (7, 7): False}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs_of(spark, texts), bench, local_index=0).collect()} == set(got)
    assert decontaminate.find_leaks(docs_of(spark, texts), bench.where("false")).count() == 0


def test_leaks_with_longer_values_and_inserted_words(spark):
    rng = random.Random(99)
    plain = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(36)]
    item = " ".join([*plain[:12], "Boston", *plain[12:24], "3", *plain[24:]])
    bench = spark.createDataFrame([(7, item), (8, "alpha beta New York")], "item_id long, text string")
    longer = item.replace("3", "twenty five").replace("Boston", "New York")
    inserted, missing = (" ".join([*item.split()[:19], *w, *item.split()[k:]]) for w, k in ((["indeed"], 19), ([], 20)))
    texts = [longer, inserted, missing, "so it is. " + longer + " and on. " + inserted, " ".join(item.split()[:14]), item, "we saw alpha beta New York there", "filler 7 8 9 " * 30 + inserted]
    got = {(r.doc_id, r.item_id): (r.reworded, r.coverage) for r in decontaminate.find_leaks(docs_of(spark, texts), bench).collect()}
    assert set(got) == {(0, 7), (1, 7), (2, 7), (3, 7), (5, 7), (6, 8), (7, 7)}
    assert got[0, 7] == (True, 1.0) and not got[1, 7][0] and not got[2, 7][0] and not got[6, 8][0]
    assert 0.7 < got[1, 7][1] < 1 and 0.7 < got[2, 7][1] < 1


def test_leaks_in_other_case_and_odd_rows(spark):
    rng = random.Random(98)
    plain = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(30)]
    item = " ".join(["How", *plain[:9], "Boston", *plain[9:20], "Mary Ann", *plain[20:], "42 km"])
    bench = spark.createDataFrame([(7, item), (7, item), (9, ""), (None, "x y z")], "item_id long, text string")
    other = " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(400))
    texts = [item.lower(), f"{other} {item.upper()}. {other}", other, item.replace("Boston", "Paris"), f"{other[:900]} {item.lower()} {other}" * 40, item.lower().replace("42 km", "7 miles"), item]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, item, "x"), (20, None, "x")]
    got = {(r.doc_id, r.item_id): r.reworded for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string, h string"), bench).collect()}
    assert got == {(0, 7): False, (1, 7): False, (3, 7): True, (4, 7): False, (5, 7): True, (6, 7): False}


def test_straight_leaks_against_brute_force(spark):
    """Templates by regular expressions, windows and alignments by plain loops."""
    import re

    rng = random.Random(97)
    names, vocabulary = ["Tom", "Ann", "Boston"], [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(60)]
    word = lambda: rng.choice([rng.choice(vocabulary)] * 7 + [rng.choice(names), str(rng.randrange(40)), f"{rng.randrange(40)} km"])
    sentence = lambda n: " ".join([rng.choice(vocabulary), *(word() for _ in range(n))]) + "."
    items = [sentence(rng.randrange(6, 25)) for _ in range(12)]
    docs = []
    for i in range(80):
        a, swap = rng.choice(items), dict(zip(names, rng.sample([*names, "Paris", "Eve"], 3)))
        a = " ".join(swap.get(w, w) for w in a.split()) if i % 3 else a
        a = a.lower() if i % 4 == 0 else a
        docs.append(f"{sentence(20)} {a[: rng.randrange(len(a) // 3, len(a) + 1)]} {sentence(9)}" if i % 5 else sentence(40))

    def template(text, folded):
        raw = [(m.group(), m.start()) for m in re.finditer(r"\d+|[a-zA-Z]+", text)]
        out, run = [], None
        for k, (w, at) in enumerate(raw):
            opens = k == 0 or "." in text[raw[k - 1][1] : at]
            unit = w.lower() == "km" and k > 0 and raw[k - 1][0].isdigit()
            kind = "#" if w.isdigit() else "u" if unit else "n" if not folded and w[0].isupper() and not opens else ""
            if kind and kind == run and not opens:
                out[-1][1] += " " + w.lower()
            else:
                out.append([kind, w.lower()])
            run = kind
        return out

    def straight(doc, item):
        best = 0
        for folded in (False, True):
            d, b = template(doc, folded), template(item, folded)
            size = min(8, len(b))
            if size < 4:
                continue
            shape = lambda x: [k or v for k, v in x]
            sd, sb = shape(d), shape(b)
            for shift in range(-len(b), len(d)):
                values, hits, sound = {}, 0, True
                for at in range(len(b) - size + 1):
                    if 0 <= at + shift <= len(d) - size and sb[at : at + size] == sd[at + shift : at + shift + size]:
                        hits += 1
                        for k in range(size):
                            if b[at + k][0]:
                                sound &= values.setdefault(tuple(b[at + k]), d[at + shift + k][1]) == d[at + shift + k][1]
                if sound:
                    best = max(best, hits / (len(b) - size + 1))
        return best

    want = {(i, j): c for i, d in enumerate(docs) for j, x in enumerate(items) if (c := straight(d, x)) >= 0.5}
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.find_leaks(docs_of(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert len(want) > 12 and set(want) <= set(got) and all(got[k] >= c - 1e-9 for k, c in want.items())
    # beyond the straight alignments there are only chains, and those cover half of an item too
    assert len(set(got) - set(want)) <= 0.25 * len(want) and all(c >= 0.5 for c in got.values())


def test_chains_keep_order_and_values():
    a, b = (0, [0, 1, 2], [(2, "tom", "ann")]), (1, [6, 7], [(2, "tom", "ann")])
    assert decontaminate._chain([a, b]) == (5, True)
    assert decontaminate._chain([a, (1, [6, 7], [(2, "tom", "bob")])]) == (3, True)
    assert decontaminate._chain([a, (-7, [6, 7], [])]) == (3, True)


def test_template_words():
    found = decontaminate._joined([decontaminate.lower(t) for t in ("Tom paid 3,500.50 km. Then É 5 % of five miles, m", "“Ann” Élan, x.y 7kg")], decontaminate.Canon()).template(decontaminate.PLAIN)
    got = [(found.value(i), int(k), int(t)) for i, (k, t) in enumerate(zip(found.kinds, found.text))]
    assert got == [("tom", 0, 0), ("paid", 0, 0), ("3,500.50", 1, 0), ("km", 3, 0), ("then", 0, 0), ("é", 2, 0), ("5", 1, 0), ("%", 3, 0), ("of", 0, 0), ("five", 1, 0), ("miles", 3, 0), ("m", 0, 0),
                   ("ann", 0, 1), ("élan", 2, 1), ("x", 0, 1), ("y", 0, 1), ("7kg", 0, 1)]


def test_long_texts_are_coded_alike_in_parts(monkeypatch):
    text = " ".join(f"Word{i % 7} and {i} km. Then Bob" for i in range(300))
    canon = decontaminate.Canon()
    ways = [decontaminate.JOINED, decontaminate.PLAIN, decontaminate.FOLDED]
    whole = {way: found for way, found, _, _, _ in decontaminate._pieces([text], canon, ways, 7)}
    monkeypatch.setattr(decontaminate, "PIECE", 500)
    for way in ways:
        parts = list(decontaminate._pieces([text], canon, [way], 7))
        assert len(parts) > 5
        for _, found, _, word, goes_on in parts:
            skip = 1 if goes_on else 0
            assert (found.codes[skip:] == whole[way].codes[word + skip : word + len(found.codes)]).all()
        assert parts[-1][3] + len(parts[-1][1].codes) == len(whole[way].codes)


# 10 ------------------------------------------------------------------------------------------
def test_toxicity_separates_held_out_texts(spark):
    rng = random.Random(10)
    bad = ["moron", "scum", "idiot", "trash"]
    texts, toxic = [], []
    for i in range(600):
        words = prose(rng, 40).split()
        toxic.append(int(i % 4 == 0))
        if toxic[-1]:
            for w in rng.sample(bad, 2):
                words.insert(rng.randrange(len(words)), w)
        texts.append(" ".join(words))
    flipped = [1 - t if rng.random() < 0.03 else t for t in toxic]
    d = docs_of(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(flipped)] + [(3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.rate(d, labels, crc_mod("doc_id", 5) == 0).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert sum(got[i].predicted == toxic[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and got[600].predicted == 0
    # a small sample, drawn by label, and features counted over all rows still do
    few = {r.doc_id: r for r in toxicity.rate(d, labels, crc_mod("doc_id", 5) == 0, rows=120).collect()}
    assert sum(few[i].predicted == toxic[i] for i in held) >= 0.95 * len(held)
    long_ = docs_of(spark, [prose(rng, 150_000), prose(rng, 150_000) + " you moron scum", "a", "a"], [1000, 1001, 5, 5])
    odd = toxicity.rate(d.unionByName(long_), labels, crc_mod("doc_id", 5) == 0).collect()
    by_id = {r.doc_id: r.score for r in odd}
    assert by_id[1001] > by_id[1000] and len({r.score for r in odd if r.doc_id == 5}) == 2
    assert {r.score for r in toxicity.rate(d, labels.where("false"), F.lit(False)).collect()} == {0.0}
    assert toxicity.rate(d.where("false"), labels.where("false"), F.lit(False)).count() == 0


def test_correlated_voters_count_for_less():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    fire = lambda a, b: np.where(y, rng.random(4000) < a, rng.random(4000) < b)
    one = fire(0.6, 0.2)
    votes = np.stack([fire(0.8, 0.05), fire(0.7, 0.1), one, one ^ (rng.random(4000) < 0.02)], axis=1).astype(float)
    p, rates, share = toxicity.label_model(votes, (y ^ (rng.random(4000) < 0.1)).astype(float))
    assert ((p > 0.5) == y).mean() > 0.93 and share[2] < 0.75 < share[0]  # a tenth of the labels was wrong
    few = np.r_[np.flatnonzero(y), np.flatnonzero(~y)[:400]]  # clean rows drawn thinner and weighted back
    weight = np.where(y[few], 1.0, (~y).sum() / 400)
    q, again, _ = toxicity.label_model(votes[few], y[few].astype(float), weight)
    assert ((q > 0.5) == y[few]).mean() > 0.93 and abs(again[1, 0] - 0.05) < 0.05
    assert abs(rates[0, 0] - 0.8) < 0.1 and abs(rates[1, 0] - 0.05) < 0.05
