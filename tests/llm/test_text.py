"""BPE, HTML, language, quality and mixing."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import zlib
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, html, langid, mixing, quality

# BPE


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(bpe.default_vocabulary())


def check_bpe(reference, texts):
    ours = bpe.load(bpe.default_vocabulary())
    got = ours.encode_batch(texts)
    for t, ids in zip(texts, got):
        want = reference.encode(t or "", add_special_tokens=False).ids
        assert ids == want
        assert ours.decode(ids) == reference.decode(want, skip_special_tokens=False) == (t or "")


def test_bpe_odd(reference):
    rng = random.Random(1)
    texts = [None, "", "a", " ", "\n\n  x", "aaaa" * 500, "x<|endoftext|>y", " <|endoftext|> ", "<|endoftext|><|endoftext|>", "don't we'll", "日本語🙂é", "ß" * 50, "\x00\x01", "     ", "ab" * 3000, "<|endof"]
    texts += ["".join(rng.choice("abcdefghé 🙂\n1,.!'") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    check_bpe(reference, texts)


def test_bpe_memo_is_bounded(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    for t in ("one two three four five six seven eight nine ten eleven twelve", "again one<|endoftext|>two"):
        check_bpe(reference, [t])


def test_bpe_long_pieces(reference, monkeypatch):
    """Trees on lists and trees in step give the same ids; a piece of hundreds of thousands of letters takes seconds."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (1, 2, 3, 50, 700, 5000)] + ["ab" * 900, "a" * 4000, "é" * 777]
    ours = bpe.load(bpe.default_vocabulary())
    assert [ours.merge([w.encode()])[0] for w in words] == [ours.merge_one(w.encode()) for w in words]
    check_bpe(reference, ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)), "-" * 300_000])
    assert max(map(len, ours.memo)) <= bpe.LONG
    monkeypatch.setattr(bpe, "MEMO_CHARS", 40)
    for t in ("one two three four five six seven", "eight nine one two ten eleven twelve", "seven one"):
        check_bpe(reference, [t])


def test_bpe_queries(spark, odd, nothing, reference):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(odd).collect()}
    want = set()
    for r in odd.collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == want
    assert sorted((r.doc_id, r.text) for r in bpe.decode(bpe.encode(odd)).collect()) == sorted((r.doc_id, r.text or "") for r in odd.collect())
    assert bpe.round_trip(nothing).count() == 0


# HTML

ARTICLE = """<html><head><title>t</title></head><body class="has-sidebar"><header><h1>Site</h1><div>Tagline of the site, long enough to look like prose text.</div></header>
<div class="cookie-notice"><p>We use cookies to make this site work better for you and all others. Accept.</p></div><div id="menu"><a href=x>Home</a> <a href=y>News</a></div>
<main><article><header><h1>Title &amp; more</h1></header><p>First para with <a href=z>link</a> and <b>bold</b>&nbsp;text.</p><div class="ad">Buy now! This is a long advert text that looks like prose.</div>
<p>Short.</p><form><input><label>Email</label></form><script>var t="</p>";</script><ul><li>one<li>two</ul></article>
<section id="comments"><h2>Comments</h2><p>I think this is a great article and I want to say that at length.</p></section></main><aside><p>Related stories are here for all to see, in long sentences.</p></aside><footer>&copy; x</footer>"""


def test_main_text():
    assert html.main_text(ARTICLE) == "Title & more\nFirst para with link and bold text.\nShort.\none\ntwo"
    prose = "Long prose sentence here, with words. " * 6
    soup = f"<body><div class=top><a href=1>a</a> | <a href=2>b</a></div><div><p>{prose}</p><p>Short one.</p><p>{prose}</p></div><div class=bottom><a href=1>Impressum</a></div>"
    assert html.main_text(soup) == "\n".join([prose.strip(), "Short one.", prose.strip()])


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("<p>x<p", "x"), ("<article><p>A &am", "A &am"), ("<article>a<br>b<br><br>c</article>", "a b\nc"), ("<article><p><b>one<br><p>two</article>", "one\ntwo"), ("<article><!-- <p>no</p> --><p>yes</p>", "yes"), ("<nav>only a menu</nav>", ""), ("<article><p>a<script>x", "a")])
def test_broken_pages(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>x</title><meta charset=utf-8><body><article><p>Whole.</p></article>", "Whole."),
        ("<head><title>x</title><article><p>Without a body tag.</p></article>", "Without a body tag."),
        ("<head><head><title>x</title><main>two heads</main>", "two heads"),
        ("<head><title>x</title>" + "Text that ends the head. " * 4, ("Text that ends the head. " * 4).strip()),
        ("<head><noframes><p>no</p></noframes></head><article>yes</article>", "yes"),
        ('<article><p>before</p><svg class="i"/><p>after</p></article>', "before\nafter"),
        ("<article>a <svg/> b <math hidden /> c <SVG viewBox='0 0 1 1' />d</article>", "a b c d"),
        ('<article>a<svg class=i/><text>no</text></svg><svg><path d="x"/></svg> b</article>', "a b"),
    ],
)
def test_open_head_and_self_closed_svg(page, want):
    assert html.main_text(page) == want


PROSE = "Long prose sentence here, with words. " * 6
LONG = PROSE.strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>We see <a href="/hidden-costs">costs rise</a> and <a href="/p?id=reply">more</a> here.</p></article>', "We see costs rise and more here."),
        ('<article><p title="the hidden cost of x">One paragraph.</p><p data-id="share">Two paragraphs.</p></article>', "One paragraph.\nTwo paragraphs."),
        ('<article class="post category-social tag-popular"><p>The body.</p></article>', "The body."),
        (f'<div class="layout has-sidebar"><div class="content"><p>{PROSE}</p><p>Short.</p></div><div class="sidebar"><p>Read also the others.</p></div></div>', f"{LONG}\nShort."),
        (f'<form action="/"><div id="nav"><a href=1>a</a></div><div class="content"><p>{PROSE}</p><p>Second one.</p></div></form>', f"{LONG}\nSecond one."),
        (f'<svg class="i"><path d="x"><article><p>{PROSE}</p></article>', LONG),
        (f"<video src=x><article><p>{PROSE}</p></article>", LONG),
        ('<article><p class=foo">Text.</p></article>', "Text."),
        ('<article><p class="foo>Text.</p><p>b</p></article>', "Text.\nb"),
        ("<article><p><a href=/x/>link</a> and text.</p></article>", "link and text."),
        (f'<article><p>{PROSE}</p><p class="ad">Buy now, it is cheap today.</p><p>{PROSE}</p></article>', f"{LONG}\n{LONG}"),
        (
            f'<div><div class="site-header"><h1>The Site</h1><p>News of all kinds, each day.</p></div><p>{PROSE}</p><p>{PROSE}</p><div class="related-stories"><p>Related: read how the others did it, at some length here.</p></div>'
            '<div id="comments"><p>I think that this is right, and will say so at length for all to see.</p></div></div>',
            f"{LONG}\n{LONG}",
        ),
    ],
)
def test_attributes_and_wrappers(page, want):
    assert html.main_text(page) == want


def test_the_cut_overrules_a_class_word():
    """The block's own capacity is to boilerplate; that of its neighbours and the edges to them weigh more."""
    page = f'<article><p>{PROSE}</p><p class="share-price">The price of a share fell.</p><p>{PROSE}</p></article>'
    found = html.Page(page)
    assert found.terminals(html.PRIOR)[1] < 0
    assert html.main_text(page) == f"{LONG}\nThe price of a share fell.\n{LONG}"


@pytest.mark.parametrize("outer", ["main", "article", 'div class="content"'])
@pytest.mark.parametrize(
    ("inside", "want"),
    [
        ('<h2 id="search">Search</h2>', "Search"), ('<h2 id="comments">Comments on the law</h2>', "Comments on the law"), ('<h2 id="share-of-votes">Share of votes</h2>', "Share of votes"), ('<h3 id="legal-notice">Legal notice</h3>', "Legal notice"),
        (f'<section id="discussion"><h2>Discussion</h2><p>{LONG}</p></section>', f"Discussion\n{LONG}"), (f'<section id="related-work"><h2>Related work</h2><p>{LONG}</p></section>', f"Related work\n{LONG}"), (f'<div class="related-work"><p>{LONG}</p></div>', LONG),
        ('<p>He sent a <span class="reply">short reply</span> to the court on Monday.</p>', "He sent a short reply to the court on Monday."), ('<p>Press <code class="menu">File</code> and go on.</p>', "Press File and go on."),
        ('<p>It has <span class="tags">three tags</span> and an <em class="promo">offer</em> in it.</p>', "It has three tags and an offer in it."),
        ('<pre><code>x = 1 <span class="hljs-comment"># the first number</span></code></pre>', "x = 1 # the first number"), (f'<p class="skip">{LONG}</p>', LONG), (f'<div class="overlay-text">{LONG}</div>', LONG),
        ('<p>Seen <span hidden>but not this</span>and <b style="display: none">nor <i>this</i></b>heard.</p>', "Seen and heard."),
    ],
)
def test_words_of_a_topic_are_not_parts_of_a_page(outer, inside, want):
    page = f"<html><body><nav><a href=/>Home</a></nav><{outer}><p>{LONG}</p>{inside}<p>{LONG}</p></{outer.split()[0]}><footer>Contact us</footer></body></html>"
    assert html.main_text(page) == f"{LONG}\n{want}\n{LONG}"


def test_deep_pages_take_linear_time():
    n = 100_000
    assert html.main_text("<article>" + "<i><b>x" * n) == "x" * n
    assert html.main_text("<article>" + "<b>" * n + "<p>x y z</p>" * n).count("\n") == n - 1
    assert html.main_text("<article>" + "<div>x" * n).count("\n") == n - 1


def test_fitted_weights(spark):
    """Without marked blocks the weights are the prior; with them they fit better than it, in any order of the rows."""
    rows = [(i, f"<nav><a href=x>Go to {i}</a></nav><article><h1>Title {i}</h1><p>{PROSE}</p></article><footer>Imprint {i}</footer>") for i in range(30)] + [(99, None)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    w = html.fit(df)
    assert w == html.fit(df.orderBy(F.desc("page_id"))) == html.fit(df.repartition(5)) != html.PRIOR
    x = np.concatenate([html.Page(h).features() for _, h in rows if h])
    y = np.array([v for _, h in rows if h for v in html.Page(h).marked()])
    loss = lambda w: np.mean(np.log1p(np.exp(-np.where(y == 1, 1, -1) * (x @ np.array(w)))))
    assert loss(w) < loss(html.PRIOR)
    assert html.fit(df.where("page_id = 99")) == html.fit(df.limit(0)) == html.PRIOR


def test_min_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 9)
        terminals = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(1, 6)) for _ in range(rng.randint(0, 14))]
        edges = [e for e in edges if e[0] != e[1]]

        def cost(side):
            return sum(c for c, s in zip(terminals, side) if c > 0 and not s) + sum(-c for c, s in zip(terminals, side) if c < 0 and s) + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost([int(x) for x in html.min_cut(terminals, edges)]) == best


def test_pages(spark, sf):
    got = html.op2_html(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/pages.parquet").count() and all(r.n_chars == len(r.text) > 0 for r in got)
    df = spark.createDataFrame([(1, "u", None, "x"), (1, None, "<article>a</article>", "y")], "page_id long, url string, html string, text string")
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in html.extract(df).collect()} == {(1, "u", "", 0), (1, None, "a", 1)}
    assert html.extract(df.limit(0)).count() == 0


def test_very_long_page():
    page = "<article>" + "".join(f"<p>paragraph number {i} of the page</p>" for i in range(20_000)) + "</article>"
    assert html.main_text(page).count("\n") == 19_999


# language


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.op5_langid(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in langid.op5_langid(spark, sf).collect())


def test_language_odd(spark, odd, nothing):
    model = langid.fit(odd)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (3, 4, 9, 10)) and all(0 <= s <= 1 for _, s in got.values())
    kept = langid.keep_languages(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == set(got) - {3, 4, 9, 10}
    none = langid.fit(nothing)
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0


@pytest.mark.parametrize(("text", "letters"), [("½ ² ¼", False), ("Ⅷ ①", False), ("12 _ !", False), ("3 ª", True), ("日本", True), ("x", True), (None, False), ("", False)])
def test_letters(text, letters):
    assert langid.has_letters(text) == letters == (langid.presence(text) is not None)


def test_language_sample_is_bounded(spark):
    """Texts over train_chars aren't learned from; all are scored."""
    rows = [(i, "the cat sat on the mat " * 3, "en") for i in range(20)] + [(100 + i, "el gato en la casa " * 3, "es") for i in range(20)] + [(200 + i, "der hund " * 4000, "de") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.langs == ["en", "es"] and langid.fit(df, train_chars=100_000).langs == ["de", "en", "es"]
    assert {r.lang_pred for r in langid.identify(df, model).collect()} == {"en", "es"}


def test_kernel_is_a_product():
    a, b = (langid.presence(t) for t in ("the cat sat", "the dog sat on"))
    bins = np.flatnonzero((a | b).reshape(-1))
    want = np.mean([(x & y).sum() / np.sqrt(x.sum() * y.sum()) for x, y in zip(a, b)])
    assert langid._scaled(a, bins) @ langid._scaled(b, bins) == pytest.approx(want, rel=1e-5)


def test_ridge_on_landmark_features():
    """The model's matrix of n-grams by languages gives what kernels, landmarks and a ridge solved otherwise give."""
    rng = random.Random(2)
    alphabets = {"aa": "abcdeé ", "bb": "cdefgß ", "cc": "efghñx "}
    rows = [("".join(rng.choice(a) for _ in range(60)), k) for k, a in alphabets.items() for _ in range(14 if k == "aa" else 8)]
    landmarks, ridge = 5, 1e-2
    model = langid.train(rows, landmarks, ridge)

    def kernel(x, y):
        return np.mean([(a & b).sum() / np.sqrt(a.sum() * b.sum()) for a, b in zip(langid.presence(x), langid.presence(y))])

    marks = [t for k in sorted(alphabets) for t in [t for t, g in rows if g == k][:landmarks]]
    value, vector = np.linalg.eigh(np.array([[kernel(x, y) for y in marks] for x in marks]))
    features = lambda texts: np.array([[kernel(t, m) for m in marks] for t in texts]) @ (vector / np.sqrt(value))
    x, count = features([t for t, _ in rows]), Counter(k for _, k in rows)
    w = np.array([1 / (3 * count[k]) for _, k in rows])
    # least squares with the penalty as rows of their own; the constant isn't penalised
    left = np.vstack([np.sqrt(w)[:, None] * np.hstack([x, np.ones((len(x), 1))]), np.sqrt(ridge) * np.eye(len(marks), len(marks) + 1)])
    y = np.array([[1.0 if g == k else -1.0 for k in sorted(alphabets)] for _, g in rows])
    beta = np.linalg.lstsq(left, np.vstack([np.sqrt(w)[:, None] * y, np.zeros((len(marks), 3))]), rcond=None)[0]
    new = ["".join(rng.choice(a) for _ in range(40)) for a in alphabets.values() for _ in range(6)]
    want = np.hstack([features(new), np.ones((len(new), 1))]) @ beta
    got = np.stack([langid._scaled(langid.presence(t), model.bins) for t in new]) @ model.weights + model.bias
    assert np.allclose(got, want, atol=2e-3)
    langs, scores = model.score(new)
    assert langs == [sorted(alphabets)[i] for i in want.argmax(axis=1)] and np.allclose(scores, np.clip((want.max(axis=1) + 1) / 2, 0, 1), atol=2e-3)


# quality


def test_quality(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.op9_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_quality_odd(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(nothing, model).count() == 0
    none = quality.fit(odd, labels.limit(0))
    assert {round(r.score, 6) for r in quality.score(odd, none).collect()} == {0.5}


def test_compiled_rules_score_as_the_ensemble(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    stats = docs.select("doc_id", *[c.alias(k) for k, c in quality.statistics(F.coalesce("text", F.lit(""))).items()]).collect()
    want = model.predict({k: np.array([r[k] for r in stats]) for k in stats[0].asDict() if k != "doc_id"})
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.allclose([got[r.doc_id] for r in stats], want)
    assert 0 < len(model.rules)


# mixing


@pytest.mark.parametrize("share", [{"a": 1}, {"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1, None: 3}, {f"s{i}": 1 + i * i for i in range(12)}])
def test_frame_is_pfair(share):
    size, got = sum(share.values()), Counter()
    for t, (s, j, slot, release, deadline) in enumerate(mixing.frame(share)):
        assert slot == t and release <= t < deadline
        got[s] += 1
        assert j == got[s]
        assert all(abs(got[k] - q * (t + 1) / size) < 1 for k, q in share.items())
    assert got == Counter(share)


@pytest.mark.parametrize(
    "weights",
    [{"a": 0.99995, "b": 0.00005}, {"a": 1 / 3, "b": 2 / 3}, {"a": Fraction(1, 3), "b": Fraction(1, 7), "c": Fraction(11, 21)}, {"a": 0.123456789, "b": 0.876543211}, {"a": 3, "b": "0.1"}],
)
def test_given_weights_are_kept_exactly(weights):
    """At every slot of many frames each source is within one block of the weight as it was given."""
    share = mixing.shares(dict.fromkeys(weights, 1), weights)
    total, size, got = sum(Fraction(str(w)) for w in weights.values()), sum(share.values()), Counter()
    assert {s: Fraction(q, size) for s, q in share.items()} == {s: Fraction(str(w)) / total for s, w in weights.items()}
    assert Fraction(share["a"], size) == Fraction(str(weights["a"])) / total
    order = [s for s, *_ in mixing.frame(share, 50_000)]
    for t in range(60_000 if size <= 50_000 else 50_000):
        got[order[t % size]] += 1
        if t % 7 == 0 or t < 1000:
            assert all(abs(got[s] - Fraction(q, size) * (t + 1)) < 1 for s, q in share.items())


def test_mixing_refuses_what_it_cannot_keep(spark, odd):
    every = {"a": 1, "b": 1, "c": 1, None: 1}
    for wrong in ({**every, "a": 0}, {**every, "b": -1}, {"a": 1}):
        with pytest.raises(ValueError):
            mixing.mix(odd, weights=wrong)
    with pytest.raises(ValueError):
        mixing.mix(odd, weights={**every, "a": 0.0001}, block=1, max_slots=50)
    # a frame of very many slots, of which few are needed
    assert mixing.mix(odd, weights={**every, "a": 1.123456789, "z": 5}, block=1).count() == odd.count()


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs, block=3, bucket_rows=4).collect()
    counts = Counter(r.source for r in got)
    assert counts == Counter(r.source for r in docs.collect())
    share = mixing.shares(counts)
    size = sum(share.values())
    for s, n in counts.items():
        own = sorted(r["rank"] for r in got if r.source == s)
        assert own == list(range(1, n + 1))
    slots = {}
    for r in got:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block) and r.release <= r.slot < r.deadline and r.block == (r["rank"] - 1) // 3 + 1
    full = sorted({r.slot for r in got if r.in_horizon})
    assert full == list(range(len(full)))
    done = Counter()
    for t in full:
        done[slots[t][0]] += 1
        assert all(abs(done[s] - share[s] * (t + 1) / size) < 1 for s in share)
    order = [(r.slot, r["rank"]) for r in sorted(got, key=lambda r: (r.slot, r["rank"]))]
    by = {r.doc_id: (r.slot, r["rank"]) for r in got}
    assert [by[r.doc_id] for r in mixing.mixed(docs, block=3, bucket_rows=4).collect()] == order


def test_mixing_odd(spark, odd, nothing):
    assert mixing.mix(odd).count() == mixing.mixed(odd).count() == odd.count()
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(nothing).count() == mixing.mixed(nothing).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, max_sources=1)
    weighted = mixing.mix(odd, weights={"a": 3, "b": 1, "c": 1, None: 1}, slots=6, block=1)
    assert Counter(r.source for r in weighted.orderBy("slot").limit(2).collect())["a"] == 1
