"""Duplicate removal against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import embedding, exact_dedup, repeats, simhash, sketch, substring, suffix
from tidemark.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def components(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# exact


def check_exact(df, **how):
    groups = defaultdict(list)
    for i, t in docs_of(df):
        groups[t].append(i)
    want = sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    got = sorted(map(tuple, exact_dedup.exact_groups(df, **how).collect()))
    assert [r[:4] for r in got] == [r[:4] for r in want] and ("digest" in how or got == want)
    kept = exact_dedup.exact_dedup(df, **how).collect()
    assert sorted(r.doc_id for r in kept) == sorted(max(g) for g in groups.values())
    whole = {tuple(r) for r in df.collect()}
    assert all(tuple(r) in whole for r in kept)


def test_exact_odd(odd):
    check_exact(odd.repartition(3))


def test_exact_weak_digest(odd):
    """With a digest that is the same for all texts, contents alone tell texts apart."""
    check_exact(odd.repartition(3), digest=lambda t: F.substring(F.sha2(F.substring(t, 1, 0), 256), 1, 8))


@pytest.mark.parametrize("hot", [1, 1000])
def test_exact_weak_digest_many_parts(spark, hot):
    """Texts that share digests, one of them a third of all rows, with no digest taken for hot, and with all."""
    texts = ["the one" if i % 3 else f"text {i % 40}" for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(9)
    check_exact(df, hot=hot, salts=5)
    check_exact(df, hot=hot, salts=5, digest=lambda t: F.substring(F.sha2(t, 256), 1, 2))


def test_exact_salted_stage_merges(spark):
    """A hot text over many partitions: of its rows one for each salt is left after the salted stage, one at the end."""
    df = spark.range(0, 4000, 1, 40).selectExpr("id AS doc_id", "if(id % 2 = 0, 'hot', concat('text ', id)) AS text")
    rows = exact_dedup._salted(df.select(F.unhex(exact_dedup._sha(F.col("text"))).alias("digest"), "text", F.col("doc_id").alias("id")), 8, 1000)
    merged = rows.groupBy("digest", "text", "salt", "hot").count()
    assert {(r.hot, r.n) for r in merged.groupBy("hot").agg(F.count(F.lit(1)).alias("n")).collect()} == {(True, 8), (False, 2000)}
    check_exact(df, salts=8)


def test_exact_ties(spark):
    """Of rows that are equal in id and text, the same one stays in any order; a row without an id yields."""
    rows = [(1, "a", "x"), (1, "a", "y"), (None, "a", "z"), (None, "b", "u"), (None, "b", "v")]
    got = [sorted(map(tuple, exact_dedup.exact_dedup(spark.createDataFrame(r, "doc_id long, text string, other string")).collect()), key=str) for r in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 2 and got[0][0][:2] == (1, "a")
    groups = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string, other string")).collect()
    want = [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 2, False), (None, None, 2, False)]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in groups), key=str) == want


def test_exact_empty(nothing):
    assert exact_dedup.exact_groups(nothing).count() == exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_table(spark, sf):
    check_exact(spark.read.parquet(f"{sf}/documents.parquet"))


# SimHash


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_simhash(df):
    fp = {i: brute_fingerprint(t) for i, t in docs_of(df)}
    ids = sorted(fp)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 3]
    group = components(ids, links)
    got = simhash.simhash_groups(df).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fp[i]:016x}", group[i]) for i in ids}
    assert len(got) == df.count()
    assert sorted(r.doc_id for r in simhash.simhash_dedup(df).collect()) == sorted(set(group.values()))


def test_simhash_odd(odd):
    check_simhash(odd)


def test_simhash_without_ids(spark):
    """A document without an id stays if nothing with an id is like it; shared ids don't hide other texts."""
    a, b, c = ("alpha beta gamma delta", "one two three four five six", "uno dos tres cuatro cinco")
    df = spark.createDataFrame([(None, a), (1, a), (None, b), (None, b), (2, c), (2, b + " seven eight nine ten")], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.simhash_dedup(df).collect()), key=str)
    assert kept == sorted([(1, a), (None, b), (2, c), (2, b + " seven eight nine ten")], key=str)
    assert {r.component_id for r in simhash.simhash_groups(df).where("doc_id IS NULL").collect()} == {1, None}


def test_simhash_names_and_ties(spark):
    """Columns with the operator's inner names; of rows equal in id and text the same one stays in any order."""
    rows = [(1, "a b c d", "x", "r"), (1, "a b c d", "y", "s"), (2, "one two three four", "z", "t")]
    schema = "doc_id long, text string, stay string, stay_h string, row string, `__stay` string, `__stay_h` string"
    got = [sorted(map(tuple, simhash.simhash_dedup(spark.createDataFrame([(*r, "1", "2", "3") for r in x], schema)).collect())) for x in (rows, rows[::-1])]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [1, 2]


def test_simhash_empty(nothing):
    assert simhash.simhash_groups(nothing).count() == simhash.simhash_dedup(nothing).count() == 0


def test_simhash_table(spark, sf):
    check_simhash(spark.read.parquet(f"{sf}/documents.parquet"))


def test_ball_hashing_finds_every_link(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(6):  # chains of points at one to four bits
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    links = [(signed[a], signed[b]) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    want = components(signed.values(), links)
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    assert {r.fp: r.component for r in simhash.fingerprint_components(df, fine_rows=20).collect()} == want


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, 5)]
    nodes = {x for e in links for x in e if e[0] != e[1]}
    want = components(nodes, links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


# substrings


def brute_windows(docs, width=13):
    seen, out = defaultdict(lambda: 1 << 62), {}
    for i, t in docs:
        w = WORD.findall(t)
        for k in range(len(w) - width + 1):
            seen[tuple(w[k : k + width])] = min(seen[tuple(w[k : k + width])], i)
    for i, t in docs:
        w = WORD.findall(t)
        off = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] < i:
                off[k : k + width] = [True] * width
        out[i, t] = (len(w), sum(off), " ".join(x for x, o in zip(w, off) if not o).encode())
    return out


def check_windows(df):
    want = brute_windows(docs_of(df))
    got = substring.remove_repeats(df).join(df.select("doc_id").distinct(), "doc_id").collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got) == sorted((i, *want[i, t]) for i, t in docs_of(df))


def test_windows_odd(odd):
    check_windows(odd)


def test_windows_empty(nothing):
    assert substring.remove_repeats(nothing).count() == 0


def test_windows_table(spark, sf):
    check_windows(spark.read.parquet(f"{sf}/documents.parquet"))


@pytest.mark.parametrize("chunk", [sketch.CHUNK, 4096, 100])
def test_sketch_never_misses(chunk):
    """Parts of a sketch, merged and answered chunk by chunk; what passes doesn't grow with the number of chunks."""
    rng = np.random.default_rng(0)
    parts = np.array_split(sketch.mix(np.r_[np.arange(60_000), rng.integers(0, 60_000, 9_000)].astype(np.uint64)), 23)
    form, packs = sketch.shape(69_000, chunk), defaultdict(list)
    assert form.chunks == -(-69_000 * sketch.ROOM // chunk)
    for i, h in enumerate(parts):
        for c, once, twice in sketch.touched(h, form):
            packs[c].append((i, once, twice))
    answers = defaultdict(dict)
    for c, some in packs.items():
        for (i, *_), bits in zip(some, sketch.merged([p[1:] for p in some], form)):
            answers[i][c] = bits
    maybe = np.concatenate([sketch.maybe_repeated(h, answers[i], form) for i, h in enumerate(parts)])
    _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    assert maybe[counts[inverse] > 1].all()
    assert maybe[counts[inverse] == 1].mean() < 0.15
    assert len(sketch.maybe_repeated(np.zeros(0, np.uint64), {}, form)) == 0


@pytest.mark.parametrize("bucket", [repeats.BUCKET, 3_000])
def test_windows_and_strings_over_many_buckets(spark, monkeypatch, bucket):
    """A passage in half of the documents, texts of one word or byte, rows that share an id or have none."""
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join([*(word() for _ in range(rng.randint(0, 30))), *([passage] if rng.random() < 0.5 else []), *(word() for _ in range(rng.randint(0, 30)))]) for _ in range(120)]
    texts += ["na " * 300, "na " * 200 + passage, "-" * 9000, "ab" * 700, passage + " " + passage]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (7, texts[7])], "doc_id long, text string")
    check_suffix(df)
    check_windows(df)
    lone = df.union(spark.createDataFrame([(None, passage), (None, texts[9] + passage)], df.schema))
    want = brute_windows(docs_of(df))
    got = substring.remove_repeats(lone).collect()
    # without an id nothing is lost, and nothing is taken from others
    assert sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got if r.doc_id is not None) == sorted((i, *want[i, t]) for i, t in docs_of(df))
    assert [r.n_removed for r in got if r.doc_id is None] == [0, 0]


def test_packing():
    for a in (np.arange(1000, dtype=np.int64) - 500, np.zeros(0, np.uint32), np.array([2**63 - 1, -(2**63)], np.int64)):
        assert (sketch.unpack(sketch.pack(a), a.dtype) == a).all()


# suffixes


def brute_suffix(docs, length=100):
    seen, out = set(), {}
    for i, t in sorted(set(docs)):
        b = t.encode()
        off = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                off[k] += 1
                off[k + length] -= 1
            else:
                seen.add(b[k : k + length])
        gone = np.cumsum(off)[:-1] > 0
        out[i, t] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def check_suffix(df):
    want = brute_suffix(docs_of(df))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(df).collect())
    assert got == sorted((i, *want[i, t]) for i, t in docs_of(df))


def test_suffix_odd(odd):
    check_suffix(odd)


def test_suffix_empty(nothing):
    assert suffix.remove_repeats(nothing).count() == 0


def test_suffix_table(spark, sf):
    check_suffix(spark.read.parquet(f"{sf}/documents.parquet"))


@pytest.mark.parametrize("sort", [1 << 16, 8])
def test_suffix_shard_with_a_common_anchor(monkeypatch, sort):
    """A passage with many different surroundings: groups larger than what is sorted at a time give the same rows."""
    monkeypatch.setattr(suffix, "_SORT", sort)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(130)
    docs = [(i, text(rng.randint(0, 120)) + (passage if i % 5 else passage[: rng.randint(60, 130)]) + text(rng.randint(0, 120))) for i in range(60)]
    texts = [t.encode() for _, t in docs]
    parts = [(h, i, 0, s, c, texts[i][s : s + c + 99]) for h, i, s, c in zip(*(x.tolist() for x in suffix.runs(texts, 100, 40)))]
    alone = [(h, i, 0, s, c, t[s : s + c + 99]) for i, t in enumerate(texts) for h, _, s, c in zip(*(x.tolist() for x in suffix.runs([t], 100, 40)))]
    assert parts == alone
    h, ids, keys, start, count = (np.array([p[k] for p in parts], np.uint64 if k == 0 else np.int64) for k in range(5))
    found = list(suffix.judge(repeats.Stretches(h, ids, keys, start, count, [p[5] for p in parts]), 100))
    got = {(int(ids[r]), int(start[r]) + f + k) for f_ in found for r, f, n in zip(*(x.tolist() for x in f_)) for k in range(n)}
    seen, want = set(), set()
    for i, t in docs:
        for k in range(len(t) - 99):
            (want.add((i, k)) if t[k : k + 100] in seen else seen.add(t[k : k + 100]))
    assert got == want and want


def test_previous_factors():
    rng = np.random.default_rng(0)
    t, width = rng.integers(97, 99, 200).astype(np.uint8), 16
    rows = np.lib.stride_tricks.sliding_window_view(t, width)
    got, b = suffix.previous_factors(rows), t.tobytes()
    for i in range(len(rows)):
        want = 0
        for j in range(i):
            k = 0
            while k < width and b[i + k] == b[j + k]:
                k += 1
            want = max(want, k)
        assert got[i] == want


def test_long_text_in_spans(monkeypatch):
    monkeypatch.setattr(suffix, "_SPAN", 500)
    monkeypatch.setattr(repeats, "_SPAN", 130)
    b = bytes(random.Random(3).choices(b"abc ", k=2000))
    h, _, start, count = suffix.runs([b], 100, 40)
    assert count.sum() == len(b) - 99 and (start[1:] == start[:-1] + count[:-1]).all()
    again, *_ = suffix.runs([b[300:]], 100, 40)
    assert set(again[1:-1].tolist()) <= set(h.tolist())


# embeddings


def check_embeddings(df, **how):
    rows = df.collect()
    ok = [r for r in rows if r.label is not None and r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)]
    links = []
    for k, a in enumerate(ok):
        x = np.array(a.embedding, float)
        for b in ok[k + 1 :]:
            y = np.array(b.embedding, float)
            if a.label == b.label and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links.append((a.vec_id, b.vec_id))
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    group = components([r.vec_id for r in rows], links)
    want = sorted((r.vec_id, n[r.vec_id], group[r.vec_id], group[r.vec_id] == r.vec_id) for r in rows)
    assert sorted(map(tuple, embedding.near_duplicates(df, **how).collect())) == want


@pytest.mark.parametrize("chunk_rows", [2048, 15])
def test_embeddings(spark, chunk_rows):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((4, 10))
    rows = [(i, [float(x) for x in centre[i % 4] + 0.3 * rng.standard_normal(10)], i % 2) for i in range(160)]
    first = rows[0][1]
    rows += [(1000, None, 1), (1001, [0.0] * 10, 1), (1002, [float("nan")] * 10, 1), (1003, [1.0, None] + [0.0] * 8, 1), (1004, first, 0), (1005, first, None), (1006, [2 * x for x in first], 0), (1007, [1.0, 2.0], 0), (1008, [1.0, 2.0], 0), (1009, [], 1), (1010, [float("inf")] * 10, 0), (1011, [-0.0, 1.0], 0), (1012, [0.0, 1.0], 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, rep string, weight string")
    check_embeddings(df, chunk_rows=chunk_rows)
    with pytest.raises(ValueError):
        embedding.near_duplicates(df, threshold=1.0)


@pytest.mark.parametrize("tile", [256, 7])
def test_range_join_finds_every_pair(monkeypatch, tile):
    """Each pair over the threshold comes once, of one set or between two; of random pairs few are left to verify."""
    monkeypatch.setattr(embedding, "_TILE", tile)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 64))
    x[350:] = x[:350] + rng.uniform(0, 0.06, (350, 1)) * rng.standard_normal((350, 64)) * 8
    x = embedding.units(x)
    turned = x @ embedding.rotation(64)
    cos = x @ x.T
    for right in (None, turned[300:]):
        pairs = [(int(i), int(j)) for a, b in embedding.candidates(turned if right is None else turned[:300], right, 0.93, 8) for i, j in zip(a, b + (0 if right is None else 300))]
        pairs = [tuple(sorted(p)) for p in pairs]
        assert len(pairs) == len(set(pairs))
        want = {(i, j) for i in range(700) for j in range(i + 1, 700) if cos[i, j] >= 0.93 and (right is None or i < 300 <= j)}
        assert want and want <= set(pairs)
    free = embedding.units(rng.standard_normal((1500, 64))) @ embedding.rotation(64)
    left = sum(len(a) for a, _ in embedding.candidates(free, None, 0.93, 8))
    assert left < 0.01 * 1500 * 1499 / 2


def test_boxes_prune_where_vectors_lie_in_clusters(monkeypatch):
    """Tile pairs of far clusters aren't multiplied."""
    monkeypatch.setattr(embedding, "_TILE", 50)
    rng = np.random.default_rng(4)
    x = embedding.units(np.repeat(rng.standard_normal((20, 64)), 50, axis=0) + 0.01 * rng.standard_normal((1000, 64))) @ embedding.rotation(64)
    met = sum(len(a) for a, _ in embedding.candidates(x, None, 0.93, 8))
    assert met <= 1.1 * 20 * 50 * 49 / 2


def test_embeddings_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding.near_duplicates(df).count() == 0


def test_embedding_ids_missing_or_shared(spark):
    a, near_a, b, near_b, c, near_c, d, near_d = [1.0, 0, 0, 0], [1.0, 0.1, 0, 0], [0, 1.0, 0, 0], [0.1, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0.1, 1.0, 0], [0, 0, 0, 1.0], [0, 0, 0.1, 1.0]
    # id, vector, label; links, component, kept
    rows = [
        (None, a, 0, 2, 1, False), (1, near_a, 0, 2, 1, True), (None, a, 0, 2, 1, False), (5, b, 0, 1, 2, False), (2, near_b, 0, 1, 2, True), (5, c, 1, 1, 2, False), (9, near_c, 1, 1, 2, False), (5, [1.0, 0, 0], 0, 0, 2, False),
        (7, c, 0, 0, 7, True), (None, d, 1, 1, None, True), (None, near_d, 1, 1, None, True), (None, None, 1, 0, None, True), (5, near_a, 1, 0, 2, False),
    ]
    df = spark.createDataFrame([(i, [float(x) for x in v] if v else None, g) for i, v, g, *_ in rows], "vec_id long, embedding array<double>, label long")
    got = embedding.near_duplicates(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *rest) for i, _, _, *rest in rows), key=str)


def test_equal_rows_in_many_buckets(spark, monkeypatch):
    """A third of all rows is one row, in many partitions; each copy has the result of one document."""
    monkeypatch.setattr(repeats, "BUCKET", 2_000)
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = text(30)
    same = text(20) + " " + passage + " " + passage
    rows = [(i, text(10) + " " + passage + " " + text(10)) for i in range(60)] + [(30, same)] * 45 + [(None, same)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    check_suffix(df.where("doc_id IS NOT NULL"))
    check_windows(df.where("doc_id IS NOT NULL"))
    assert {(r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(df).where("doc_id IS NULL").collect()} == {(len(same), len(same), 1)}


def test_suffix_rows_without_an_id(spark):
    rng = random.Random(8)
    p, q, r, s = ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=150)) for _ in range(4))
    # id, text; what is kept
    rows = [(3, p, p), (None, p + "~~~" + p, "~~~"), (None, q + q, ""), (None, r, r), (None, r, r), (None, "A" + s, "A" + s), (None, "Bb" + s, "Bb"), ((1 << 63) - 2, "C" + q, "C" + q)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept.decode()) for r in suffix.remove_repeats(df).collect()), key=str)
    assert got == sorted(((i, len(t), len(t) - len(k), k) for i, t, k in rows), key=str)
    alone = suffix.remove_repeats(spark.createDataFrame([(None, q + q)], "doc_id long, text string")).first()
    assert (alone.n_removed, alone.n_spans, alone.kept.decode()) == (150, 1, q)
