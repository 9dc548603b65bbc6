"""The pipeline, stage by stage, against brute force."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from tokenizers import Tokenizer

from tidemark.llm import bpe, registry

from .test_dedup import brute_fingerprint, components


def test_registry():
    import __spark_entry__ as e

    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(names) | {"pipeline"} <= set(e.queries()) and set(registry.oracle_sql()) <= set(names)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src1", 0), (10**6 + 1, "12 !!", "en", "src1", 5)], docs.schema)
    docs = docs.unionByName(extra)
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()} if docs.columns == columns else before
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, {r.doc_id: r for r in docs.collect()})
        assert name == "bpe" or docs.columns == columns
    was, now = kept["language_id"]
    assert set(was) - set(now) == {10**6, 10**6 + 1}
    was, now = kept["exact_dedup"]
    groups = defaultdict(list)
    for i, r in was.items():
        groups[r.text].append(i)
    assert set(now) == {max(g) for g in groups.values()}
    was, now = kept["simhash_dedup"]
    fp = {i: brute_fingerprint(r.text) for i, r in was.items()}
    links = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    assert set(now) == set(components(fp, links).values())
    was, now = kept["mix_sources"]
    assert set(now) == set(was)
    was, now = kept["bpe"]
    reference = Tokenizer.from_file(bpe.default_vocabulary())
    assert {i: list(r.ids) for i, r in now.items()} == {i: reference.encode(r.text, add_special_tokens=False).ids for i, r in was.items()}
    assert all(r.n_tokens == len(r.ids) for r in now.values())


def test_rows_without_an_id_or_with_a_shared_one(spark, sf, tmp_path):
    """One row out for each row in, with its own text's ids, in the order of the mix."""
    rows = [(None, "no id, first text", "a"), (None, "no id, second text", "b"), (None, "no id, third", None), *[(7, f"text number {i} of one id", "ab"[i % 2]) for i in range(20)], (8, "its own", "b")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    order = [(r.doc_id, r.text, r.source) for r in stages["mix_sources"](spark, docs, sf).collect()]
    assert sorted(order, key=str) == sorted(rows, key=str)
    reference = Tokenizer.from_file(bpe.default_vocabulary())
    ids = {(i, s, tuple(reference.encode(t, add_special_tokens=False).ids)) for i, t, s in rows}
    got = stages["bpe"](spark, docs, sf).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.source, tuple(r.ids)) for r in got} == ids
    slot = {(r.doc_id, r.source, tuple(r.ids)): r.slot for r in got}
    at = [slot[i, s, tuple(reference.encode(t, add_special_tokens=False).ids)] for i, t, s in order]
    assert at == sorted(at)


def run_stages(spark, docs, sf, folder):
    """The rows after each stage."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs.collect())
    return out


def test_odd_documents_through_all_stages(spark, odd, sf, tmp_path):
    """Nulls, repeated rows and ids, odd column names: rows that a stage keeps are rows of the next one."""
    more = [(None, "the text of a row without an id, long enough to be told from the others", "en"), (None, "another text of a row that has no id, about quite other matters", "en"), (1, "a second text under the id one, on trees and rivers and hills", "en"), (1, "a second text under the id one, on trees and rivers and hills", "en")]
    names = odd.columns[5:]
    docs = odd.union(spark.createDataFrame([(i, t, g, "a", len(t), *names) for i, t, g in more], odd.schema))
    lang, exact, near, mixed, tokens = run_stages(spark, docs, sf, tmp_path)
    assert [list(r.asDict()) for r in (lang[0], exact[0], near[0], mixed[0])] == [docs.columns] * 4
    lost = {3, 4, 9, 10}
    assert sorted(map(str, lang)) == sorted(str(r) for r in docs.collect() if r.doc_id not in lost)
    texts = {r.text for r in lang}
    assert sorted(r.text for r in exact) == sorted(texts)
    assert {(r.doc_id, r.text) for r in near} <= {(r.doc_id, r.text) for r in exact} and {m[1] for m in more} <= {r.text for r in near}
    assert sorted(map(str, mixed)) == sorted(map(str, near))
    reference = Tokenizer.from_file(bpe.default_vocabulary())
    assert sorted((str(r.doc_id), str(r.source), r.ids) for r in tokens) == sorted((str(r.doc_id), str(r.source), reference.encode(r.text, add_special_tokens=False).ids) for r in mixed)
    assert {r.n_tokens == len(r.ids) for r in tokens} == {True}


def test_empty_table_through_all_stages(spark, nothing, sf, tmp_path):
    assert [len(rows) for rows in run_stages(spark, nothing, sf, tmp_path)] == [0] * 5


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "source", "slot", "n_tokens", "ids"] and got.count() > 0
