"""The audit of filters against applying every order from the beginning."""

from __future__ import annotations

import random
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import audit


def brute(rows, names):
    """rows: (part, {name: fails}, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys(names, 0)
        cells = {}
        for order in permutations(names):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                total[f] += len(gone)
                cells["".join(order), step, f] = (len(left), len(gone), sum(r[1][f] for r in mine) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
        out |= {(part, o, s): (*v, total[f]) for (o, s, f), v in cells.items()}
    return out


def test_every_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", ""]), {n: rng.random() < 0.4 for n in "XYZ"}, rng.random() < 0.5, rng.random() < 0.2) for _ in range(300)]
    df = spark.createDataFrame([(p or None, *f.values(), g, t, "x", 1) for p, f, g, t in rows], "source string, X boolean, Y boolean, Z boolean, g boolean, t boolean, part string, state int")
    got = audit.audit(df, {n: F.col(n) for n in "XYZ"}, F.col("source"), {"good": F.col("g"), "toxic": F.col("t")}).collect()
    assert {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got} == brute(rows, "XYZ")


def test_a_state_is_made_once(spark, monkeypatch):
    made = []
    kept = audit.checkpoint
    monkeypatch.setattr(audit, "checkpoint", lambda df: made.append(df) or kept(df))
    df = spark.createDataFrame([("a", False, True, True, False)], "part string, f0 boolean, f1 boolean, f2 boolean, f3 boolean")
    got = {r["state"]: (r["kept"], r["removed"]) for r in audit.states(df, 4, 0).collect()}
    assert len(made) == 16 and got[0] == (1, [0, 1, 1, 0]) and got[1] == (1, [0, 1, 1, 0])
    assert 2 not in got or got[2][0] == 0


def test_the_query_gives_what_sql_gives(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    res = con.execute(audit.ORACLE_SQL)
    names = [d[0] for d in res.description]
    df = audit.op12_audit(spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(res.fetchall())


def test_copies_hot_and_cold(spark):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"t{i // 2}") for i in range(600)] + [(None, "hot"), (None, "t1"), (7, "hot"), (None, "own")]
    df = spark.createDataFrame(rows, "id long, digest string")
    got = sorted((r["id"], r["digest"]) for r in audit.later_copy(df, hot=10).where("NOT copy").collect() if r["id"] is not None)
    assert got == [(0, "hot"), *[(1000 + 2 * i, f"t{i}") for i in range(300)]]
    assert audit.later_copy(df, hot=10).where("copy").count() == 400 + 300
    assert audit.later_copy(df, hot=10).count() == len(rows)


def test_odd_tables(spark, odd, nothing):
    labels = spark.createDataFrame([(2, 1, 0), (2, None, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert audit.audit_documents(nothing, labels).collect() == []
    got = audit.audit_documents(odd, labels)
    assert got.count() == 600 * 4
    first = {r["part"]: r for r in got.where("filter_order = 'EABCD' AND step = 1").collect()}
    assert set(first) == {"", "a", "b", "c"}
    # of rows that share the smallest id and text none is a copy of another; both rows of id 2 are copies of 1
    assert (first["a"]["removed"], first["a"]["good_lost"], first["a"]["toxic_lost"]) == (3, 2, 2)
    assert first["b"]["removed"] == 1  # the empty text after the null one
