"""What each filter of a chain removes, in every order of the chain, by a trie of orders whose states are shared.

A prefix of an order leaves the same rows whatever the order within it, so the n! orders of n filters walk a trie whose
nodes are the 2**n sets of filters. The walk goes depth first: a node's survivors are the parent's, persisted, less what
one more filter removes; a node that another prefix has reached is not made again; and what leaves on each of its edges
is counted there, by part, in one pass over its survivors. At most n + 1 frames of survivors are persisted at a time. They
hold flags, not texts; their root is a checkpoint, so a lost executor costs the filtering of flags. Counts of a node are a
row a part, written to the shared folder; nothing comes to the driver.

Sources may be few and hold a third of all rows: counts are partial sums before anything moves. Copies are told by a
SHA-256 of the whole text: digests of more than one row in HOT, fewer than HOT of them, bring their smallest id along by
broadcast, others by a join on the digest.

Defined results: a condition that is null removes nothing; a null text is empty, and a null part the empty string; rows
that repeat an id are rows of their own, and of those with one text none has a smaller id; a null id is never smaller,
nor copies anything; of repeated labels of an id one that says 1 counts; a document without a label is neither good nor
toxic; an empty table gives an empty table; other columns don't take part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table
from .exact_dedup import HOT

ORACLE_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS tox FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(tox, 0) AS tox,
         CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN docs.doc_id > min(docs.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m
  FROM docs LEFT JOIN marks ON docs.doc_id = marks.doc_id),
cells AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(tox) AS tox FROM flags GROUP BY part, m),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT f1.c || f2.c || f3.c || f4.c || f5.c AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits
  FROM f f1, f f2, f f3, f f4, f f5
  WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31 AND list_distinct([f1.b, f2.b, f3.b, f4.b, f5.b]).len() = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS b, coalesce(list_sum(bits[1:step - 1]), 0) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
  SELECT part, filter_order, step, b,
         sum(CASE WHEN m & (before + b) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN m & before = 0 AND m & b <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN m & before <> 0 AND m & b <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN m = b THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN m & before = 0 AND m & b <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN m & before = 0 AND m & b <> 0 THEN tox ELSE 0 END) AS toxic_lost
  FROM cells, (SELECT filter_order, step, CAST(b AS INTEGER) AS b, CAST(before AS INTEGER) AS before FROM steps) GROUP BY part, filter_order, step, b)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM counted
"""


def later_copy(rows: DataFrame, id_col: str = "id", digest: str = "digest", hot: int = HOT) -> DataFrame:
    """rows and `copy`: whether a row with a smaller id has the same digest. rows are read twice."""
    total = rows.count()
    first = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(digest).alias("__d")).agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    often = first.where(F.col("__n") * hot > total).select(F.col("__d").alias("__o"), F.col("__first").alias("__top"))  # fewer than `hot` rows
    rest = first.where(F.col("__n") * hot <= total).drop("__n")
    out = rows.join(F.broadcast(often), F.col(digest) == F.col("__o"), "left")
    # rows of hot digests need no partner any more, and are spread instead of meeting in one task
    key = F.when(F.col("__o").isNull(), F.col(digest)).otherwise(F.unhex(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    out = out.withColumn("__key", key).join(rest, F.col("__key") == F.col("__d"), "left")
    return out.withColumn("copy", F.coalesce(F.col(id_col) > F.coalesce("__top", "__first"), F.lit(False))).drop("__o", "__top", "__key", "__d", "__first")


def states(flags: DataFrame, n: int, lost: int) -> DataFrame:
    """(part, state, kept, removed, lost): what is left in each state, a bit for each filter applied, and what each filter would remove next.

    flags: part, f0.. (whether the filter removes the row), l0.. (whether the row counts as lost). removed has an entry
    for each filter, lost one for each filter of what is counted as l0 and so on; zero for filters already applied.
    """
    memo: dict[int, DataFrame] = {}

    def leaves(i: int, state: int, also: Column | None = None) -> Column:
        gone = F.col(f"f{i}") if also is None else F.col(f"f{i}") & also
        return F.lit(0).cast("long") if state >> i & 1 else F.count_if(gone)

    def visit(state: int, survivors: DataFrame) -> None:
        edges = F.array(*[leaves(i, state) for i in range(n)]).alias("removed")
        losses = F.array(*[F.array(*[leaves(i, state, F.col(f"l{j}")) for i in range(n)]) for j in range(lost)]).alias("lost")
        memo[state] = checkpoint(survivors.groupBy("part").agg(F.count(F.lit(1)).alias("kept"), edges, losses).withColumn("state", F.lit(state)))
        for i in range(n):
            after = state | 1 << i
            if after not in memo:
                child = survivors.where(~F.col(f"f{i}")).persist()
                visit(after, child)
                child.unpersist()

    root = flags.persist()
    visit(0, root)
    root.unpersist()
    out = None
    for counts in memo.values():
        out = counts if out is None else out.unionByName(counts)
    return out


def audit(df: DataFrame, filters: dict[str, Column], part: Column, lost: dict[str, Column]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <lost>_lost..., shapley of each order and step.

    filters: by name, whether a row fails; every order of the names is applied from left to right. kept: rows after the
    step; removed: here; redundant: rows that fail this filter and had gone before; unique_fails: rows that fail this
    filter alone; lost: removed rows of each kind; shapley: what the filter removes, summed over all orders. There are
    n! * n rows a part, so n is 6 at most.
    """
    names, n = list(filters), len(filters)
    if not 1 <= n <= 6:
        raise ValueError("one to six filters")
    truth = lambda c: F.coalesce(c, F.lit(False))
    flags = checkpoint(df.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), *[truth(c).alias(f"f{i}") for i, c in enumerate(filters.values())], *[truth(c).alias(f"l{j}") for j, c in enumerate(lost.values())]))
    node = F.struct("kept", "removed", "lost")
    parts = states(flags, n, len(lost)).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", node))).alias("at"))  # 2**n nodes a part
    orders = F.explode(F.expr(f"array({', '.join(f'array({str(o)[1:-1].rstrip(",")})' for o in permutations(range(n)))})"))
    zero = F.lit(0).cast("long")
    removed = lambda state, i: F.coalesce(F.get(F.try_element_at("at", state)["removed"], i), zero)

    def shapley(i: int) -> Column:
        others = [state for state in range(1 << n) if not state >> i & 1]
        times = F.expr(f"map({', '.join(f'{x}, {factorial(x.bit_count()) * factorial(n - 1 - x.bit_count())}L' for x in others)})")
        return F.aggregate(F.map_keys(times), zero, lambda total, state: total + F.try_element_at(times, state) * removed(state, F.lit(i)))

    alone = F.array(*[removed(F.lit((1 << n) - 1 - (1 << i)), F.lit(i)) for i in range(n)])
    fails = F.array(*[removed(F.lit(0), F.lit(i)) for i in range(n)])
    rows = parts.select("part", "at", alone.alias("alone"), fails.alias("fails"), F.array(*[shapley(i) for i in range(n)]).alias("shapley")).withColumn("order", orders)
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("i", F.get("order", F.col("step") - 1))
    applied = lambda upto: F.aggregate(F.slice("order", 1, upto), F.lit(0), lambda state, i: state.bitwiseOR(F.get(F.array(*[F.lit(1 << k) for k in range(n)]), i)))
    rows = rows.withColumns({"before": applied(F.col("step") - 1), "after": applied(F.col("step"))})
    here, i = F.try_element_at("at", F.col("before")), F.col("i")
    named = F.array_join(F.transform("order", lambda i: F.get(F.array(*[F.lit(k) for k in names]), i)), "")
    gone = F.coalesce(F.get(here["removed"], i), zero)
    return rows.select(
        "part", named.alias("filter_order"), "step", F.coalesce(F.try_element_at("at", F.col("after"))["kept"], zero).alias("kept"), gone.alias("removed"), (F.get("fails", i) - gone).alias("redundant"), F.get("alone", i).alias("unique_fails"),
        *[F.coalesce(F.get(F.get(here["lost"], F.lit(j)), i), zero).alias(f"{name}_lost") for j, name in enumerate(lost)], F.get("shapley", i).alias("shapley"),
    )


def text_failures(text: Column) -> dict[str, Column]:
    """Too few words; too few distinct ones; too many capitals; signs of markup."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chars = F.length(text)
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": (chars - F.length(F.regexp_replace(text, "[A-Z]+", ""))) * 100 > chars * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The four filters of text_failures and E, copies of a document with a smaller id, in all 120 orders, by source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *[c.alias(k) for k, c in text_failures(text).items()])
    rows = later_copy(checkpoint(rows))
    marks = labels.groupBy(F.col("doc_id").alias("__l")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(marks, F.col("id") == F.col("__l"), "left")
    return audit(rows, {**{k: F.col(k) for k in "ABCD"}, "E": F.col("copy")}, F.col("part"), {"good": F.col("good"), "toxic": F.col("toxic")})


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
