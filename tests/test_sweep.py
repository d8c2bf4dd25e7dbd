import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import analytics, graph

SCHEMA = "fact_id long, source string, parameter string, doc_id long, unit string, value_min double, value_max double"


def brute(rows, gap=0.2):
    out = set()
    for x in rows:
        for y in rows:
            same = x[1:3] == y[1:3] and x[4] == y[4] and x[3] != y[3]
            if not same or None in (x[5], x[6], y[5], y[6]) or x[1] is None or not x[6] < y[5]:
                continue
            near, scale = y[5] - x[6], min(abs(x[6]), abs(y[5]))
            if (near > 0 if scale == 0 else near / scale > gap):
                out.add((min(x[0], y[0]), max(x[0], y[0])))
    return out


@pytest.mark.parametrize("hot, run", [(1000, 256), (20, 4), (5, 1)])
def test_pairs_of_small_and_hot_keys(spark, hot, run):
    rng = random.Random(1)
    rows = []
    for k in range(400):
        low = rng.choice([-10, -3, -1, 0, 0, 1, 2, 5, 6, 6.1, 10, 100]) + rng.choice([0, 0, 0.5, 0.01])
        rows.append((k, rng.choice(["p", "p", "q", None]), "hot" if k % 3 else f"c{k % 40}", rng.randint(0, 30), rng.choice(["g", None]), rng.choice([float(low), None, float(low)]), float(low + rng.choice([0, 0, 1, 0.2]))))
    found = analytics.contradiction_pairs(spark.createDataFrame(rows, SCHEMA).repartition(5), hot=hot, run=run)
    got = [(r.fact_a, r.fact_b) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_a_key_of_100_000_facts_makes_no_square(spark):
    # All facts lie too near to each other but for ten: the pairs are those of the ten.
    near = spark.range(100_000).select(F.col("id").alias("fact_id"), F.lit("p").alias("source"), F.lit("t").alias("parameter"), F.col("id").alias("doc_id"), F.lit("C").alias("unit"), (100 + F.col("id") % 1000 / 100).alias("value_min"), (100 + F.col("id") % 1000 / 100).alias("value_max"))
    far = spark.range(10).select((F.col("id") + 200_000).alias("fact_id"), F.lit("p").alias("source"), F.lit("t").alias("parameter"), (F.col("id") + 200_000).alias("doc_id"), F.lit("C").alias("unit"), F.lit(900.0).alias("value_min"), F.lit(901.0).alias("value_max"))
    pairs = analytics.contradiction_pairs(near.unionByName(far))
    assert pairs.count() == 1_000_000
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def naive_search(edges, starts, depth, most, hub):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found, front = dict.fromkeys(sorted(starts)[:most], 0), sorted(starts)[:most]
    for level in range(1, depth + 1):
        fresh = sorted({y for x in front if len(near.get(x, ())) <= hub for y in near.get(x, ())} - set(found))[: most - len(found)]
        found |= dict.fromkeys(fresh, level)
        front = fresh
    return found


@pytest.mark.parametrize("most", [7, 300])
def test_many_searches_at_once(spark, most):
    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 400)}") for _ in range(500)] + [("hub", f"n{k}") for k in range(80)] + [("n1", "n1")]
    df = spark.createDataFrame([(*e, "STUDIES") for e in edges] + [("n0", "far", "WORKS_AT")], "src_key string, dst_key string, rel_type string")
    starts = {q: {f"n{q}", f"n{q + 1}"} for q in range(12)} | {50: {"hub"}, 51: {"unknown"}}
    asked = spark.createDataFrame([(q, k) for q, ks in starts.items() for k in ks], "query_id long, node_key string")
    got = {}
    for r in graph.bounded_searches(graph.adjacency(df, most_degree=50), asked, 3, most).collect():
        got.setdefault(r.query_id, {})[r.node_key] = r.depth
    assert got == {q: naive_search(edges, ks, 3, most, 50) for q, ks in starts.items()}
