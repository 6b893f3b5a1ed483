"""Operators over embeddings: ties, huge and tiny components, and what one task gets."""

import numpy as np
import pytest

from veilspark.llm import nearest, neardup


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, label, [float(x) for x in v]) for i, label, v in rows],
        "vec_id long, label int, embedding array<double>")


def plain_nearest(rows, query_ids, k):
    out = []
    for q in query_ids:
        a = next(np.array(v) for i, _, v in rows if i == q)
        found = sorted((-float((a * np.array(v)).sum()), i) for i, _, v in rows if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_ties_go_to_the_smaller_id(spark):
    # 300 different vectors with one product with the query, all over the leaves and blocks
    rows = [(0, 1, [1, 0, 0, 0])] + [(i, 1, [0.5, i % 17, i % 13, i]) for i in range(300, 0, -1)]
    df = frame(spark, rows)
    for block in (8192, 64):
        got = nearest.nearest(df.filter("vec_id = 0"), df, 5, block=block).collect()
        assert sorted(map(tuple, got)) == [(0, n, n, 0.5) for n in range(1, 6)]


@pytest.mark.parametrize("power", [1e200, 1e-200, 1])
def test_components_of_any_size(spark, power):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, rng.normal(size=5) * power) for i in range(60)]
    rows += [(100 + i, v[1], v[2] * (1 + 1e-9 * rng.normal(size=5))) for i, v in enumerate(rows[:10])]
    rows += [(200, 0, [1e-250, 0, 0, 0, 0]), (201, 0, [2e250, 0, 0, 0, 0])]
    df = frame(spark, rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_vectors(df, 0.98, tile=16).collect()}

    def cosine(a, b):
        a, b = (np.array(x, float) / np.abs(x).max() for x in (a, b))
        return (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())

    for i, label, v in rows:
        links = [j for j, other, w in rows if j != i and other == label and cosine(v, w) >= .98]
        assert got[i][0] == len(links)
    assert all(got[100 + i] == (1, i) for i in range(10)) and got[200] == got[201] == (1, 200)
    # products that leave the range count as infinite or zero there, and nothing fails
    found = nearest.nearest(df.filter("vec_id % 20 = 0 and vec_id < 100"), df.filter("vec_id < 200"), 7, block=20)
    want = plain_nearest([(i, x, np.array(v) / power) for i, x, v in rows[:-2]], [0, 20, 40], 7)
    got = sorted(map(tuple, found.collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    if power == 1:
        assert [g[:3] for g in got] == [w[:3] for w in want]


def test_no_task_holds_a_whole_key(spark, monkeypatch):
    """Without any broadcast of the optimizer's, blocks of one key lie in many tasks."""
    rng = np.random.default_rng(5)
    df = frame(spark, [(i, 1, rng.normal(size=4) + [9, 0, 0, 0]) for i in range(800)])
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    seen = {}

    def watched(kept):
        def run(data, name):
            # rows of one task before they are packed: the largest file tells
            out = kept(data, name)
            if name.endswith("blocks"):
                seen[name] = [len(r["rows"]) for r in out.select("rows").collect()], out.rdd.getNumPartitions()
            return out
        return run

    try:
        for module in (nearest, neardup):
            monkeypatch.setattr(module, "materialize", watched(module.materialize))
        monkeypatch.setattr(neardup, "is_small", lambda t: False)
        nearest.nearest(df.limit(10), df, 3, block=50, name="n").count()
        neardup.near_vectors(df, 0.98, tile=50, name="v").count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for sizes, files in seen.values():
        assert sum(sizes) == 800 and max(sizes) < 120 and files > 1
