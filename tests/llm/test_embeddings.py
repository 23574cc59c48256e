import numpy as np
import pytest

from pathloom.llm import embeddings as em

DATA = "/root/testdata/sf0.01/embeddings.parquet"


def plain(rows):
    """Brute force over ``(vec_id, vector)``."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in rows if i is not None}
    for i, a in good:
        for j, b in good:
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                links[i].add(j)
    root = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            least = min([root[i], *(root[j] for j in js)])
            for k in (i, *js):
                changed |= root[k] > least
                root[k] = min(root[k], least)
    return [(i, len(links[i]), root[i], root[i] == i) if i is not None else (None, 0, None, False) for i, _ in rows]


def result(df, **more):
    return sorted(map(tuple, em.near_vectors(df, **more).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_data_brute_force(spark):
    df = spark.read.parquet(DATA)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert result(df) == sorted(plain(rows), key=str)


def test_edges(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    rows = [(k, [float(x) for x in (base[k % 6] + 0.1 * rng.normal(size=8)).astype(np.float32)]) for k in range(120)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, [2 * x for x in rows[1][1]]), (203, None), (204, []), (205, [0.0] * 8), (206, [float("nan")] * 8),
             (207, [float("inf")] + [0.0] * 7), (208, [None] + [1.0] * 7), (209, [1.0, 2.0]), (210, [2.0, 4.0]), (211, [1.0] * 9), (None, rows[0][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rep long, shard string")
    got = result(df, shard_rows=40, block_rows=25)
    assert got == sorted(plain(rows), key=str)


def test_a_graph_and_a_block_are_read_once_and_nothing_is_shuffled(spark, monkeypatch):
    plans = []
    saved = em.saved
    monkeypatch.setattr(em, "saved", lambda df, what: (plans.append((what, df._jdf.queryExecution().executedPlan().toString())), saved(df, what))[1])
    df = spark.createDataFrame([(k, [1.0, k / 100, 0.5]) for k in range(90)], "vec_id long, embedding array<double>")
    got = result(df, shards=3, block_rows=20)
    plan = dict(plans)["vector-links"]
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert got == sorted(plain([(r.vec_id, r.embedding) for r in df.collect()]), key=str)


def test_rows_that_repeat_an_id_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0])]
    got = result(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 1, 1, False)])


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert result(df) == []
    assert result(spark.createDataFrame([(1, [1.0, 2.0])], df.schema)) == [(1, 0, 1, True)]


@pytest.mark.parametrize("n", [1, 5, 3000])
def test_graph_recall(n):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 24)) + 3 * rng.normal(size=(40, 24))[rng.integers(0, 40, n)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = em.Graph(x)
    assert sorted(graph.order.tolist()) == list(range(n))
    for links in graph.layers:
        assert (links < len(links)).all()
    at, row, _ = graph.audited(x, 0.9)
    true = {tuple(p) for p in np.argwhere(x @ x.T >= 0.9).tolist()}
    found = set(zip(at.tolist(), row.tolist()))
    assert found <= {tuple(p) for p in np.argwhere(x @ x.T >= 0.8999).tolist()}
    assert len(found & true) >= 0.98 * len(true)


def test_dense_group_is_found_whole():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16))
    x[:700] = x[0] + 0.02 * rng.normal(size=(700, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    at, row = em.Graph(x).within(x[:50], 0.9)
    assert len({*zip(at.tolist(), row.tolist())}) >= 0.99 * 50 * 700
