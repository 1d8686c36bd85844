import numpy as np
import pytest

from loomgraph.operators import graph, semantic

VECTORS = "item_id string, vector array<double>"


def components(x, ids, threshold):
    """Groups of two or more items, from all pairs."""
    x = np.asarray(x, float)
    length = np.sqrt((x * x).sum(1))
    near = x @ x.T >= threshold * np.outer(length, length)
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(1)
        if (new == label).all():
            return {(f"loose:{ids[k]}", i) for k, i in zip(label, ids, strict=True) if (label == k).sum() > 1}
        label = new


def found(frame):
    return {tuple(r) for r in frame.select("narrative_id", "item_id").collect()}


def test_pair_that_signs_of_projections_missed(spark):
    """Cosine 0.951; the 24 tables of 10 signs each put the two in different buckets."""
    a = [-0.377, -0.115, -0.306, -0.15, 0.389, -0.04, -0.594, 0.472]
    b = [-0.2, -0.205, -0.309, -0.037, 0.344, 0.153, -0.675, 0.473]
    rows = spark.createDataFrame([("a", a), ("b", b)], VECTORS)
    assert found(graph.loose_narratives(rows)) == {("loose:a", "a"), ("loose:a", "b")}


@pytest.mark.parametrize(("dim", "chunk", "kind", "threshold"), [(3, 1 << 23, "double", 0.995), (3, 800, "double", 0.95), (40, 15000, "float", 0.95)])
def test_groups_of_all_pairs(spark, dim, chunk, kind, threshold):
    """Chains and near copies, in one chunk and in many."""
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(30, dim))
    x = np.vstack([centres[rng.integers(0, 30, 500)] + rng.normal(size=(500, dim)) * 0.2, rng.normal(size=(200, dim))]).astype("f4")
    ids = [f"{i:04d}" for i in range(len(x))]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], f"item_id string, vector array<{kind}>")
    links = semantic.linking(rows, threshold, chunk=chunk)
    ends = graph.components(links.selectExpr("explode(array(a, b)) AS item_id", "struct(a, b) AS hash"))
    want = components(x, ids, threshold)
    assert want and {(f"loose:{r['label']}", r["item_id"]) for r in ends.collect()} == want


def test_group_of_near_copies_has_few_links(spark):
    """A group of k makes k * k / 2 pairs; links grow with k."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=64) + rng.normal(size=(3000, 64)) * 0.01
    rows = spark.createDataFrame([(f"{i:04d}", v.tolist()) for i, v in enumerate(x)], VECTORS)
    assert semantic.linking(rows, 0.95).count() <= 3000 * 2 * spark.sparkContext.defaultParallelism
    assert found(graph.loose_narratives(rows)) == {("loose:0000", f"{i:04d}") for i in range(3000)}


def test_at_the_threshold(spark):
    """What single precision can't tell from the threshold is decided in double."""
    rng = np.random.default_rng(2)
    other = np.hstack([np.zeros((400, 1)), rng.normal(size=(400, 199))])
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    x = np.sqrt(1 - 0.95**2) * other * (1 + rng.normal(size=(400, 1)) * 1e-7)
    x[:, 0] = 0.95
    one = np.eye(200)[:1]
    rows = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(np.vstack([one, x]))], VECTORS)
    cosine = semantic._cosines(np.repeat(one, 400, 0), x)
    want = {f"{i + 1:03d}" for i in np.flatnonzero(cosine >= 0.95)}
    assert 100 < len(want) < 300
    assert found(graph.loose_narratives(rows)) == {("loose:000", i) for i in want | {"000"}}


def test_odd_rows(spark):
    """Copies join, in both signs of zero; null, zero, non-finite and incomplete vectors and null ids link nothing; rows may repeat."""
    rows = [("b", [1.0, 0.0]), ("a", [1.0, -0.0]), ("a", [1.0, 0.0]), ("c", [300.0, 1.0]), ("d", [0.0, 1.0]), ("d", [0.0, 1.0]), (None, [0.0, 1.0])]
    rows += [("n", None), ("z", [0.0, 0.0]), ("e", []), ("i", [float("inf"), 0.0]), ("q", [float("nan"), 1.0]), ("h", [1.0, None])]
    frame = spark.createDataFrame(rows, VECTORS)
    assert found(graph.loose_narratives(frame)) == {("loose:a", i) for i in "abc"}
    assert found(graph.loose_narratives(frame.limit(0))) == set()
