import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.operators import mcl, routes, sparse
from tripweave.plans.lineage import cut_bucketed, cut_lineage
from tripweave.sources import stages

RECT = [(1, 2, 3.0), (1, 3, 1.0), (2, 3, 2.0), (3, 5, 4.0), (2, 5, 1.0)]


def matrix(spark, entries):
    return spark.createDataFrame([(i, j, float(v)) for i, j, v in entries], "i long, j long, v double")


def dense(df, n):
    m = np.zeros((n, n))
    for r in df.collect():
        assert m[r["i"], r["j"]] == 0
        m[r["i"], r["j"]] = r["v"]
    return m


def random_entries(seed, n, density):
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((n, n)) < density, rng.integers(1, 9, (n, n)), 0).astype(float)
    m[:, 3] = 1.0
    m[3, :] = 2.0
    return m, [(i, j, m[i, j]) for i in range(n) for j in range(n) if m[i, j]]


def test_products_of_the_rectangular_pattern(spark):
    m = matrix(spark, RECT)
    a = dense(m, 6)
    assert np.array_equal(dense(sparse.multiply(m, m), 6), a @ a)
    gram = dense(sparse.multiply_transposed(m, m), 6)
    assert np.array_equal(gram, a @ a.T)
    assert np.array_equal(gram, gram.T)


@pytest.mark.parametrize("side_entries", [2, 1000])
def test_products_against_numpy(spark, side_entries):
    a, entries = random_entries(1, 20, 0.15)
    m = matrix(spark, entries)
    assert np.array_equal(dense(sparse.multiply(m, m, side_entries), 20), a @ a)
    assert np.array_equal(dense(sparse.multiply_transposed(m, m, side_entries), 20), a @ a.T)
    assert np.array_equal(dense(sparse.power(m, 3, side_entries=side_entries), 20), a @ a @ a)
    assert np.array_equal(dense(sparse.power(m, 3, "gram", side_entries), 20), a @ a.T @ a.T)
    assert np.array_equal(dense(sparse.power(m, 1), 20), a)


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_normalise_inflate_prune(spark, hot_rows):
    a, entries = random_entries(2, 15, 0.2)
    m = matrix(spark, entries)
    assert np.allclose(dense(sparse.normalize(m, hot_rows), 15), a / a.sum(axis=0), rtol=1e-14)
    for r in (2, 1.5):
        want = a**r / (a**r).sum(axis=0)
        inflated = sparse.inflate(m, r, hot_rows)
        assert np.allclose(dense(inflated, 15), want, rtol=1e-12)
        kept = dense(sparse.prune(inflated, 0.2), 15)
        assert np.allclose(kept, np.where(want > 0.2, want, 0))
    assert sparse.prune(matrix(spark, [(0, 0, 0.5), (0, 1, 0.4)]), 0.4).count() == 1


def test_converged(spark):
    def same(old, new):
        return sparse.converged(matrix(spark, old), matrix(spark, new)).first()["converged"]

    one = [(0, 0, 1.0), (1, 0, 0.5)]
    assert same(one, one)
    assert same(one, [(0, 0, 1.000009)])
    assert not same(one, [(0, 0, 1.0001)])
    assert same(one, [(0, 0, 1.0)])
    assert not same([(0, 0, 1.0)], one)
    assert same(one, [])


def test_loops(spark):
    m = matrix(spark, [(0, 1, 4.0), (2, 1, 7.0), (1, 1, 1.0)])
    assert {tuple(r) for r in sparse.with_loops(m, "max").filter("i = j").collect()} == {
        (0, 0, 1.0),
        (1, 1, 8.0),
        (2, 2, 1.0),
    }
    assert {tuple(r) for r in sparse.with_loops(m, 3).filter("i = j").collect()} == {
        (0, 0, 3.0),
        (1, 1, 4.0),
        (2, 2, 3.0),
    }


def two_blocks():
    pairs = [(a, b) for base in (0, 6) for a in range(base, base + 6) for b in range(base, base + 6) if a != b]
    return [(a, b, 5.0) for a, b in pairs] + [(2, 8, 0.5), (8, 2, 0.5)]


def test_textbook_mcl_finds_the_blocks(spark):
    found = mcl.mcl(matrix(spark, two_blocks()), loop_value=1, iterations=40).collect()
    assert {tuple(r["members"]) for r in found} == {tuple(range(6)), tuple(range(6, 12))}
    assert sorted(r["cluster_id"] for r in found) == list(range(len(found)))


def reference_passes(a, passes, product, threshold=0.001):
    for _ in range(passes):
        a = a @ a if product == "power" else a @ a.T
        a = a**2
        sums = a.sum(axis=0)
        a = np.divide(a, sums, out=np.zeros_like(a), where=sums > 0)
        a = np.where(a > threshold, a, 0)
    return a


@pytest.mark.parametrize("product", ["power", "gram"])
def test_raw_passes_against_numpy(spark, product):
    a, entries = random_entries(7, 14, 0.2)
    got = mcl.mcl_matrix(
        matrix(spark, entries), loop_value=0, normalize_input=False, iterations=3, product=product
    )
    assert np.allclose(dense(got, 14), reference_passes(a, 3, product), atol=1e-9)


def test_acyclic_power_mode_ends_empty(spark):
    chain = [(i, j, 1.0) for i in range(6) for j in range(i + 1, 6)]
    found = mcl.mcl(
        matrix(spark, chain), loop_value=0, normalize_input=False, iterations=5, product="power"
    )
    assert found.collect() == []


def test_pruning_frequency(spark):
    a, entries = random_entries(9, 12, 0.3)
    rare = mcl.mcl_matrix(
        matrix(spark, entries), loop_value=0, normalize_input=False, iterations=2,
        pruning_threshold=0.05, pruning_frequency=2,
    )
    once = reference_passes(a, 1, "power", 0.05)
    twice = (once @ once) ** 2
    sums = twice.sum(axis=0)
    want = np.divide(twice, sums, out=np.zeros_like(twice), where=sums > 0)
    assert np.allclose(dense(rare, 12), want, atol=1e-12)


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_clusters_and_parts(spark, hot_rows):
    m = matrix(spark, [(4, j, 0.5) for j in range(10)] + [(7, 7, 1.0), (8, 1, 1.0), (9, 9, 0.0)])
    whole = mcl.attractor_clusters(m, hot_rows=hot_rows).orderBy("cluster_id").collect()
    assert [(r["cluster_id"], r["attractor"], r["part"], r["members"]) for r in whole] == [
        (0, 4, 0, list(range(10))),
        (1, 7, 0, [7]),
    ]
    parts = mcl.attractor_clusters(m, max_members=3, hot_rows=hot_rows).orderBy("cluster_id", "part")
    assert [(r["attractor"], r["part"], r["members"]) for r in parts.collect()] == [
        (4, 0, [0, 1, 2]),
        (4, 1, [3, 4, 5]),
        (4, 2, [6, 7, 8]),
        (4, 3, [9]),
        (7, 0, [7]),
    ]


def test_routes(spark):
    members = spark.createDataFrame([(4, 4), (4, 5), (4, 6), (7, 4), (7, 7)], "attractor long, member long")
    edges = spark.createDataFrame(
        [(4, 5, 9), (5, 4, 8), (7, 4, 1), (4, 6, 1), (6, 7, 2)], "src long, dst long, normal long"
    )
    found = routes.sort_routes(routes.route_graph(members, edges)).collect()
    assert [tuple(r) for r in found] == [(4, 6, 1), (7, 4, 1), (4, 5, 9)]


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_equal_clusters_merge(spark, hot_rows):
    m = matrix(spark, [(i, j, 0.5) for i in (2, 5) for j in (2, 5, 9)] + [(7, 7, 1.0), (7, 9, 1.0), (8, 8, 1.0)])
    found = mcl.attractor_clusters(m, hot_rows=hot_rows, merge_equal=True).orderBy("cluster_id").collect()
    assert [(r["attractor"], r["members"]) for r in found] == [(2, [2, 5, 9]), (7, [7, 9]), (8, [8])]


def test_strict_convergence_sees_what_vanished(spark):
    old, new = matrix(spark, [(0, 0, 1.0), (0, 1, 0.5)]), matrix(spark, [(0, 0, 1.0)])
    assert sparse.converged(old, new).first()[0]
    assert not sparse.converged(old, new, strict=True).first()[0]
    assert sparse.converged(old, old, strict=True).first()[0]


def test_routes_from_saved_clusters(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 5), (1, 3, 7), (2, 1, 9), (4, 5, 1)], "src long, dst long, normal long")
    clusters = spark.createDataFrame(
        [(0, 1, 0, [1, 2]), (0, 1, 1, [3]), (1, 4, 0, [4, 5]), (1, 4, 1, [5]), (2, 9, 0, []), (3, 8, 0, None)],
        "cluster_id long, attractor long, part int, members array<long>",
    )
    saved = stages.write_stage(clusters, str(tmp_path), "clusters")
    rows = routes.route_graph(routes.listed_members(saved), edges).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 2, 5), (1, 3, 7), (4, 5, 1)]
    nested = clusters.select("cluster_id", F.struct(F.col("attractor").alias("src"), F.col("members").alias("value")).alias("nodes"))
    pairs = routes.listed_members(nested, "nodes.src", "nodes.value")
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)]


@pytest.mark.parametrize("side_entries", [2, 3, 1000])
def test_half_of_a_symmetric_product(spark, side_entries):
    """A · Aᵀ equals numpy's, by about half the pairs of the plain product."""
    a, entries = random_entries(5, 18, 0.25)
    m, copy = matrix(spark, entries), matrix(spark, entries)
    assert np.array_equal(dense(sparse.multiply_transposed(m, m, side_entries), 18), a @ a.T)
    assert np.array_equal(dense(sparse.multiply_transposed(m, m, side_entries, balanced=True), 18), a @ a.T)

    def pairs(right):
        met = []
        summed = sparse._summed
        sparse._summed = lambda frame: met.append(frame.count()) or summed(frame)
        try:
            sparse.multiply_transposed(m, right, side_entries)
        finally:
            sparse._summed = summed
        return met[0]

    both = sum(int(n) ** 2 for n in (a != 0).sum(axis=0))
    assert pairs(copy) == both and pairs(m) == (both + len(entries)) // 2


def _exchanges(df):
    return str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")


@pytest.mark.parametrize("product, most", [("power", 3), ("gram", 2)])
def test_a_pass_reads_its_matrix_as_it_lies(spark, product, most):
    """With copies that lie by column a pass needs two exchanges fewer than from plain copies."""
    a, entries = random_entries(6, 30, 0.2)
    keep = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in keep}
    for name, value in keep.items():
        spark.conf.set(name, value)
    try:
        plain = cut_lineage(matrix(spark, entries))
        laid = cut_bucketed(matrix(spark, entries), "j")
        one = lambda m: mcl._pass(m, 2, 2, product, True, True, 10**6, 0.001)
        assert _exchanges(one(laid)) == most and _exchanges(one(plain)) > most
        assert np.allclose(dense(one(laid), 30), reference_passes(a, 1, product))
        assert _exchanges(sparse.extent(laid)) < _exchanges(sparse.extent(plain))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_bucketed_copies_leave_no_tables(spark):
    def ours():
        return {t.name for t in spark.catalog.listTables() if t.name.startswith("cut_")}

    kept = ours()
    _, entries = random_entries(8, 12, 0.3)
    flow = mcl.mcl_matrix(matrix(spark, entries), iterations=4)
    # The last copy is the result; the one before goes as well.
    assert len(ours() - kept) == 1 and flow.count() > 0
