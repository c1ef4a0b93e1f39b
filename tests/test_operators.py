import numpy as np
import pytest

from gapweave.functions import kernels as kn
from gapweave.operators import connectivity as cn
from gapweave.operators import graphs as gr
from gapweave.operators import grouped as gp
from gapweave.operators import inference as nf
from gapweave.operators import segments as sg
from gapweave.operators import states as st
from gapweave.operators import templates as tm
from gapweave.plans.catalogue import QUERIES
from gapweave.sources import panel as pn


def make(spark, values, frames, subject="a", session="1"):
    rows = [(subject, session, int(f), k, f"r{k}", float(v)) for f, row in zip(frames, values) for k, v in enumerate(row)]
    return spark.createDataFrame(rows, "subject string, session string, frame long, roi_idx int, roi string, x double")


def test_windows_restart_in_each_segment(spark):
    frames = [0, 1, 2, 3, 4, 8, 9, 10, 11, 12, 13, 14]
    panel = make(spark, np.random.default_rng(1).normal(size=(12, 4)), frames)
    got = [tuple(r) for r in sg.window_table(panel, 4, 2).orderBy("start_frame").select("segment_id", "start_frame", "end_frame").collect()]
    assert got == [(0, 0, 3), (1, 8, 11), (1, 10, 13)]
    fc = cn.window_fc(panel, 4, 2).groupBy("start_frame").count().orderBy("start_frame").collect()
    assert [tuple(r) for r in fc] == [(0, 6), (8, 6), (10, 6)]


def test_correlation_signs_and_variance_floor(spark):
    n = np.arange(6.0)
    got = {(r.i, r.j): r.r for r in cn.static_correlation(make(spark, np.column_stack([n, 2 * n, -n, 0 * n]), range(6))).collect()}
    assert got[0, 1] == pytest.approx(1) and got[0, 2] == pytest.approx(-1) and got[0, 3] is None


def test_rss_equals_the_edges(spark):
    panel = make(spark, np.random.default_rng(2).normal(size=(8, 3)), [0, 1, 2, 3, 8, 9, 10, 11])
    edges = cn.ets_edges(panel).groupBy("frame").agg({"product": "collect_list"}).collect()
    rss = {r.frame: r.rss for r in cn.ets_rss(panel).collect()}
    for frame, products in edges:
        assert rss[frame] == pytest.approx(np.sqrt(np.sum(np.square(products))))


def test_derivatives_do_not_cross_gaps(spark):
    got = cn.mtd_derivatives(make(spark, np.random.default_rng(3).normal(size=(8, 3)), [0, 1, 2, 3, 8, 9, 10, 11]))
    assert sorted({(r.frame, r.end_frame) for r in got.collect()}) == [(0, 1), (1, 2), (2, 3), (8, 9), (9, 10), (10, 11)]


@pytest.mark.parametrize("n", [20, 21])
def test_phase_equals_the_fourier_form(spark, n):
    x = np.random.default_rng(4).normal(size=(n, 2))
    got = {(r.frame, r.roi_idx): r.phase for r in cn.analytic_phase(make(spark, x, range(n))).collect()}
    c = np.fft.fft(x - x.mean(axis=0), axis=0)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    want = np.angle(np.fft.ifft(c * h[:, None], axis=0))
    for (f, k), p in got.items():
        assert np.cos(p - want[f, k]) == pytest.approx(1, abs=1e-9)


def test_state_metrics_golden(spark):
    rows = [("a", "1", 0, 0, 0), ("a", "1", 0, 1, 0), ("a", "1", 0, 2, 1), ("a", "1", 1, 9, 1), ("a", "1", 1, 10, 0)]
    labels = spark.createDataFrame(rows, "subject string, session string, segment_id long, start_frame long, state int")
    assert [r.occupancy for r in st.occupancy(labels, 2).orderBy("state").collect()] == pytest.approx([0.6, 0.4])
    assert [r.mean_dwell for r in st.dwell(labels).orderBy("state").collect()] == pytest.approx([1.5, 1.0])
    assert [r.n for r in st.transitions(labels, 2).orderBy("from_state", "to_state").collect()] == [1, 1, 1, 0]
    r = st.switch_rate(labels).first()
    assert (r.possible, r.switches, r.switch_rate) == (3, 2, pytest.approx(2 / 3))


def test_graph_golden(spark):
    key = [("g",)] * 10
    w = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    edges = spark.createDataFrame([(*k, i, j, x) for k, (i, j), x in zip(key, pairs, w)], "g string, i int, j int, w double")
    assert sorted(r.w for r in gr.thresholded(edges, ["g"], 0.3, 5).collect()) == [0.8, 0.9, 1.0]
    two = spark.createDataFrame([("g", a, b, 1.0) for a, b in [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)]], "g string, i int, j int, w double")
    part = ["x"] * 3 + ["y"] * 3
    assert gr.modularity(two, ["g"], part).first().modularity == pytest.approx(0.5)
    assert all(r.participation == 0 for r in gr.participation(two, two.select("g").distinct(), ["g"], part).collect())


def test_bh_and_sign_flip_golden(spark):
    rows = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", None), ("f", 0.03), ("f", 0.002)], "family string, p double")
    got = {r.p: r.q for r in nf.bh(rows, ["family"]).collect()}
    assert got[0.01] == pytest.approx(0.02) and got[0.04] == pytest.approx(0.04) and got[0.03] == pytest.approx(0.04) and got[0.002] == pytest.approx(0.008) and got[None] is None
    d = spark.createDataFrame([("e", "s1", 1.0), ("e", "s2", 2.0)], "endpoint string, subject string, diff double")
    r = nf.sign_flip_exact(d).first()
    assert (r.estimate, r.p) == (1.5, 0.5)


def test_folds_are_balanced_and_independent_of_order(spark):
    names = [f"sub-{i}" for i in range(11)]
    a = {r.subject: r.fold for r in st.subject_folds(spark.createDataFrame([(n,) for n in names], "subject string"), 4, 17).collect()}
    b = {r.subject: r.fold for r in st.subject_folds(spark.createDataFrame([(n,) for n in names[::-1]], "subject string"), 4, 17).collect()}
    assert a == b and sorted(list(a.values()).count(k) for k in range(4)) == [2, 3, 3, 3]


def test_leakage_and_panel_checks(spark):
    panel = make(spark, np.ones((3, 2)), range(3))
    with pytest.raises(ValueError):
        pn.check_subjects_disjoint(panel, panel)
    pn.check_panel(panel)
    with pytest.raises(ValueError):
        pn.check_panel(panel.unionByName(panel))


def test_template_weighs_subjects_equally(spark):
    rows = spark.createDataFrame([("a", [0.0])] * 100 + [("b", [10.0])], "subject string, values array<double>")
    assert tm.feature_template(rows).first().template == pytest.approx(5.0)


def test_information_golden():
    x = np.random.default_rng(20260818).normal(size=(240, 7))
    x[:, 3] += 0.65 * x[:, 0]
    x[:, 4] += 0.45 * x[:, 1]
    assert kn.knn_mi(x[:, 0], x[:, 3]) == pytest.approx(0.1847943721630072, abs=1e-12)
    assert kn.knn_cmi(x[:, 0], x[:, 3], x[:, 6]) == pytest.approx(0.22145108731264973, abs=1e-12)
    mi, cmi = kn.block_information(x, [0, 1], [3, 4], [5, 6])
    assert mi.mean() == pytest.approx(0.06705220787794008, abs=1e-9) and cmi.mean() == pytest.approx(0.07152210379839707, abs=1e-9)


def test_assignment_and_matching_golden():
    rng = np.random.default_rng(0)
    from itertools import permutations

    for _ in range(30):
        c = rng.normal(size=(4, 5))
        best = min(sum(c[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))
        assert sum(c[i, j] for i, j in enumerate(kn.assignment(c))) == pytest.approx(best)
    got = kn.matched(np.array([[0.0], [-0.9]]), np.array([[0.0], [0.9]]), np.array([1.0]))
    assert [(a, b) for a, b, _ in got] == [(0, 1), (1, 0)]


def test_matching_on_a_line(monkeypatch):
    rng = np.random.default_rng(3)

    def best(a, b, caliper):  # most pairs, then the least sum, by trying all
        if not len(a):
            return 0, 0.0
        found = [best(a[1:], b, caliper)]
        for j in np.flatnonzero(np.abs(b - a[0]) <= caliper):
            n, cost = best(a[1:], np.delete(b, j), caliper)
            found.append((n - 1, cost + abs(b[j] - a[0]) / caliper))
        return min(found)

    for cells in (1, 5, 1 << 25):
        monkeypatch.setattr(kn, "LINE_CELLS", cells)
        for k in range(60):
            a, b = (rng.integers(-12, 12, n) * (0.1 if k % 2 else 0.37) for n in rng.integers(1, 6, 2))
            got = kn.matched(a[:, None], b[:, None], np.array([0.8]))
            n, cost = best(a, b, 0.8)
            assert len(got) == -n and sum(c for _, _, c in got) == pytest.approx(cost)
            assert len({i for i, _, _ in got}) == len({j for _, j, _ in got}) == len(got) and all(abs(a[i] - b[j]) <= 0.8 for i, j, _ in got)
    assert kn.matched(np.array([[np.nan], [1.0]]), np.array([[1.5], [np.nan]]), np.array([1.0])) == [(1, 0, 0.5)]


def test_matching_takes_no_square_of_the_rows():
    import tracemalloc

    rng = np.random.default_rng(4)
    a, b = (np.round(rng.uniform(-1000, 10000, (3000, 1)), 2) for _ in range(2))
    tracemalloc.start()
    got = kn.matched(a, b, np.array([50.0]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) > 2800 and peak < 20e6  # one square of doubles is 72 MB


def test_intercept_t_of_equal_differences(spark):
    import duckdb
    from pyspark.sql import functions as F

    rows = [("up", 0.1), ("up", 0.1), ("up", 0.1), ("down", -0.5), ("down", -0.5), ("zero", 0.0), ("zero", 0.0), ("one", 1.0), ("plain", 0.5), ("plain", 0.75)]
    got = nf.intercept_t(spark.createDataFrame(rows, "endpoint string, diff double")).withColumns({"mean": F.round("mean", 6) + 0.0, "t": F.round("t", 6) + 0.0})
    sql = "SELECT endpoint, count(*)::BIGINT AS n, round(avg(diff), 6) + 0.0 AS mean, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 6) + 0.0 AS t FROM (VALUES " + ", ".join(f"('{e}', {d}::DOUBLE)" for e, d in rows) + ") AS pr (endpoint, diff) GROUP BY ALL"
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, duckdb.sql(sql).fetchall()))


def test_hc3_golden():
    c = 1 / np.sqrt(2)
    r = kn.ols_hc3(np.array([c - 1, c, c + 1]), np.ones((3, 1)))
    assert r["se"][0] == pytest.approx(c) and r["t"][0] == pytest.approx(1) and r["p"][0] == pytest.approx(0.42264973081037427)


def test_hmm_recovers_two_states():
    rng = np.random.default_rng(5)
    truth = np.repeat([0, 1, 0, 1], 20)
    mu = np.array([[-3, -1, 0.5], [3, 1, -0.5]])
    x = mu[truth] + rng.normal(scale=0.25, size=(80, 3))
    model = {"start": np.full(2, 0.5), "move": np.array([[0.9, 0.1], [0.1, 0.9]]), "mean": mu + 0.5, "cov": np.array([np.eye(3)] * 2)}
    before = -np.inf
    for _ in range(5):
        s = kn.statistics(x, model)
        assert s["loglik"] >= before - 1e-6
        before, model = s["loglik"], kn.m_step([s])
    assert (kn.viterbi(x, model) == truth).all()
    assert np.allclose(model["mean"], mu, atol=0.2)


def test_hmm_fits_until_the_tolerance(spark):
    rng = np.random.default_rng(9)
    x = np.repeat([0.0, 1.0, 0.0, 1.0], 15)[:, None] * [1.5, -1.5] + rng.normal(size=(60, 2))  # overlapping states: slow
    rows = spark.createDataFrame([("a", "F", 0, i, v.tolist()) for i, v in enumerate(x)], "subject string, session string, segment_id long, start_frame long, values array<double>")
    model = gp.hmm_fit(rows, 2, 11)
    assert model["converged"] and 5 < model["n_iter"] <= 200
    assert abs(kn.statistics(x, model)["loglik"] - model["loglik"]) < 1e-2
    with pytest.warns(UserWarning, match="not reached in 2 rounds"):
        assert not gp.hmm_fit(rows, 2, 11, n_iter=2)["converged"]


@pytest.mark.parametrize("name", ["hmm_decode", "hmm_score"])
def test_hmm_queries_do_not_cut_the_fit(spark, monkeypatch, name):
    asked = []
    monkeypatch.setattr(gp, "hmm_fit", lambda *a, **how: asked.append(how))
    monkeypatch.setattr(gp, name, lambda rows, model: rows)
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked[0].get("n_iter", 200) == 200 and asked[0].get("tol", 1e-3) == 1e-3


def test_oracles_agree_on_the_small_panel(spark):
    import duckdb

    from gapweave.plans.catalogue import ORACLES, QUERIES

    d, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("lineitem", "orders", "supplier", "customer"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("segments", "window_positions", "ets_rss", "graph_threshold", "state_occupancy", "hc3_simple"):
        df = QUERIES[name](spark, d)
        cols = sorted(df.columns)
        got = sorted(map(repr, (tuple(r) for r in df.select(cols).collect())))
        want = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
        assert got == sorted(map(repr, want)), name
