"""Training cycles, evolution and online updates against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowlane import registry
from sparrowlane.operators import training as L
from sparrowlane.plans import base, learning, streams


def rows_of(spark, x, t, groups=None):
    data = [(i, x[i].tolist(), t[i].tolist(), "" if groups is None else groups[i]) for i in range(len(x))]
    return spark.createDataFrame(data, "id long, v array<double>, t array<double>, g string").repartition(4)


def plain_fit(x, t, adapter, epochs, rate):
    """Gradient steps over all rows, without moments."""
    u, v, losses = adapter.u.copy(), adapter.v.copy(), []
    for _ in range(epochs):
        error = x + (x @ u) @ v.T - t
        losses.append(float((error**2).mean()))
        scale = 2 / error.size * rate * x.shape[1]
        u, v = u - scale * x.T @ (error @ v), v - scale * error.T @ (x @ u)
    return u, v, losses


def test_fit_by_moments_equals_a_fit_by_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 6))
    t = x + 0.2 * x[:, ::-1]
    start = L.LowRank.seeded(6, 3)
    got = start.trained(L.moments(rows_of(spark, x, t))[None], 40, 0.05)
    u, v, losses = plain_fit(x, t, start, 40, 0.05)
    assert np.allclose(got.u, u) and np.allclose(got.v, v) and got.losses == pytest.approx(losses) and losses[-1] < losses[0]


def test_moments_by_group(spark):
    rng = np.random.default_rng(2)
    x, t = rng.normal(size=(30, 4)), rng.normal(size=(30, 4))
    groups = [str(i % 3) for i in range(30)]
    for k, m in L.moments(rows_of(spark, x, t, groups), group="g").items():
        own = np.array([g == k for g in groups])
        assert m.n == 10 and np.allclose(m.xx, x[own].T @ x[own]) and np.allclose(m.xt, x[own].T @ t[own])
        assert m.loss(np.eye(4)) == pytest.approx(((x[own] - t[own]) ** 2).mean())


def _tables(spark, d):
    rows = {r["vec_id"]: (np.array(r["v"]), r["label"]) for r in base.corpus(spark, d).collect()}
    centre = {label: np.mean([v for v, own in rows.values() if own == label], axis=0) for label in {own for _, own in rows.values()}}
    return rows, centre


def _unit(x):
    return x / np.linalg.norm(x)


def test_sedimentation_cycle(spark, tiny):
    got = {}
    for r in registry.queries()["LEARN-1-CYCLE"](spark, tiny).collect():
        got.setdefault(r["mode"], {})[r["vec_id"]] = r
    rows, centre = _tables(spark, tiny)
    log = {}
    for r in learning.chelation_log(base.scout(spark, tiny)).collect():
        log.setdefault(r["vec_id"], []).append(np.array(r["centre"]))
    chosen = sorted(i for i, c in log.items() if len(c) >= 2)
    assert chosen and set(got) == set(learning.MODES)
    x = np.array([rows[i][0] for i in chosen])
    for mode in ("baseline", "offline"):
        noise = [np.mean(log[i], axis=0) for i in chosen]
        t = [_unit(v + 0.1 * (v - n) / np.linalg.norm(v - n)) if mode == "baseline" else _unit(centre[rows[i][1]]) for i, v, n in zip(chosen, x, noise, strict=True)]
        u, v, losses = plain_fit(x, np.array(t), L.LowRank.seeded(64, learning.RANK), learning.EPOCHS, learning.RATE)
        new = x + (x @ u) @ v.T
        for i, old, y in zip(chosen, x, new, strict=True):
            assert got[mode][i]["moved"] == pytest.approx(np.linalg.norm(_unit(y) - old), abs=2e-6)
        assert {i for i, r in got[mode].items() if r["updated"]} == set(chosen)
        assert got[mode][chosen[0]]["first_loss"] == pytest.approx(losses[0], abs=1e-8) and got[mode][chosen[0]]["last_loss"] == pytest.approx(losses[-1], abs=1e-8)


def test_a_cycle_whose_write_fails_is_rolled_back(spark, tiny):
    collection = learning.paired(spark, tiny).select("vec_id", "label", "v", "q")
    log = spark.createDataFrame([(i, [0.5] * 64) for i in (1, 1, 2, 2, 3)], "vec_id long, centre array<double>")
    after, left, adapter = learning.cycle(spark, collection, log, 2, "baseline", 3, 0.05, fails="vec_id = 2")
    assert adapter is None and left.count() == 5 and after.exceptAll(collection).count() == 0
    after, left, adapter = learning.cycle(spark, collection, log, 2, "baseline", 3, 0.05)
    assert adapter is not None and left.count() == 0 and after.count() == collection.count()
    assert {r["vec_id"] for r in after.exceptAll(collection).collect()} == {1, 2}
    same, left, adapter = learning.cycle(spark, collection, log, 9, "baseline", 3, 0.05)
    assert adapter is None and left.count() == 0 and same.exceptAll(collection).count() == 0
    with pytest.raises(ValueError):
        learning.cycle(spark, collection, log, 2, "none", 3, 0.05)


def test_offline_distillation(spark, tiny):
    got = {r["vec_id"]: r for r in registry.queries()["LEARN-2-CYCLE"](spark, tiny).collect()}
    rows, centre = _tables(spark, tiny)
    ids = sorted(rows)
    x = np.array([rows[i][0] for i in ids])
    t = np.array([_unit(0.5 * rows[i][0] + 0.5 * centre[rows[i][1]]) for i in ids])
    u, v, losses = plain_fit(x, t, L.LowRank.seeded(64, learning.RANK), learning.EPOCHS, learning.RATE)
    new = x + (x @ u) @ v.T
    for i, y, target in zip(ids, new, t, strict=True):
        assert got[i]["after"] == pytest.approx(_unit(y) @ target, abs=2e-6)
    assert got[ids[0]]["last_loss"] == pytest.approx(losses[-1], abs=1e-8)


def test_hierarchical_sedimentation(spark, tiny):
    from sparrowlane.operators import graph

    got = {r["cluster"]: r for r in registry.queries()["LEARN-3-CYCLE"](spark, tiny).collect()}
    rows, centre = _tables(spark, tiny)
    cells = {r["id"]: r["cluster"] for r in graph.variance_median_partition(base.corpus(spark, tiny).select("vec_id", "v"), learning.CLUSTERS, "vec_id", "v").collect()}
    target = {i: _unit(v + 0.1 * (v - centre[c]) / np.linalg.norm(v - centre[c])) for i, (v, c) in rows.items()}
    adapter = L.LowRank.seeded(64, learning.RANK)
    for name in [*sorted(set(cells.values())), "*"]:
        ids = sorted(i for i in rows if name in ("*", cells[i]))
        x, t = np.array([rows[i][0] for i in ids]), np.array([target[i] for i in ids])
        loss = lambda a: float(((x + (x @ a.u) @ a.v.T - t) ** 2).mean())  # noqa: B023, E731
        before = loss(adapter)
        u, v, _ = plain_fit(x, t, adapter, learning.EPOCHS, learning.RATE * (0.1 if name == "*" else 1))
        adapter = L.LowRank(u, v)
        assert got[name]["n"] == len(ids) and got[name]["before"] == pytest.approx(before, abs=1e-8) and got[name]["after"] == pytest.approx(loss(adapter), abs=1e-8)


def test_shaping():
    f = np.array([3.0, 1.0, 2.0])
    assert L.shaped(f, "centered_rank").tolist() == [0.5, -0.5, 0.0]
    assert L.shaped(f, "linear_rank") == pytest.approx([3 / 6 - 1 / 3, 1 / 6 - 1 / 3, 2 / 6 - 1 / 3])
    assert L.shaped(f, "zscore").mean() == pytest.approx(0) and L.shaped(np.ones(3), "zscore").tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        L.shaped(f, "none")
    a, b = (L.perturbation((2, 2), 5, k, 0.1, True) for k in (4, 5))
    assert (a == -b).all() and (L.perturbation((2, 2), 5, 4, 0.1, False) != L.perturbation((2, 2), 5, 5, 0.1, False)).any()


def test_evolution_climbs_and_rolls_back():
    goal = np.full((3, 2), 0.5)
    score = lambda p, steps: np.array([-((p + s - goal) ** 2).sum() for s in steps] + [-((p - goal) ** 2).sum()])
    end, history = L.evolve(np.zeros((3, 2)), score, 30, rate=0.02, sigma=0.05, seed=3)
    assert -((end - goal) ** 2).sum() > -0.05 and [g.elite for g in history] == sorted(g.elite for g in history)
    wild, history = L.evolve(np.zeros((3, 2)), score, 3, rate=50.0, sigma=0.05, seed=3)
    assert any(g.rolled_back for g in history) and -((wild - goal) ** 2).sum() >= -1.5
    again, _ = L.evolve(np.zeros((3, 2)), score, 3, rate=50.0, sigma=0.05, seed=3)
    assert (wild == again).all()


def test_evolution_query_equals_plain_arrays(spark, tiny):
    got = {(r["run"], r["generation"]): r for r in registry.queries()["LEARN-8"](spark, tiny).collect()}
    rows, centre = _tables(spark, tiny)
    x = np.array([v for v, _ in rows.values()])
    t = np.array([_unit(v + 0.1 * (v - centre[c]) / np.linalg.norm(v - centre[c])) for v, c in rows.values()])
    start = L.LowRank.seeded(64, learning.RANK)
    fitness = lambda u: -float(((x + (x @ u) @ start.v.T - t) ** 2).mean())
    score = lambda u, steps: np.array([fitness(u + s) for s in steps] + [fitness(u)])
    for shaping in learning.SHAPINGS:
        for g in L.evolve(start.u, score, 5, seed=42, shaping=shaping, antithetic=shaping == "zscore")[1]:
            r = got[shaping, g.number]
            assert (r["best"], r["fitness"], r["elite"]) == pytest.approx((g.best, g.fitness, g.elite), abs=1e-7) and r["rolled_back"] == g.rolled_back


def _scout(spark, d):
    lists = {}
    for r in base.scout(spark, d).orderBy("query_id", "rank").collect():
        lists.setdefault(r["query_id"], []).append(r)
    return lists


def test_online_evolution_equals_plain_arrays(spark, tiny):
    got = registry.queries()["LEARN-9-EVOLVED"](spark, tiny).orderBy("generation").collect()
    lists = _scout(spark, tiny)
    start = L.LowRank.seeded(64, learning.RANK)

    def fitness(u):
        m, values = L.LowRank(u, start.v).matrix, []
        for hits in lists.values():
            for k, r in enumerate(hits):
                values.append((1 if k < len(hits) // 2 else -1) * float(_unit(np.array(r["q"]) @ m) @ _unit(np.array(r["v"]) @ m)))
        return float(np.mean(values))

    score = lambda u, steps: np.array([fitness(u + s) for s in steps] + [fitness(u)])
    for r, g in zip(got, L.evolve(start.u, score, 3, members=8, seed=7)[1], strict=True):
        assert (r["mean"], r["best"], r["fitness"]) == pytest.approx((g.mean, g.best, g.fitness), abs=1e-7)


def test_retrieval_fitness_of_the_identity(spark, tiny):
    """The fitness of unchanged vectors is that of the ranking as it is."""
    lists = _scout(spark, tiny)
    got = registry.queries()["LEARN-13"](spark, tiny).orderBy("run").collect()
    assert [r["run"] for r in got] == [f"cycle-{k}" for k in range(3)]

    def fitness(m):
        out = []
        for hits in lists.values():
            scores = np.array([round(float(_unit(np.array(r["q"]) @ m) @ _unit(np.array(r["v"]) @ m)), 12) for r in hits])
            grades = np.array([float(r["label"] == r["query_label"]) for r in hits])[np.argsort(-scores, kind="stable")]
            top, w = grades[:10], 1 / np.log2(np.arange(2, 12))
            ideal = np.sort(top)[::-1] @ w
            first = next((1 / (k + 1) for k, g in enumerate(top) if g), 0.0)
            out.append(0.6 * (top @ w / ideal if ideal else 0) + 0.2 * first + 0.2 * (top.sum() / grades.sum() if grades.sum() else 0))
        return float(np.mean(out))

    start = L.LowRank.seeded(64, learning.RANK)
    score = lambda u, steps: np.array([fitness(L.LowRank(x, start.v).matrix) for x in (*(u + s for s in steps), u)])
    _, history = L.evolve(start.u, score, 1, members=8, sigma=0.2, rate=0.5, seed=11)
    assert (got[0]["mean"], got[0]["best"]) == pytest.approx((history[0].mean, history[0].best), abs=1e-6)


def test_mask_pretraining(spark, tiny):
    got = registry.queries()["LEARN-10-TRAINED"](spark, tiny).collect()
    assert len(got) == 64 and got[0]["last_loss"] < got[0]["first_loss"]
    targets = registry.queries()["LEARN-10"](spark, tiny).groupBy("pos").agg(F.avg(F.col("target").cast("double")).alias("t")).collect()
    want = {r["pos"]: r["t"] for r in targets}
    assert all(r["target"] == pytest.approx(want[r["pos"]], abs=1e-6) for r in got)


def test_online_updates_equal_a_loop(spark, tiny):
    got = [(r["query_id"], r["loss"], r["moved"]) for r in registry.queries()["STREAM-6-UPDATES"](spark, tiny).orderBy("update").collect()]
    adapter, want = L.LowRank.seeded(64, learning.RANK), []
    for k, (q, hits) in enumerate(sorted(_scout(spark, tiny).items())):
        if k % streams.EVERY == 0 and len(hits) >= 4:
            half = len(hits) // 2
            v = np.array([r["v"] for r in hits])
            x, m = np.array(hits[0]["q"]), np.eye(64) + adapter.u @ adapter.v.T
            p, n = v[:half].mean(axis=0), v[half:].mean(axis=0)
            loss = max(0.0, streams.MARGIN - (x @ m) @ (p @ m) + (x @ m) @ (n @ m))
            if loss:
                step, e = np.zeros((64, 64)), 1e-6
                f = lambda m: (x @ m) @ ((n - p) @ m)  # noqa: B023, E731
                for i in range(64):
                    for j in range(64):
                        d = np.zeros((64, 64))
                        d[i, j] = e
                        step[i, j] = (f(m + d) - f(m - d)) / (2 * e)
                adapter = L.LowRank(adapter.u - streams.ONLINE_RATE * step @ adapter.v, adapter.v - streams.ONLINE_RATE * step.T @ adapter.u)
            want.append((q, loss, float(np.linalg.norm(adapter.u @ adapter.v.T))))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-6)


def test_classifier_gate(spark, tiny):
    from sparrowlane.operators.adapters import fit_standardised

    got = {r["split"]: r for r in registry.queries()["GATE-6-CLASSIFIER"](spark, tiny).collect()}
    rows = sorted((r["win"], r["task"], r["profile"], r["base"], float(r["n"]), r["ndcg"], r["delta"]) for r in base.experiments(spark, tiny).collect())
    first = max(1, round(len(rows) * 0.6))
    train = spark.createDataFrame([(*r[3:6], float(r[6] > 0.001)) for r in rows[:first]], "base double, n double, ndcg double, y double")
    w, b, centre, scale = fit_standardised(train, ["base", "n", "ndcg"], "y", l2=0.08)
    for name, part in (("train", rows[:first]), ("validation", rows[first:])):
        chosen = [r[6] for r in part if (np.array(r[3:6]) - centre) / scale @ w + b >= 0]
        assert (got[name]["support"] if name in got else 0) == len(chosen)
        if chosen:
            assert got[name]["mean"] == pytest.approx(np.mean(chosen), abs=1e-6) and got[name]["negative"] == sum(x < 0 for x in chosen)


def test_detection_cache_equals_a_loop(spark, tiny):
    from sparrowlane.plans.streams import BUCKETS, CACHED

    got = {r["bucket"]: (r["requests"], r["hits"], r["evictions"], r["held"]) for r in registry.queries()["STREAM-7-CACHE"](spark, tiny).collect()}
    rows = spark.read.parquet(f"{tiny}/conversations.parquet").withColumn("bucket", F.pmod(F.xxhash64("text"), F.lit(BUCKETS)).cast("int")).orderBy("conv_id", "turn").collect()
    want = {}
    for r in rows:
        held, n = want.setdefault(r["bucket"], ({}, [0, 0, 0]))
        n[0] += 1
        if r["text"] in held:
            n[1] += 1
            continue
        if len(held) >= CACHED:
            for old in list(held)[: CACHED // 2]:
                del held[old]
            n[2] += 1
        held[r["text"]] = None
    assert got == {k: (*n, len(held)) for k, (held, n) in want.items()}
