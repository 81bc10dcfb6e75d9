import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import column, gappy, sparse_grid
from sparkwatch.operators import boosting, forecast
from sparkwatch.operators.features import FeatureSpec
from sparkwatch.plans import forecasting
from sparkwatch.plans.forecasting import ForecastPlan

STEP = 3600


def noisy_day(n, seed=0):
    rng = np.random.default_rng(seed)
    return 100 + 20 * np.sin(2 * np.pi * np.arange(n) / 24) + rng.normal(0, 3, n)


def with_clean(grid, bad=()):
    return grid.withColumn("clean", ~F.col("pos").isin(*bad) if bad else F.lit(True))


def test_change_and_training_rows(spark):
    g = with_clean(sparse_grid(spark, {("a", "m"): [1.0, 4.0, np.nan, 7.0, 9.0, 12.0], ("z", "m"): np.ones(6)}), (4,))
    changes = forecast.with_change(g)
    assert column(changes, "target") == [None, 3.0, None, 2.0, 3.0]
    # position 4 is not clean, and neither is the anchor of position 5
    assert column(forecast.training_rows(changes), "pos") == [1]
    assert column(forecast.training_rows(forecast.with_change(g.drop("clean"))), "pos") == [1, 4, 5]
    levels = forecast.with_change(g, residual_target=False)
    assert column(levels, "target") == [1.0, 4.0, 7.0, 9.0, 12.0]


def test_short_series_are_named(spark):
    g = sparse_grid(spark, {("a", "m"): np.arange(150.0), ("b", "m"): np.append(np.arange(50.0), [np.nan] * 100)})
    counts = forecast.training_counts(g, forecast.training_rows(forecast.with_change(g)))
    with pytest.raises(ValueError, match="b/m: only 49"):
        forecast.require_rows(counts)


def test_predict_needs_a_model(spark):
    g = forecast.with_change(sparse_grid(spark, {("a", "m"): [1.0, 2.0]}))
    for predict in (lambda: forecast.predict_ladder(g, None), lambda: boosting.predict(g, [], None)):
        with pytest.raises(RuntimeError, match="fit before predict"):
            predict()


def test_hours_with_enough_rows_stand_alone(spark):
    g = sparse_grid(spark, {("a", "m"): noisy_day(24 * 50)}, STEP)
    train = forecast.training_rows(forecast.with_change(g))
    model = forecast.fit_ladder(train, min_bucket=50)
    # the first row has no change, so hour 0 has 49 rows
    assert sorted(r["hour"] for r in model.where("hour is not null").collect()) == list(range(1, 24))
    assert model.where("hour is null").count() == 1


@pytest.mark.parametrize("history", ["slice", "full"])
def test_ladder_interval_covers(spark, history):
    plan = ForecastPlan(day=24, history=history)
    g = with_clean(sparse_grid(spark, {("a", "m"): noisy_day(24 * 80)}, STEP))
    found = forecasting.predictions(g, plan)
    assert found.where("q is null").count() == (1 if history == "slice" else 0)
    by = {r["nominal"]: r["covered"] for r in forecasting.calibration(found).collect()}
    assert 0.8 < by[0.9] <= 1.0
    assert forecasting.honesty(found).first()["ks"] < 0.1


def test_report_on_chosen_services_keeps_the_axis(spark):
    values = noisy_day(24 * 30)
    values[:5] = np.nan
    g = with_clean(sparse_grid(spark, {("a", "m"): values, ("z", "m"): noisy_day(24 * 30, 1)}, STEP))
    plan = ForecastPlan(day=24, services=("a",))
    head = forecasting.run_header(g, plan, float(STEP)).first()
    assert (head["series"], head["train_steps"], head["test_steps"]) == (1, 503, 217)
    scored = forecasting.with_baselines(g, plan, forecasting.predictions(g, plan))
    assert scored.count() == 217
    row = forecasting.accuracy_by_metric(scored).first()
    pdf = scored.select("value", F.get("q", F.lit(3)).alias("forecaster"), "seasonal", "ewma").toPandas()
    for name in ("forecaster", "seasonal", "ewma"):
        by_hand = 0.5 * np.nanmean(np.abs(pdf["value"] - pdf[name])) / np.std(pdf["value"])
        assert row[name] == pytest.approx(by_hand)


def test_boosted_trees_learn_the_cycle_and_survive_missing_features(spark):
    config = boosting.BoostConfig(rounds=4, learning_rate=0.5, depth=2, min_leaf=20, bins=15, levels=(0.05, 0.5, 0.95))
    spec = FeatureSpec(day=24, lags=(1,), windows=(8,), days_back=(1,))
    g = with_clean(sparse_grid(spark, {("a", "m"): noisy_day(24 * 40), ("b", "m"): noisy_day(24 * 40, 1) * 3 + 7}, STEP))
    plan = ForecastPlan(day=24, levels=config.levels)
    found = forecasting.boosted_predictions(g, plan, spec, config)
    q = [F.get("q", F.lit(i)) for i in range(3)]
    by = (
        found.where("q is not null")
        .groupBy("service")
        .agg(
            F.avg(((F.col("value") >= q[0]) & (F.col("value") <= q[2])).cast("double")).alias("covered"),
            F.avg(F.abs(F.col("value") - q[1])).alias("loss"),
            F.avg(F.abs(F.col("value") - F.col("anchor"))).alias("naive"),
            F.count("*").alias("n"),
        )
        .collect()
    )
    assert {r["service"] for r in by} == {"a", "b"}
    for r in by:
        assert r["n"] == 287
        assert 0.75 < r["covered"] <= 1.0
        assert r["loss"] < 0.95 * r["naive"]


def test_one_split_is_the_best_split(spark):
    """A step in one feature is found exactly, and rows without the feature go to the better side."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        x = float(i % 20)
        high = x >= 12
        y = (10.0 if high else 0.0) + float(rng.normal(0, 0.1))
        rows.append(("a", "m", y, None if high and i % 3 == 0 else x, float(rng.random())))
    train = spark.createDataFrame(rows, "service string, metric string, target double, x double, noise double")
    config = boosting.BoostConfig(rounds=1, learning_rate=1.0, depth=1, min_leaf=40, bins=31, levels=(0.5,))
    model = boosting.fit(train, ["noise", "x"], config).first()
    feature, bin_, side = (np.frombuffer(model[n], t)[1] for n, t in (("feature", np.int16), ("bin", np.int16), ("side", bool)))
    assert feature == 1
    assert model["edges"][1][bin_] == 11.0
    assert not side


def boost_rows(spark, n=900):
    rng = np.random.default_rng(4)
    rows = []
    for name, count in (("a", n), ("b", n // 3), ("c", 30)):
        x, z = rng.normal(size=count), rng.integers(0, 5, count)
        y = 3 * (x > 0.3) + z * x + rng.normal(0, 0.3, count)
        rows += [(name, "m", float(t), None if i % 11 == 0 else float(u), float(w), float("nan") if i % 13 == 0 else float(v)) for i, (t, u, w, v) in enumerate(zip(y, x, z, y**2))]
    return spark.createDataFrame(rows, "service string, metric string, target double, x double, z double, square double")


def test_blocks_grow_the_trees_of_one_block(spark):
    """Histograms summed over blocks, siblings by subtraction and leaves over all blocks give what one block gives."""
    train = boost_rows(spark)
    models = []
    for block_rows in (5_000, 250):  # in the second a has four blocks and b two
        config = boosting.BoostConfig(rounds=3, learning_rate=0.3, depth=3, min_leaf=20, bins=40, levels=(0.1, 0.5), block_rows=block_rows)
        model = boosting.fit(train, ["x", "z", "square"], config)
        models.append({(r["service"], r["level"]): r.asDict() for r in model.collect()})
    assert models[0].keys() == models[1].keys() and len(models[0]) == 6
    for key, one in models[0].items():
        other = models[1][key]
        assert all(one[c] == other[c] for c in ("edges", "base", "feature", "side"))
        split = np.frombuffer(one["feature"], np.int16) >= 0
        assert (np.frombuffer(one["bin"], np.int16)[split] == np.frombuffer(other["bin"], np.int16)[split]).all()
        assert np.allclose(np.frombuffer(one["leaf"]), np.frombuffer(other["leaf"]), rtol=0, atol=1e-12)
        assert split.any() == (key[0] != "c")  # 30 rows cannot be split with 20 on either side


def test_trees_against_plain_python():
    """Splits by trying all thresholds on the rows themselves, without histograms."""
    from sparkwatch.functions import trees

    rng = np.random.default_rng(8)
    values = np.round(rng.normal(size=(160, 3)), 1)
    values[rng.random(values.shape) < 0.1] = np.nan
    target = np.where(np.nan_to_num(values[:, 1]) > 0.2, 2.0, 0.0) + rng.normal(size=160)
    edges = [np.unique(c[~np.isnan(c)]) for c in values.T]
    bins, slots = trees.to_bins(values, edges), trees.slots_of(edges)
    config = boosting.BoostConfig(rounds=4, learning_rate=0.4, depth=3, min_leaf=12)
    made = trees.grow(bins, target, 0.5, 0.3, config, slots)
    at = np.full(160, 0.5)
    for tree in made:
        node = np.ones(160, int)
        for k in range(1, 2**config.depth):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                assert tree.feature[k] < 0
                continue
            pull = lambda r: (0.7 * len(r) - (target[r] > at[r]).sum()) ** 2 / max(len(r), 1)
            best = (1e-9, -1, 0, False)
            for f in range(3):
                for b, edge in enumerate([*edges[f], np.inf]):
                    for side in (True, False):
                        missing = np.isnan(values[rows, f])
                        left = np.where(missing, side, values[rows, f] <= edge)
                        if min(left.sum(), (~left).sum()) >= config.min_leaf:
                            gain = pull(rows[left]) + pull(rows[~left]) - pull(rows)
                            if gain > best[0] + 1e-12:
                                best = (gain, f, b, side)
            if best[1] < 0:
                assert tree.feature[k] < 0
                continue
            chosen = np.where(np.isnan(values[rows, tree.feature[k]]), tree.side[k], bins[rows, tree.feature[k]] <= tree.bin[k])
            gain = pull(rows[chosen]) + pull(rows[~chosen]) - pull(rows)
            assert gain == pytest.approx(best[0]) and min(chosen.sum(), (~chosen).sum()) >= config.min_leaf
            node[rows] = 2 * k + np.where(chosen, 0, 1)
        for k in np.unique(node):
            assert tree.leaf[k] == pytest.approx(np.percentile((target - at)[node == k], 30))
        at = at + 0.4 * tree.leaf[node]
    arrays = [np.stack([getattr(t, name) for t in made]) for name in ("feature", "bin", "side", "leaf")]
    assert np.allclose(trees.add_up(bins, 0.5, *arrays, 0.4, 3, slots - 1), at)


def test_prediction_in_parts_and_without_a_model(spark):
    config = boosting.BoostConfig(rounds=2, depth=2, min_leaf=20, bins=20, levels=(0.1, 0.9))
    rows = boost_rows(spark).withColumn("anchor", F.lit(1.0)).withColumn("text", F.lit("kept"))
    model = boosting.fit(rows.where("service = 'a'"), ["x", "z", "square"], config)
    whole = boosting.predict(rows, ["x", "z", "square"], model, config)
    parts = boosting.predict(rows, ["x", "z", "square"], model, boosting.BoostConfig(**{**vars(config), "block_rows": 100}))
    assert whole.columns == [*rows.columns, "q"]
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, parts.collect()))
    assert whole.where("q IS NULL").select("service").distinct().count() == 2
    assert whole.where("q IS NOT NULL").count() == 900
    none = boosting.predict(rows.limit(0), ["x", "z", "square"], model, config)
    assert none.collect() == [] and none.columns == whole.columns


def test_models_have_only_the_nodes_of_their_trees(spark):
    """At the default depth and rounds, models of short series are as short as their trees."""
    config = boosting.BoostConfig(rounds=20, levels=(0.1, 0.5))
    model = boosting.fit(boost_rows(spark, 300), ["x", "z", "square"], config).collect()
    assert len(model) == 6
    for r in model:
        feature, node = np.frombuffer(r["feature"], np.int16), np.frombuffer(r["node"], np.int32)
        # the root and a node 0 per tree, and two nodes per split, with at least 40 rows each
        assert len(feature) == len(node) == 2 * (config.rounds + (feature >= 0).sum()) <= 2 * config.rounds * 300 // 40
        assert len(r["leaf"]) == 8 * len(node) and len(r["bin"]) == 2 * len(node) and len(r["side"]) == len(node)
        assert (feature >= 0).any() or r["service"] != "a"


def test_packed_trees_come_back():
    from sparkwatch.functions import trees

    made = [trees.Tree(3) for _ in range(3)]
    made[0].split(1, 4, 9, True)
    made[0].split(3, 2, 1, False)
    made[2].split(1, 0, 0, False)
    for k, tree in enumerate(made):
        at = tree.nodes()[1:]
        tree.leaf[at] = np.arange(len(at)) + k
    arrays = trees.packed(made)
    assert arrays["node"].tolist() == [0, 1, 2, 3, 6, 7, 0, 1, 0, 1, 2, 3]
    for name, whole in zip(("feature", "bin", "side", "leaf"), trees.unpacked(*arrays.values(), 16)):
        assert (whole == np.stack([getattr(t, name) for t in made])).all() and whole.dtype == getattr(made[0], name).dtype


def test_too_few_rows_stop_the_ladder_too(spark):
    g = sparse_grid(spark, {("a", "m"): list(range(20))}).withColumn("clean", F.lit(True))
    with pytest.raises(ValueError, match="a/m: only"):
        forecasting.fit(g, forecasting.ForecastPlan(day=4))
    assert forecasting.fit(g, forecasting.ForecastPlan(day=4, least_rows=0)).count() == 1


def test_too_few_rows_may_be_a_warning(spark):
    g = sparse_grid(spark, {("a", "m"): list(range(20)), ("b", "m"): list(range(200))}).withColumn("clean", F.col("service") == "b")
    plan = forecasting.ForecastPlan(day=4, short="warn")
    with pytest.warns(UserWarning, match="a/m: only 0"):
        rows = forecasting.predictions(g, plan).collect()
    assert {r["service"] for r in rows if r["q"] is not None} == {"b"}
    with pytest.raises(ValueError, match="short must be"):
        forecasting.fit(g, forecasting.ForecastPlan(day=4, short="skip"))


def test_level_targets_in_a_plan(spark):
    g = sparse_grid(spark, {("a", "m"): [float(10 + i % 2) for i in range(60)]}).withColumn("clean", F.lit(True))
    plan = forecasting.ForecastPlan(day=4, least_rows=0, residual_target=False, levels=(0.1, 0.5, 0.9))
    rows = forecasting.predictions(g, plan).collect()
    assert all(r["q"] == [10.0, 10.5, 11.0] or r["q"] == [10.0, 10.0, 11.0] or r["q"] == [10.0, 11.0, 11.0] for r in rows)
    assert len(rows) == 18 and all(r["q"] is not None for r in rows)
