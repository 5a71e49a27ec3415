"""Fits, queries and errors through DataFrames."""

import pytest
from pyspark.sql import functions as F

from cdfloom import errors
from cdfloom.functions import cdf as C
from cdfloom.functions import scores as S
from cdfloom.model import IDRModel, fit_idr, subsample_plan, subsampled
from cdfloom.operators.isotonic import isotonic_indexed, isotonic_mean
from cdfloom.operators.prep import CovariateOrder
from cdfloom.operators.survival import kaplan_meier
from cdfloom.plans.dominance import adjacency, topological_order
from cdfloom.streaming.scoring import late_sums_stream, score_batches, score_stream, sums_stream


def frame(spark, rows, schema="x double, y double"):
    return spark.createDataFrame(rows, schema)


def matrix(model, x="x"):
    cells = {(r["threshold"], r[x]): r["cdf"] for r in model.long().collect()}
    zs, xs = sorted({z for z, _ in cells}), sorted({a for _, a in cells})
    return [[pytest.approx(cells[z, a]) for a in xs] for z in zs]


@pytest.mark.parametrize("method", ["sql", "kernel"])
def test_idr(spark, method):
    df = frame(spark, [(1., 3.), (2., 2.), (3., 5.), (4., 4.), (5., 1.)])
    a = 1 / 3
    assert matrix(fit_idr(df, "y", "x", method=method)) == [[.2] * 5, [.5, .5, a, a, a], [1, 1, a, a, a], [1, 1, 2 * a, 2 * a, 2 * a], [1] * 5]


@pytest.mark.parametrize("method", ["sql", "kernel"])
def test_negative_zero_is_zero(spark, method):
    df = frame(spark, [(-1., -0.), (-0., 5.), (0., 4.), (1., 0.)])
    a = 1 / 3
    assert matrix(fit_idr(df, "y", "x", method=method)) == [[1, a, a], [1, 2 * a, 2 * a], [1, 1, 1]]


def test_blocks_of_thresholds_agree(spark, data, monkeypatch):
    import cdfloom.model as m

    part = spark.read.parquet(f"{data}/part.parquet").select("p_size", "p_retailprice")
    whole = matrix(fit_idr(part, "p_retailprice", "p_size", method="kernel"), "p_size")
    monkeypatch.setattr(m, "BLOCK_CELLS", 500)
    assert matrix(fit_idr(part, "p_retailprice", "p_size", method="kernel"), "p_size") == [[c.expected for c in row] for row in whole]


def test_sidr_and_hazard_and_direction(spark):
    rows = [(6., .4, False), (23., .1, True), (44., .6, True), (95., .5, True)]
    df = frame(spark, rows, "x double, y double, o boolean")
    assert matrix(fit_idr(df, "y", "x", observed="o")) == [[.5, .5, 0, 0], [.5] * 4, [1] * 4]
    mirrored = df.withColumn("x", -F.col("x"))
    assert matrix(fit_idr(mirrored, "y", "x", observed="o", increasing=False)) == [[0, 0, .5, .5], [.5] * 4, [1] * 4]
    h = frame(spark, [(1., 6.), (2., 2.), (3., 3.), (4., 4.), (5., 1.), (6., 5.)])
    assert matrix(fit_idr(h, "y", "x", y_order="HAZARD"))[4][0] == pytest.approx(846499 / 853060)


def test_all_observed_and_none_observed(spark):
    df = frame(spark, [(1., 3., True), (2., 2., True)], "x double, y double, o boolean")
    assert matrix(fit_idr(df, "y", "x", observed="o")) == matrix(fit_idr(df, "y", "x"))
    none = fit_idr(df.withColumn("o", F.lit(False)), "y", "x", observed="o")
    assert none.thresholds().first()["thresholds"] == [] and none.long().count() == 0


def test_partial_order_groups(spark):
    rows = [(1., 0., .1), (0., 1., .2), (2., 0., .3), (0., 2., .05)]
    df = frame(spark, rows, "a double, b double, y double")
    model = fit_idr(df, "y", ["a", "b"], order=[("SD", ["a", "b"])])
    out = model.predict_cdf(df.select("a", "b")).collect()
    by_size = {}
    for r in out:
        by_size.setdefault(max(r["a"], r["b"]), []).append(r["cdf"])
    assert by_size[1.0][0] == by_size[1.0][1] and by_size[2.0][0] == by_size[2.0][1]
    with pytest.raises(errors.CovariateOrderInconsistency):
        CovariateOrder.parse([("sd", ["a", "a"])], ["a"])
    with pytest.raises(errors.ConfigParseError):
        CovariateOrder.parse([("fsd", ["a"])], ["a"])


def test_prediction_outside_the_order(spark):
    model = IDRModel.from_cdfs(spark, [[0.2, 1.0], [0.1, 1.0]], [[0.0, 1.0], [1.0, 0.0]], [1.0, 2.0], ["a", "b"])
    inf = float("inf")
    asked = frame(spark, [(inf, inf), (-inf, -inf), (0.5, 0.5), (None, 1.0)], "a double, b double")
    got = {(r["a"], r["b"]): r["cdf"] for r in model.predict_cdf(asked).collect()}
    assert got[inf, inf] == [0.1, 1.0] and got[-inf, -inf] == [0.2, 1.0]
    assert got[0.5, 0.5] == pytest.approx([0.15, 1.0]) and got[None, 1.0] is None


@pytest.mark.parametrize("upper, expected", [(False, [10, 10, 20, 20, 30]), (True, [10, 20, 20, 30, 30])])
def test_quantile_edges(spark, upper, expected):
    model = IDRModel.from_cdfs(spark, [[0.2, 0.8, 1.0]], [0.0], [10.0, 20.0, 30.0], ["x"])
    out = model.quantile(frame(spark, [(0.,)], "x double"), [0.0, 0.2, 0.5, 0.8, 1.0], upper).orderBy("p").collect()
    assert [r["quantile"] for r in out] == expected


def test_lookup_clamps_and_blends(spark):
    model = IDRModel.from_cdfs(spark, [[0.5, 1.0], [0.1, 1.0]], [0.0, 2.0], [1.0, 2.0], ["x"])
    got = {r["x"]: r["cdf_at"] for r in model.cdf_at(frame(spark, [(-5., 1.), (0.5, 1.5), (2., 1.), (9., 0.)]), "y").collect()}
    assert got == {-5.0: 0.5, 0.5: pytest.approx(0.4), 2.0: 0.1, 9.0: 0.0}


def test_mean_of_a_sub_cdf_is_null(spark):
    model = IDRModel.from_cdfs(spark, [[0.5, 0.9]], [0.0], [1.0, 2.0], ["x"])
    assert model.predict(frame(spark, [(0.,)], "x double")).first()["prediction"] is None


def test_crps_is_the_integral(spark):
    row = spark.range(1).select(S.crps(F.array(F.lit(.2), F.lit(.8), F.lit(1.)), F.array(F.lit(10.), F.lit(20.), F.lit(30.)), F.lit(15.)).alias("c"),
                                S.ensemble_crps(F.array(F.lit(1.), F.lit(3.)), F.lit(2.)).alias("e")).first()
    assert row["c"] == pytest.approx(.2**2 * 5 + .8**2 * 5 + .2**2 * 10) and row["e"] == pytest.approx(.5)


@pytest.mark.parametrize("rows, error", [
    ([], errors.EmptyInput), ([(float("nan"), 1.)], errors.NonFiniteFloats), ([(1., float("inf"))], errors.NonFiniteFloats), ([(None, 1.)], errors.NonFiniteFloats),
])
def test_invalid_rows(spark, rows, error):
    with pytest.raises(error):
        fit_idr(frame(spark, rows), "y", "x")


def test_invalid_options(spark):
    df = frame(spark, [(1., 1.), (2., 2.)])
    with pytest.raises(errors.NegativeWeights):
        fit_idr(df.withColumn("w", F.lit(-1.0)), "y", "x", weight="w")
    with pytest.raises(errors.ConfigParseError):
        fit_idr(df, "y", "x", y_order="fosd")
    for wrong in ((10, None, 5, None), (10, 3, 11, False), (10, 0, None, None), (10, 3, 0, None), (10, 3, 1.5, None), (10, None, None, True)):
        with pytest.raises(errors.SubaggingParameterInconsistency):
            subsample_plan(*wrong)
    for wrong in ({"epsilon": 1e-3, "osqp_settings": {}}, {"epsilon": -1}, {"tolerance": 1}, {"osqp_settings": {"rho": 1}}, {"osqp_settings": {"max_iter": 2.5}}, {"osqp_settings": {"verbose": 1}}):
        with pytest.raises(errors.ConfigParseError):
            fit_idr(df, "y", "x", settings=wrong)
    fit_idr(df, "y", "x", settings={"osqp_settings": {"eps_abs": 1e-5, "max_iter": 100, "verbose": False}})
    with pytest.raises(errors.OrderMismatch):
        IDRModel.from_cdfs(spark, [[1.0], [1.0]], [1.0, 1.0], [1.0])
    with pytest.raises(errors.ShapeMismatch):
        IDRModel.from_cdfs(spark, [[1.0]], [1.0, 2.0], [1.0])
    with pytest.raises(errors.NotImplementedCombination):
        fit_idr(df.withColumns({"z": F.col("x"), "o": F.col("x") > 1}), "y", ["x", "z"], observed="o", y_order="hazard")


@pytest.mark.parametrize("asked, plan", [
    ((10, None, None, None), (1, 10, False)), ((10, None, 10, False), (1, 10, False)), ((10, None, 1.0, False), (1, 10, False)),
    ((10, 3, None, None), (1, 10, False)), ((10, 3, None, True), (3, 5, True)), ((10, 3, 10, True), (3, 5, True)), ((10, 3, 10, False), (1, 10, False)),
    ((10, 3, 4, False), (3, 4, False)), ((10, 3, 0.25, False), (3, 3, False)), ((10, 3, 0.01, True), (3, 1, True)), ((11, 3, None, True), (3, 6, True)),
])
def test_subsample_rules(asked, plan):
    assert subsample_plan(*asked) == plan


@pytest.mark.parametrize("replacement", [False, True])
def test_subsamples_are_exact_and_do_not_depend_on_partitions(spark, data, replacement):
    part = spark.read.parquet(f"{data}/part.parquet")
    rows = part.select(F.array(F.col("p_size").cast("double")).alias("at"), F.pmod("p_partkey", F.lit(3)).cast("double").alias("y"), F.lit(True).alias("observed"), F.lit(1.0).alias("w"))
    n = rows.count()
    got = [sorted(map(str, subsampled(r, n, 3, 70, replacement, 5).collect())) for r in (rows, rows.repartition(7, "y"))]
    assert got[0] == got[1]
    out = subsampled(rows, n, 3, 70, replacement, 5)
    assert {r["subsample_id"]: r["s"] for r in out.groupBy("subsample_id").agg(F.sum("w").alias("s")).collect()} == {0: 70, 1: 70, 2: 70}
    more = out.join(rows.groupBy("at", "y").count(), ["at", "y"]).where(F.col("w") > F.col("count")).count()
    assert replacement or not more
    whole = {(r["subsample_id"], str(r["at"]), r["y"]): r["w"] for r in subsampled(rows, n, 2, n - 1, False, 5).collect()}
    assert sum(whole.values()) == 2 * (n - 1)


def test_bag_seed(spark, data):
    df = spark.read.parquet(f"{data}/part.parquet").select("p_size", F.floor("p_retailprice").cast("double").alias("y"))
    fits = [fit_idr(df, "y", "p_size", subsamples=3, subsample_size=0.5, seed=5, replace=r).predict(df.select("p_size").distinct()).orderBy("p_size").collect() for r in (False, False, True)]
    assert fits[0] == fits[1] and len(fits[2]) == len(fits[0]) and fits[2] != fits[0]


def test_texts(spark):
    model = fit_idr(frame(spark, [(1., 3.), (2., 2.), (2., 9.)]), "y", "x")
    assert "covariates: x" in str(model) and "total, increasing" in str(model)
    row = model.summary().first()
    assert (row["n_covariates"], row["n_thresholds"], row["largest_last"]) == (2, 3, 1.0)


def test_one_job_before_the_fit(spark, data):
    """The input is read once to check it and size the fit; the fit is lazy."""
    df = spark.read.parquet(f"{data}/lineitem.parquet")
    spark.sparkContext.setJobGroup("fit", "fit")
    fit_idr(df, "l_quantity", "l_discount")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fit")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2  # a shuffle before the one row may be a job of its own


def test_indexed_means(spark):
    df = frame(spark, [("a", 1, 2., 5., 1.), ("a", 2, 3., 4., 1.), ("a", 3, 1., 9., 2.), ("b", 2, 1., 0., 1.), ("b", 1, 5., 1., 0.)], "g string, i int, y double, z double, w double")
    one = {(r["g"], r["i"]): r["fitted"] for r in isotonic_indexed(df, "y", "i", by=["g"]).collect()}
    assert one == {("a", 1): 2, ("a", 2): 2, ("a", 3): 2, ("b", 1): 3, ("b", 2): 3}
    two = {(r["g"], r["i"]): (r["fitted_y"], r["fitted_z"]) for r in isotonic_indexed(df, ["y", "z"], "i", "w", by=["g"]).collect()}
    assert two["a", 3] == (1.75, 9) and two["b", 1] == (1, 0) and two["a", 2][1] == 4.5


def test_orders_of_a_relation(spark):
    edges = frame(spark, [(1, 2), (2, 3), (1, 4), (4, 3)], "lo int, hi int")
    nodes = frame(spark, [(k,) for k in range(1, 6)], "n int")
    rank = {r["n"]: r["rank"] for r in topological_order(edges, nodes, "n").collect()}
    assert rank == {1: 0, 2: 1, 4: 1, 3: 3, 5: 0}
    near = {r["node"]: (r["below"], r["above"]) for r in adjacency(edges).collect()}
    assert near == {1: ([], [2, 4]), 2: ([1], [3]), 3: ([2, 4], []), 4: ([1], [3])}
    with pytest.raises(errors.OrderMismatch):
        topological_order(edges.unionAll(frame(spark, [(3, 1)], "lo int, hi int")), nodes, "n")


def test_estimator_in_a_pipeline(spark, data, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from cdfloom.ml import IsotonicDistributionalRegressor

    df = spark.read.parquet(f"{data}/lineitem.parquet").select("l_discount", "l_quantity")
    asked = df.select("l_discount").distinct()
    estimator = IsotonicDistributionalRegressor("l_quantity", "l_discount", increasing=False)
    assert estimator.getFeatureCols() == ["l_discount"] and estimator.copy({estimator.increasing: True}).getOrDefault("increasing") is True
    model = Pipeline(stages=[estimator]).fit(df)
    model.save(str(tmp_path / "model"))
    Pipeline(stages=[estimator]).save(str(tmp_path / "estimator"))
    want = model.transform(asked).select("l_discount", "prediction").orderBy("l_discount").collect()
    assert PipelineModel.load(str(tmp_path / "model")).transform(asked).select("l_discount", "prediction").orderBy("l_discount").collect() == want
    assert Pipeline.load(str(tmp_path / "estimator")).fit(df).transform(asked).select("l_discount", "prediction").orderBy("l_discount").collect() == want
    with pytest.raises(errors.ConfigParseError):
        IsotonicDistributionalRegressor("y", "x", depth=3)


def test_save_and_load(spark, tmp_path):
    model = fit_idr(frame(spark, [(1., 3.), (2., 2.)]), "y", "x")
    model.save(str(tmp_path / "m"))
    again = IDRModel.load(spark, str(tmp_path / "m"))
    assert matrix(again) == matrix(model) and again.meta == model.meta and again.consistent().first()["bad"] == 0


def test_kaplan_meier_keeps_type(spark):
    df = frame(spark, [(1, True), (3, False), (5, True), (5, True), (7, True), (9, False), (11, True)], "t int, e boolean")
    out = kaplan_meier(df, "t", "e").orderBy("time")
    assert dict(out.dtypes)["time"] == "int" and [round(r["survival"], 6) for r in out.collect()] == [0.857143, 0.514286, 0.342857, 0.0]


def test_isotonic_by_pair(spark):
    df = frame(spark, [(0., 0., 4.), (0., 1., 6.), (1., 0., 2.), (1., 1., 3.)], "a double, b double, y double")
    got = {(r["a"], r["b"]): r["fitted"] for r in isotonic_mean(df, "y", ["a", "b"]).collect()}
    assert got == {(0, 0): 3, (0, 1): 4.5, (1, 0): 3, (1, 1): 4.5}


def test_streams(spark, data, tmp_path):
    folder = tmp_path / "in"
    spark.range(20).selectExpr("cast(id % 4 as double) as x", "cast(id as double) as y", "timestamp_seconds(id * 60) as ts").coalesce(1).write.parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    stream = lambda: spark.readStream.schema(schema).parquet(str(folder))
    model = fit_idr(spark.read.parquet(str(folder)), "y", "x")

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        try:
            q.processAllAvailable()
            return spark.table(name).collect()
        finally:
            q.stop()

    scored = {r["y"]: r["cdf_at"] for r in run(score_stream(stream(), model, "x", "y"), "append", "scored")}
    static = {r["y"]: r["cdf_at"] for r in model.cdf_at(spark.read.parquet(str(folder)), "y").collect()}
    assert scored == pytest.approx(static)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("cdfloom.streaming.scoring.STREAM_CELLS", 5)
        with pytest.raises(errors.TooLarge):
            score_stream(stream(), model, "x", "y")
    batches = []
    q = stream().writeStream.foreachBatch(score_batches(model, "y", lambda df, _: batches.extend(df.collect()))).start()
    q.processAllAvailable()
    q.stop()
    assert {r["y"]: r["cdf_at"] for r in batches} == pytest.approx(static)
    assert sum(r["w"] for r in run(sums_stream(stream(), "x", "y"), "complete", "sums")) == 20
    assert sum(r["w"] for r in run(late_sums_stream(stream(), "ts", "x", "y"), "complete", "late")) == 20


def test_cdf_of_null_is_null(spark):
    row = spark.range(1).select(C.cdf_at(F.array(F.lit(1.0)), F.array(F.lit(0.0)), F.lit(None).cast("double")).alias("c")).first()
    assert row["c"] is None


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_must_name_its_shared_folder(master):
    from types import SimpleNamespace

    from cdfloom.plans.lineage import shared_folder

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(errors.ConfigParseError, match="spark.checkpoint.dir"):
        shared_folder(session)
