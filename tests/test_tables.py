"""Relational operators on small tables with nulls, ties and repeated rows; numeric cases worked by hand."""

import warnings

import pytest
from pyspark.sql import functions as F

from tactica.functions import arrays, evaltext, probs
from tactica.operators import metrics, relational, sampling, scoring
from tactica.plans import models
from tactica.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_deviation_filter(spark):
    df = spark.createDataFrame([(1, 90), (2, 91), (3, None)], "id int, RatingDeviation int")
    assert [r.id for r in relational.stable_ratings(df).collect()] == [1]
    assert relational.stable_ratings(df, enabled=False).count() == 3 and relational.stable_ratings(df.drop("RatingDeviation")).count() == 3


def test_source_labels():
    assert relational.parse_source("maia-2-1100") == (2, ["rapid", "blitz"], 1100)
    assert relational.parse_source("maia-2-blitz") == (2, ["blitz"], None)
    assert relational.parse_source("maia-2-rapid-1500") == (2, ["rapid"], 1500) and relational.parse_source("maia-1-1900") == (1, None, 1900)
    for bad in ("maia-3-1100", "maia-1", "other-1-1100", "maia-1-1000"):
        with pytest.raises(ValueError):
            relational.parse_source(bad)


def test_joins_keep_the_row_count(spark):
    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    side = spark.createDataFrame([(1, 5.0), (1, 4.0), (3, None), (9, 1.0)], "k int, v double")
    assert rows(relational.left_with_defaults(left, side, "k", {"v": 0.0})) == [(1, 4.0), (2, 0.0), (3, 0.0), (None, 0.0)]
    assert [r[0] for r in rows(relational.unfinished(left, side, "k", "v"))] == [2, 3, None]
    assert rows(relational.needs_evaluation(left.filter("k > 1"), side, "k", "v")) == [(2, None, True), (3, None, True)]
    assert relational.known_then_left(left, side, "k", {"v": 0.0}).count() == 4
    assert relational.merge_results(side, spark.createDataFrame([(7, 2.0)], "k int, v double"), "v").count() == 4


def test_blocks_and_columns(spark):
    assert relational.choose_blocks() == ["struct", "themes", "advanced", "maia2", "maia1"] and relational.choose_blocks(["x"]) == ["x"]
    df = spark.createDataFrame([(1, 2, 3)], "success_prob_rapid_1050 int, other int, success_prob_blitz_1050 int")
    assert relational.column_family(df, "success_prob_") == ["success_prob_blitz_1050", "success_prob_rapid_1050"]
    with pytest.raises(ValueError, match="FEN"):
        tables.require_columns(df, ["other", "FEN"])


def test_curve(spark):
    df = spark.createDataFrame([(0.1, 0.3, 0.2, 0.9), (0.5, 0.5, 0.5, 0.5), (None, None, None, None)], "a double, b double, c double, d double")
    out = df.select(*[c.alias(n) for n, c in arrays.curve_features([F.col(c) for c in "abcd"]).items()]).collect()
    r = out[0]
    assert [round(r[c], 6) for c in ("prob_mean", "prob_std", "prob_min", "prob_max", "prob_range", "prob_skew", "max_pairwise_drop")] == [0.375, 0.311247, 0.1, 0.9, 0.8, 0.979409, -0.1]
    assert r.inflection_idx == 0 and out[1].prob_skew is None and out[2].prob_mean == 0 and arrays.curve_features([]) == {}


def test_ranks_gaps_and_top(spark):
    df = spark.createDataFrame([([3, 7, 1, 4, 9], 7), ([3, 7, 1, 4, 9], 5), ([3, 7, 1, 4, 9], -1), (None, 3), ([3], None)], "t array<int>, i int")
    assert [r[0] for r in df.select(arrays.rank_in(F.col("t"), F.col("i"))).collect()] == [2, 6, 6, 6, 6]
    one = spark.createDataFrame([([0.2, 0.5, 0.5, 0.1],)], "p array<double>").select(arrays.top_k(F.col("p"), 3).alias("t"), arrays.softmax(F.col("p")).alias("s")).first()
    assert [x.i for x in one.t] == [1, 2, 0] and abs(sum(one.s) - 1) < 1e-12
    gap, ratio = arrays.gap_and_ratio(F.lit(0.6), F.lit(0.3))
    got = spark.range(1).select(gap, ratio).first()
    assert abs(got[0] - 0.3) < 1e-12 and abs(got[1] - 0.5) < 1e-6


def test_level_statistics(spark):
    df = spark.createDataFrame([("a", "maia1", 1100, 0, 0.5), ("a", "maia1", 1100, 1, 0.25)], "pid string, source string, elo int, move_idx int, prob double")
    r = probs.level_statistics(df).first()
    assert [round(x, 6) for x in (r.prob_mean, r.prob_min, r.prob_max, r.ce_mean, r.ce_max, r.joint, r.log_joint)] == pytest.approx([0.15, 0, 0.5, 0.415888, 1.386294, 0.125, -2.079441], abs=1e-5)


def plain_vector(cells, extended):
    """The block by numpy, from (move, level) -> (p, top5 p, top5 i, index)."""
    import numpy as np

    p, rank, top = np.zeros((5, 5)), np.full((5, 5), 6.0), np.zeros((5, 5))
    for (m, e), (own, tp, ti, idx) in cells.items():
        p[m, e], top[m, e] = own, tp[0]
        rank[m, e] = ti.index(idx) + 1 if idx in ti and idx >= 0 else 6
    ce = np.where(p > 0, -np.log(p + 1e-7), 0)
    out = [p.ravel(), p.mean(0), p.min(0), p.max(0), ce.mean(0), ce.max(0), np.where(p > 0, p, 1).prod(0), -ce.sum(0)]
    for a in (rank, top - p, p / (top + 1e-7)) if extended else ():
        out += [a.ravel(), a.mean(0), a.min(0), a.max(0)]
    return np.concatenate(out)


def test_best_places_are_those_of_a_stable_sort():
    import numpy as np

    from tactica.operators import scoring

    rng = np.random.default_rng(4)
    for p in (rng.random((50, 40)), rng.integers(0, 4, (50, 40)) / 4, np.zeros((3, 40)), rng.random((5, 5)), rng.random((4, 3)), np.zeros((0, 40)), np.where(rng.random((20, 40)) < 0.1, np.nan, rng.random((20, 40)))):
        assert (scoring.best_places(p, 5) == np.argsort(-p, axis=1, kind="stable")[:, :5]).all()


def test_incremental_scoring_scores_each_puzzle_once(spark):
    """What is done is a table to the final plan, and the positions that no scorer reads do not go to Python."""
    import __spark_entry__

    plan = __spark_entry__.queries()["incremental_scoring"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "bd:" not in plan


def test_wide_vector(spark):
    import random

    rng, data, cells = random.Random(5), [], {}
    for m in range(3):
        for e, elo in enumerate(probs.ELOS):
            tp = sorted((rng.random() for _ in range(5)), reverse=True)
            ti, idx = rng.sample(range(9), 5), rng.choice([-1, 0, 1, 2, 3])
            cells[m, e] = (rng.random(), tp, ti, idx)
            data.append(("a", "maia1", elo, m, cells[m, e][0], idx, tp, ti))
    df = spark.createDataFrame(data, "pid string, source string, elo int, move_idx int, prob double, policy_idx int, top5_probs array<double>, top5_idx array<int>")
    got = probs.wide_vector(df).first().features
    assert got == pytest.approx(plain_vector(cells, True).tolist(), abs=1e-9) and len(got) == 180 == len(probs.vector_names())
    assert len(probs.wide_vector(df.drop("top5_idx")).first().features) == 60
    assert len(probs.wide_vector(df, elos=(1500,)).first().features) == 36 == len(probs.vector_names((1500,)))
    both = probs.wide_vector(df.unionByName(df.withColumn("source", F.lit("maia2_rapid"))))
    assert len(probs.concat_sources(both, ["maia1", "maia2_rapid"]).first().features) == 360
    lone = probs.concat_sources(both.filter("source = 'maia1'"), ["maia2_rapid", "maia1"]).first().features
    assert len(lone) == 360 and lone[:180] == [0.0] * 180 and lone[180:] == got


@pytest.mark.parametrize("name", ["move_probability_columns", "probability_vector", "probability_cells", "specialist_vector"])
def test_equal_probabilities_share_a_rank_as_in_sql(spark, tmp_path, name):
    import random

    import duckdb

    import __spark_entry__

    rng = random.Random(3)
    data = [(i, [rng.choice([0.0, 0.25, 0.5, -0.25][: 1 + i % 4]) for _ in range(64)], i % 10) for i in range(60)]
    spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = __spark_entry__.queries()[name](spark, str(tmp_path))
    plain = lambda some: sorted(tuple(float(v) if v is not None else None for v in r) for r in some)
    got, wanted = plain(found.collect()), plain(con.execute(f"SELECT {', '.join(found.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())
    assert len(got) == len(wanted) > 0 and sum(a != pytest.approx(b, abs=2e-6) for a, b in zip(got, wanted, strict=True)) == 0


def test_a_puzzle_without_a_side_table_keeps_its_row(spark):
    base = spark.createDataFrame([("a",), ("b",), ("c",)], "pid string")
    one = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "pid string, v array<double>")
    two = spark.createDataFrame([("c", [5])], "pid string, w array<int>")
    got = {r.pid: (r.one, r.two, r.none) for r in models.assemble(base, {"one": one, "two": two, "none": one.limit(0)}, widths={"none": 3}).collect()}
    assert got == {"a": ([1.0, 2.0], [0.0], [0.0] * 3), "b": ([3.0, 4.0], [0.0], [0.0] * 3), "c": ([0.0, 0.0], [5.0], [0.0] * 3)}


def test_engine_text(spark):
    df = spark.createDataFrame([("info score cp 35\ninfo score mate -2",), ("score mate 3\nscore cp -7",), ("score mate 0",), ("nothing",), (None,)], "t string")
    assert [r[0] for r in df.select(evaltext.search_centipawn(F.col("t"))).collect()] == [-10000, -7, -10000, None, None]
    texts = [("| 3 | + 1.5 | - 0.2 | x | <-- this bucket is used\nFinal evaluation       +1.23 (white side)", "score cp 1"), ("Final evaluation: none (in check)", "score cp -40"), ("", None)]
    got = spark.createDataFrame(texts, "t string, s string").select(*evaltext.eval_columns(F.col("t"), F.col("s")).values()).collect()
    assert [tuple(r)[:3] for r in got] == [(1.5, -0.2, 1.23), (None, None, -40.0), (None, None, None)] and got[0][3] == 1.0


def test_histogram_labels_and_encoding(spark):
    df = spark.createDataFrame([(999,), (1000,), (1099,), (1100,), (None,)], "r int")
    assert rows(sampling.histogram(df, "r")) == [(1000, 2), (1100, 1), (900, 1)]
    t = spark.createDataFrame([("a", "fork pin"), ("b", ""), ("c", None), ("d", " pin  mate ")], "id string, tags string")
    coded, words = sampling.encode_labels(t, t, "id", "tags")
    assert words == ["fork", "mate", "pin"] and rows(coded) == [("a", [1, 0, 1]), ("b", [0, 0, 0]), ("c", [0, 0, 0]), ("d", [0, 1, 1])]


def test_splits_do_not_depend_on_order_or_partitions(spark):
    ids = spark.range(5000).withColumnRenamed("id", "k")
    one = rows(sampling.folds(sampling.split(ids, "k"), "k"))
    assert one == rows(sampling.folds(sampling.split(ids.repartition(7).orderBy(F.desc("k")), "k"), "k"))
    n = {s: sum(r[1] == s for r in one) for s in ("train", "val", "test")}
    assert abs(n["test"] - 500) < 100 and abs(n["val"] - 500) < 100 and {r[2] for r in one} == set(range(5))
    assert sampling.sample(ids, "k", 10).count() == 10 and rows(sampling.sample(ids, "k", 10)) == rows(sampling.sample(ids.repartition(3), "k", 10))
    w = spark.createDataFrame([(0,), (50,)], "d int").select(sampling.weight(F.col("d"))).collect()
    assert [r[0] for r in w] == [1.0, 0.02]


def test_fold_summary_and_average(spark):
    df = spark.createDataFrame([("m", i, v, v * v) for i, v in enumerate((3.0, 1.0, 2.0, 1.0), 1)], "model string, fold int, val_rmse double, val_mse double")
    r = metrics.fold_summary(df).first()
    assert (r.val_rmse_mean, round(r.val_rmse_std, 6), r.best_fold, r.worst_fold) == (1.75, 0.829156, 2, 1)
    f = spark.createDataFrame([(0, 4.0, 2.0), (1, 16.0, 4.0)], "fold int, mse double, rmse double")
    assert round(metrics.with_final_average(f).filter("fold = 'Final Average'").first().rmse, 6) == 3.162278


def test_move_normalisation(spark):
    data = [("e2e4", False, True, "e2e4"), ("e7e5", True, True, "e2e4"), ("e8g8", True, True, "e1h1"), ("e1c1", False, True, "e1a1"), ("e1g1", False, False, "e1g1"), ("a7a8n", False, False, "a7a8"), ("a2a1q", True, False, "a7a8q")]
    df = spark.createDataFrame(data, "u string, b boolean, k boolean, want string")
    assert all(r.want == r.got for r in df.withColumn("got", scoring.normalised_move(F.col("u"), F.col("b"), F.col("k"))).collect())
    words = scoring.policy_vocabulary()
    assert len(words) == len(set(words)) == 1858 and words[0] == "a1b1" and words[-1] == "h7h8b"


def test_scorer_sees_every_level_and_missing_moves(spark):
    from tactica.plans.registry import toy_scorer

    df = spark.createDataFrame([("a", 0, 5), ("b", 1, -1)], "PuzzleId string, move_idx int, policy_idx int")
    out = scoring.score(df, toy_scorer, ["PuzzleId", "move_idx", "policy_idx"]).collect()
    assert len(out) == 10 and all(r.prob == 0 for r in out if r.policy_idx < 0) and all(list(r.top5_probs) == sorted(r.top5_probs, reverse=True) for r in out)


def test_pca_is_centred(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 4)) + 5
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "i int, v array<double>")
    out, variance = scoring.centred_pca(df, "v", 2)
    got = np.array([r.pca for r in out.orderBy("i").collect()])
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8) and len(variance) == 2


def test_stores(spark, tmp_path):
    p = spark.createDataFrame([("a", "maia1", 1100, 0.5), ("a", "maia1", 1300, 0.6)], "pid string, source string, elo int, prob double")
    tables.write_move_probs(p, str(tmp_path / "probs"))
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        got = tables.read_move_probs(spark, str(tmp_path / "probs"), ["maia1", "maia2_rapid"], [1300])
        assert got.count() == 1 and any("maia2_rapid" in str(w.message) for w in told)
    asked = []

    def compute(name, some):
        asked.append((name, sorted(r.PuzzleId for r in some.collect())))
        return some.select("PuzzleId", F.array(F.length("Moves").cast("double")).alias("v")) if name != "none" else None

    lengths = lambda df: {r.PuzzleId: r.v[0] for r in df.collect()}
    store = tables.BlockStore(spark, str(tmp_path / "blocks"), always=["fresh"])
    games = spark.createDataFrame([(x, "f", "m" * k) for k, x in enumerate("abcd", 1)], "PuzzleId string, FEN string, Moves string")
    assert lengths(store.load(["v"], compute, games.filter("PuzzleId < 'c'"))["v"]) == {"a": 1, "b": 2}
    assert lengths(store.load(["v"], compute, games)["v"]) == {"a": 1, "b": 2, "c": 3, "d": 4}
    store.load(["v"], compute, games)
    changed = games.withColumn("Moves", F.when(F.col("PuzzleId") == "b", "mmmmmmm").otherwise(F.col("Moves")))
    assert lengths(store.load(["v"], compute, changed)["v"]) == {"a": 1, "b": 7, "c": 3, "d": 4}
    assert lengths(store.load(["v"], compute, games)["v"])["b"] == 2  # the old row is still there
    assert asked == [("v", ["a", "b"]), ("v", ["c", "d"]), ("v", ["b"])]  # a new or changed puzzle costs one row
    store.compact("v", changed)
    assert spark.read.parquet(str(tmp_path / "blocks/v")).filter("generation = 1").count() == 4
    assert lengths(store.load(["v"], compute, changed)["v"])["b"] == 7 and len(asked) == 3
    assert lengths(store.load(["v"], compute, games)["v"])["b"] == 2 and asked[-1] == ("v", ["b"])
    for _ in range(2):
        store.load(["fresh"], compute, games)
    assert asked[-2:] == [("fresh", ["a", "b", "c", "d"])] * 2
    assert lengths(tables.BlockStore(spark, str(tmp_path / "blocks"), version="2").load(["v"], compute, games)["v"])["b"] == 2 and asked[-1] == ("v", ["a", "b", "c", "d"])
    with pytest.raises(ValueError, match="none"):
        store.load(["none"], compute, games)
    df = spark.createDataFrame([("p2", "f", "m", 1500, 80, None), ("p1", "f", "m", None, None, "fork")], tables.PUZZLES)
    tables.write_table(df, str(tmp_path / "puzzles.csv"))
    back = tables.read_puzzles(spark, str(tmp_path / "puzzles.csv"))
    assert back.schema["Rating"].dataType.typeName() == "integer" and rows(back) == rows(df)
    assert tables.read_puzzles(spark, str(tmp_path / "puzzles.csv"), columns=["PuzzleId"], rows=1).first()[0] == "p1"


def test_model_plans(spark):
    assert models.block_sets(["a", "b", "c"]) == [["a", "b", "c"], ["b", "c"], ["a", "c"], ["a", "b"]]
    assert len(models.block_sets(["a", "b", "c"], subsets=True)) == 7
    data = [(i, float(i % 10), "val" if i % 5 == 0 else "train", [float(i % 10)], [float(i * 7 % 13)]) for i in range(300)]
    m = spark.createDataFrame(data, "pid int, y double, split string, good array<double>, noise array<double>")
    learner = lambda: models.boosted(maxIter=5, maxDepth=3)
    board = models.ablate(m, ["good", "noise"], learner=learner).collect()
    assert board[-1].blocks == "noise" and board[0].rmse < 1.5 < board[-1].rmse
    parts = models.specialists(m, [], {"one": ["good"], "two": ["noise"]}, learner)
    s = models.stack_columns(parts, ["one", "two"]).first().stack
    assert len(s) == 6 and abs(s[2] - (s[0] + s[1]) / 2) < 1e-9
    e = {r.model: r.rmse for r in metrics.errors(parts.unionByName(models.stack(parts, m, ["noise"], ["one", "two"], learner=learner)), ["model"]).collect()}
    assert e["stacked"] < e["two"]


def test_matrix_is_keyed_and_incremental(spark, tmp_path):
    from tactica.plans import build
    from tactica.plans.registry import CATALOGUE, toy_scorer

    rows = [(n, f, m, 1500 + i, 80 + i * 5, "fork pin" if i % 2 else None, 0.1 * i, None) for i, (n, f, m) in enumerate(CATALOGUE[:5])]
    p = spark.createDataFrame(rows, "PuzzleId string, FEN string, Moves string, Rating int, RatingDeviation int, Themes string, success_prob_rapid_1050 double, success_prob_blitz_1050 double")
    probs_ = build.score_unfinished(p, toy_scorer, "maia1")
    evals = spark.createDataFrame([("F01", 1.0, 2.0, 3.0, 4.0)], tables.EVALS)
    store = tables.BlockStore(spark, str(tmp_path / "b"))
    m = build.build_matrix(p, ["struct", "advanced", "curve", "themes", "stockfish", "maia1"], evals, p.select("PuzzleId", "Themes"), probs_, store)
    got = {r.pid: r for r in m.collect()}
    assert set(got) == {"F01", "F02", "F03"}  # a deviation of 90 stays, 95 goes
    sizes = [len(got["F01"][b]) for b in ("struct", "advanced", "curve", "themes", "stockfish", "maia1")]
    assert sizes == [14, 540, 8, 2, 4, 180] and got["F01"].stockfish == [1.0, 2.0, 3.0, 4.0] and got["F02"].stockfish == [0.0] * 4
    with pytest.raises(ValueError, match="stockfish"):
        build.build_matrix(p, ["stockfish"])
    again = build.score_unfinished(p, toy_scorer, "maia1", probs_.filter("pid < 'F03'"))
    assert rows_of(again) == rows_of(probs_)


def rows_of(df):
    return sorted((r.pid, r.elo, r.move_idx, round(r.prob, 9)) for r in df.collect())


def test_cross_validation_gives_every_fold_its_turn(spark, monkeypatch):
    from tactica.plans import registry

    seen = []
    plain = models.cross_validate
    monkeypatch.setattr(registry.models, "cross_validate", lambda *a, **b: seen.append((a[0], plain(*a, **b))) or seen[0][1])
    summary = registry.QUERIES["cross_validation"](spark, "/root/testdata/sf0.001").collect()
    matrix, folds = seen[0]
    assert sorted(r.fold for r in folds.collect()) == sorted(r.fold for r in matrix.select("fold").distinct().collect()) == [0, 1, 2, 3, 4]
    assert len(summary) == 1
    with pytest.raises(ValueError, match="never be validated"):
        plain(matrix, registry.BLOCKS, {"boosted": registry.small}, k=3)


def test_models_as_tables_of_nodes(spark):
    """Walking the saved trees gives the model's predictions; raw gains of one tree, normalised, its importances."""
    data = [(i, float((i * 7) % 23 + (i % 3) * 4), "val" if i % 6 == 0 else "train", [float(i % 11), float(i * 5 % 17)], [float(i % 3)]) for i in range(400)]
    m = spark.createDataFrame(data, "pid int, y double, split string, a array<double>, b array<double>")
    for learner, share in ((models.boosted(maxIter=4, maxDepth=3), False), (models.forest(numTrees=5, maxDepth=4), True), (models.forest(numTrees=1, maxDepth=4), True)):
        model = models.train(m, ["a", "b"], learner)
        nodes = {}
        for r in models.node_table(model).collect():
            nodes.setdefault((r.tree, r.weight), {})[r.node] = r
        for r in models.predict(model, m, ["a", "b"]).join(m.select("pid", "a", "b"), "pid").collect():
            x, out = [*r.a, *r.b], []
            for (_, weight), tree in nodes.items():
                n = tree[0]
                while n.feature >= 0:
                    n = tree[n.left if x[n.feature] <= n.threshold else n.right]
                out.append(weight * n.prediction)
            assert r.yhat == pytest.approx(sum(out) / (len(out) if share else 1))
        raw = {r.feature_id: r.total_gain for r in models.raw_gains(model).collect()}
        assert len(raw) > 1 and min(raw.values()) > 0
        if len(nodes) == 1:
            want = {r.feature_id: r.gain for r in models.importances(model).collect()}
            assert {k: v / sum(raw.values()) for k, v in raw.items()} == pytest.approx(want)
