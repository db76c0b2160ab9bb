"""Registered queries: each runs one group of operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.catalog.standins import StandIns
from pricetide.functions.features import mmdd
from pricetide.functions.text import clean_category
from pricetide.operators import encode as en
from pricetide.operators import forecast as fc
from pricetide.operators import leafwise as lw
from pricetide.operators import live as lv
from pricetide.operators import means as mn
from pricetide.operators import metrics as mt
from pricetide.operators import model as md
from pricetide.operators import patterns as pt
from pricetide.operators import prices as pr
from pricetide.operators import split as sp
from pricetide.operators import trees as tr
from pricetide.operators.asof import attach_last
from pricetide.operators.frames import drop_incomplete, with_global_index, written
from pricetide.schemas import FUELS, PRICE_SECTION, STATION_FILE_COLUMNS, STATION_SECTION
from pricetide.session import scratch_path
from pricetide.sources import dump, rows, tables, writers
from pricetide.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Fixed values of the queries; the checking SQL uses the same.
AS_OF = datetime(2024, 1, 31)
LIVE_AT = datetime(2024, 1, 31, 17)
RECENT_DAYS = 10
LAST_DAYS = 25
VALID_TRAIN_DAYS = 24
FOLDS = 4
ROW_ORDER = ["day_key", "uuid", "date", "id"]
# Published are 500 rounds and 200 rows; the test tables are small.
BOOST = md.BoostParams(rounds=20, min_rows=20)
SEARCH = {"stepSize": [0.05, 0.1], "maxDepth": [3], "minInstancesPerNode": [20]}


def query(build: Callable[[StandIns], DataFrame]) -> Callable[[StandIns], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(StandIns(spark, sf_dir))
    return build


def rounded(value: Column | str) -> Column:
    """Doubles at 9 digits, where engines agree; adding 0.0 turns -0.0 into 0.0."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), 9) + F.lit(0.0)


def _rounded(*names: str) -> list[Column]:
    return [rounded(name).alias(name) for name in names]


def _moment(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _day(column: str = "day_key") -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def _prices(t: StandIns) -> DataFrame:
    return t.prices_raw.transform(pr.normalise_prices)


def _prices_of(t: StandIns, events: DataFrame) -> DataFrame:
    return t.prices_from(events).transform(pr.normalise_prices)


def _labelled(t: StandIns) -> DataFrame:
    return _prices(t).transform(pr.with_next_price).transform(pr.with_change_label).transform(mn.with_day_key)


def _train_rows(t: StandIns) -> DataFrame:
    return _labelled(t).transform(sp.train_rows)


def _daily(t: StandIns) -> DataFrame:
    return _prices(t).transform(mn.with_day_key).transform(mn.daily_means)


def _slice(t: StandIns) -> DataFrame:
    """The slice reads its rows more than once, so they are written after the window."""
    return written(_train_rows(t), "train-rows").transform(sp.with_day_split)


# Sources


@query
def q_load_prices(t: StandIns) -> DataFrame:
    path = scratch_path(t.spark, "prices-tsv")
    text = F.concat(F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.lit("+00"))
    writers.write_tsv(t.prices_raw.withColumn("date", text), path)
    loaded = rows.accepted(tables.read_prices(t.spark, path)).transform(pr.parse_dates)
    return loaded.withColumn("date", _moment("date"))


@query
def q_load_stations(t: StandIns) -> DataFrame:
    path = scratch_path(t.spark, "stations-tsv")
    known, empty = t.stations, F.lit(None).cast("string")
    marked = F.coalesce(F.nullif("post_code", F.lit("\\N")), empty).alias("post_code")  # written as NULL, which is \N
    columns = {**{c: empty.alias(c) for c in STATION_FILE_COLUMNS}, **{c: F.col(c) for c in known.columns}}
    writers.write_tsv(known.select(*[marked if c == "post_code" else columns[c] for c in STATION_FILE_COLUMNS]), path)
    loaded = rows.accepted(tables.read_stations(t.spark, path)).transform(pr.tidy_stations)
    return loaded.select("id", "name", "brand", "post_code", F.col("post_code_int").cast("double").alias("post_code_int"))


@query
def q_copy_section(t: StandIns) -> DataFrame:
    sections = dump.copy_sections(t.dump_lines, [PRICE_SECTION, STATION_SECTION])
    prices = sections[PRICE_SECTION].withColumn("section", F.lit("prices"))
    stations = sections[STATION_SECTION].withColumn("section", F.lit("stations"))
    return prices.unionByName(stations)


@query
def q_land_dump(t: StandIns) -> DataFrame:
    """The dump written as text files, landed, and cut into its sections."""
    path = scratch_path(t.spark, "dump-text")
    t.dump_lines.orderBy("line_no").select("line").write.text(path)
    landed = dump.land_dump(t.spark, path, scratch_path(t.spark, "dump-lines"))
    sections = dump.copy_sections(landed, [PRICE_SECTION, STATION_SECTION])
    prices = sections[PRICE_SECTION].select(F.lit("prices").alias("section"), "line")
    return prices.unionByName(sections[STATION_SECTION].select(F.lit("stations").alias("section"), "line"))


@query
def q_parse_copy(t: StandIns) -> DataFrame:
    return dump.parse_price_lines(t.copy_lines).withColumn("date", _moment("date")).drop("line")


@query
def q_json_flatten(t: StandIns) -> DataFrame:
    """A list document per event; its second station has no price and is dropped with the nulls."""
    station = T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("e5", T.DoubleType()),
            T.StructField("props", T.StructType([T.StructField("k", T.LongType())])),
        ]
    )
    document = F.format_string(
        '{"stations":[{"id":"a-%d","e5":%s,"props":%s},{"id":"b-%d","e5":null,"props":%s}]}',
        "event_id",
        F.col("value").cast("string"),
        "props",
        "event_id",
        "props",
    )
    documents = t.table("events").select(document.alias("text"))
    flat = drop_incomplete(tables.flatten_stations(documents, "text", station))
    return flat.select("id", rounded("e5").alias("e5"), F.col("`props.k`").alias("props_k"))


@query
def q_oil_skip_first(t: StandIns) -> DataFrame:
    return mn.skip_first_day(t.oil_daily).select(_day("date").alias("date"), "close")


# Records


@query
def q_recent_window(t: StandIns) -> DataFrame:
    kept = pr.recent(t.prices_raw, RECENT_DAYS, AS_OF)
    return kept.select("id", "uuid", _moment("date").alias("date"))


@query
def q_price_normalize(t: StandIns) -> DataFrame:
    return _prices(t).select("id", *_rounded(*FUELS))


@query
def q_price_enrich(t: StandIns) -> DataFrame:
    return pr.enrich(t.prices_raw, t.stations).withColumn("date", _moment("date"))


@query
def q_time_features(t: StandIns) -> DataFrame:
    timed = pr.with_time_features(t.prices_raw)
    cycles = ["hour_sin", "hour_cos", "weekday_sin"]
    return timed.select("id", "hour", "minute", "month", "day", "weekday", *_rounded(*cycles))


@query
def q_change_label(t: StandIns) -> DataFrame:
    return _labelled(t).select("id", "uuid", *_rounded("diesel", "diesel_shift"), "price_will_change")


@query
def q_change_label_busy(t: StandIns) -> DataFrame:
    """The same with every station on the path for busy ones."""
    followed = _prices(t).transform(pr.with_next_price, station_rows=0).transform(pr.with_change_label)
    return followed.select("id", "uuid", *_rounded("diesel", "diesel_shift"), "price_will_change")


def _final(t: StandIns) -> DataFrame:
    return pr.final_table(pr.price_features(t.prices_raw, t.stations).drop("name"))


@query
def q_final_files(t: StandIns) -> DataFrame:
    """Rows of the written final table per day, and how often a row's station is below that of the row before."""
    path = scratch_path(t.spark, "final")
    writers.write_table(_final(t), path, ["month", "day"], order=pr.FINAL_ORDER)
    stored = t.spark.read.parquet(path).select(
        "month", "day", "uuid", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")
    )
    before = F.lag("uuid").over(Window.partitionBy("file").orderBy("place"))
    falls = F.coalesce(F.col("uuid") < before, F.lit(False)).cast("long")
    return stored.withColumn("falls", falls).groupBy("month", "day").agg(
        F.count("*").alias("records"), F.sum("falls").alias("falls")
    )


@query
def q_final_table(t: StandIns) -> DataFrame:
    final = _final(t)
    doubles = [*FUELS, "diesel_shift", "hour_sin", "weekday_sin"]
    return final.withColumns({name: rounded(name) for name in doubles})


# Categories


@query
def q_clean_category(t: StandIns) -> DataFrame:
    return t.stations.select("id", clean_category(F.col("brand")).alias("brand"))


@query
def q_label_encode(t: StandIns) -> DataFrame:
    records, known = t.prices_raw.select("id", "uuid"), t.stations.select("id", "brand")
    brands = en.category_codes(pr.enrich(records.select("uuid").distinct(), known), "brand")
    stations = en.category_codes(records, "uuid")
    enriched = pr.enrich(records, known)
    encoded = enriched.transform(en.encode, brands, "brand").transform(en.encode, stations, "uuid")
    return encoded.select("id", "uuid", "brand")


# Means


@query
def q_daily_mean(t: StandIns) -> DataFrame:
    return _daily(t).select("uuid", _day().alias("day"), *_rounded(*[f"{fuel}_1d_mean" for fuel in FUELS]))


def _mean_names() -> list[str]:
    return [f"{fuel}_{days}d_mean" for fuel in FUELS for days in (1, 3, 7)]


@query
def q_rolling_means(t: StandIns) -> DataFrame:
    rolled = mn.rolling_means(_daily(t), narrow_short=True)
    return rolled.select("uuid", _day().alias("day"), *_rounded(*_mean_names()))


@query
def q_attach_means(t: StandIns) -> DataFrame:
    means = mn.rolling_means(_daily(t))
    joined = mn.attach_means(_prices(t).transform(mn.with_day_key), means)
    return joined.select("id", *_rounded(*_mean_names()))


@query
def q_join_oil(t: StandIns) -> DataFrame:
    joined = mn.attach_oil(t.prices_raw, t.oil_daily)
    return joined.select("id", _moment("date").alias("date"), rounded("close").alias("close"))


@query
def q_oil_asof(t: StandIns) -> DataFrame:
    """Last quote of an intraday series before each record: of the whole market, and of the record's station."""
    market = t.oil_ticks.select("date", "close")
    own = t.oil_ticks.select("uuid", "date", F.col("close").alias("own_close"))
    joined = attach_last(attach_last(t.prices_raw, market, ["close"]), own, ["own_close"], by=["uuid"])
    return joined.select("id", "uuid", _moment("date").alias("date"), *_rounded("close", "own_close"))


@query
def q_lag_features(t: StandIns) -> DataFrame:
    lagged = mn.attach_oil(mn.lag_features(_daily(t)), mn.oil_features(t.oil_daily), F.col("day_key"))
    doubles = ["e5_1d_mean", "e5_lag_1", "e5_lag_3", "e5_lag_7", "e5_7d_avg", "e5_volatility", "oil_price", "oil_7d_avg"]
    return lagged.select("uuid", _day().alias("day"), *_rounded(*doubles))


@query
def q_live_features(t: StandIns) -> DataFrame:
    """A live list with every station of the master; many of them have little or no history."""
    document = F.format_string('{"stations":[{"id":"%s","e5":1.%s}]}', "id", F.right("id", F.lit(2)))
    station = T.StructType([T.StructField("id", T.StringType()), T.StructField("e5", T.DoubleType())])
    known = t.stations.select(document.alias("text"))
    live = tables.flatten_stations(known, "text", station)
    featured = lv.live_features(live, lv.history_features(_daily(t)), LIVE_AT)
    doubles = ["e5", *[name for name in md.FORECAST_FEATURES if name != "station_id_encoded"]]
    return featured.select("id", "hour", *_rounded(*doubles))


# Splits


@query
def q_train_rows(t: StandIns) -> DataFrame:
    return _train_rows(t).select("id", "uuid", *_rounded("diesel", "diesel_shift"), "price_will_change")


@query
def q_day_index(t: StandIns) -> DataFrame:
    kept = written(_train_rows(t), "train-rows").transform(sp.with_day_split, keep=LAST_DAYS)
    return kept.select("id", mmdd(F.col("date")).alias("mmdd"), "day_idx")


@query
def q_train_test_split(t: StandIns) -> DataFrame:
    return _slice(t).select("id", "day_idx", "split", "price_will_change")


@query
def q_train_valid_split(t: StandIns) -> DataFrame:
    return sp.resplit(_slice(t), VALID_TRAIN_DAYS).select("id", "day_idx", "split", "price_will_change")


@query
def q_eval_join(t: StandIns) -> DataFrame:
    """Test features and test labels as two tables, tied by the row number in the training slice."""
    test = with_global_index(_slice(t), ROW_ORDER, "orig_idx", unique=True).where("split = 'test'")
    features = test.select("orig_idx", "id", "uuid", "diesel", "diesel_shift")
    labels = test.select("orig_idx", F.col("price_will_change").alias("y_true"))
    joined = features.join(labels, "orig_idx")
    return joined.select("orig_idx", "id", "uuid", *_rounded("diesel", "diesel_shift"), "y_true")


@query
def q_folds(t: StandIns) -> DataFrame:
    train = _slice(t).where("split = 'train'")
    return sp.stratified_folds(train, FOLDS, ROW_ORDER, "price_will_change").select("id", "price_will_change", "fold")


# Metrics


@query
def q_threshold(t: StandIns) -> DataFrame:
    return mt.with_class(t.scores).select("id", "y_true", rounded("y_prob").alias("y_prob"), "y_pred")


@query
def q_confusion_matrix(t: StandIns) -> DataFrame:
    return mt.confusion_matrix(mt.with_class(t.scores))


@query
def q_classification_report(t: StandIns) -> DataFrame:
    report = mt.classification_report(mt.with_class(t.scores))
    return report.select("label", *_rounded("precision", "recall", "f1_score"), "support")


@query
def q_roc_auc(t: StandIns) -> DataFrame:
    return mt.roc_auc(t.scores).select(rounded("roc_auc").alias("roc_auc"))


@query
def q_log_loss(t: StandIns) -> DataFrame:
    return mt.log_loss(t.scores).select(rounded("log_loss").alias("log_loss"))


@query
def q_class_weights(t: StandIns) -> DataFrame:
    weights = mt.class_weights(_train_rows(t), "price_will_change")
    return weights.select("price_will_change", "n", rounded("weight").alias("weight"))


@query
def q_regression_metrics(t: StandIns) -> DataFrame:
    """How well the station's 7-day mean tells the day's mean e5 price."""
    lagged = mn.lag_features(_daily(t))
    pairs = mt.comparison(lagged, "uuid", "e5_1d_mean", "e5_7d_avg")
    measured = mt.regression_metrics(pairs)
    return measured.select("n", *_rounded("pearson", "mse", "mae"), F.round("t", 4).alias("t"))


# Hourly prices, patterns, live labels


def _grid(t: StandIns) -> DataFrame:
    return pt.hourly_grid(_prices(t), "e5")


@query
def q_hourly_grid(t: StandIns) -> DataFrame:
    return _grid(t).select("uuid", _moment("hour_start").alias("hour_start"), rounded("e5").alias("e5"))


@query
def q_cheapest_hour(t: StandIns) -> DataFrame:
    return pt.cheapest_hour(_grid(t)).select("uuid", _day().alias("day"), "hour", rounded("e5").alias("e5"))


@query
def q_price_patterns(t: StandIns) -> DataFrame:
    records = pr.enrich(_labelled(t), t.stations).transform(pr.with_time_features)
    patterns = pt.price_patterns(records.withColumn("brand", clean_category(F.col("brand"))))
    return patterns.select("brand", "weekday", "hour", "records", *_rounded("mean_price", "change_rate"))


@query
def q_stream_changes(t: StandIns) -> DataFrame:
    root = scratch_path(t.spark, "live")
    live = changes.start(_prices_of(t, t.stream("events")), f"{root}/tables", f"{root}/progress")
    live.awaitTermination()
    labels = changes.read_labels(t.spark, f"{root}/tables")
    return labels.select("id", "uuid", *_rounded("diesel", "diesel_shift"), "price_will_change")


# Models


def _model_rows(t: StandIns) -> DataFrame:
    """Encoded slice; dictionaries know the training days only.

    The slice is read for each dictionary and each code, so it is written with the columns that models need.
    """
    needed = ["id", "split", "day_idx", *md.LEAKY_FEATURES, md.LABEL]
    rows_ = written(pr.enrich(_slice(t), t.stations).transform(pr.with_time_features).select(*needed), "slice")
    train = rows_.where("split = 'train'")
    for column in ("brand", "uuid"):
        rows_ = en.encode(rows_, en.category_codes(train, column), column)
    return written(rows_.select(*needed), "encoded")


_TRAINED: dict[tuple[str, str], tuple[DataFrame, PipelineModel, str]] = {}


def _trained(t: StandIns) -> tuple[DataFrame, PipelineModel, str]:
    """Encoded rows, the model trained on their training days, and where it is saved.

    Scores, losses and importances are all those of one model, so a session trains it once per data folder.
    """
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _TRAINED:
        rows_, path = _model_rows(t), scratch_path(t.spark, "model")
        model = md.train_classifier(rows_.where("split = 'train'"), params=BOOST)
        writers.save_model(model, path)
        _TRAINED[key] = (rows_, model, path)
    return _TRAINED[key]


def _test_scores(t: StandIns) -> DataFrame:
    rows_, model, _ = _trained(t)
    return md.score(model, rows_.where("split = 'test'")).select("id", md.LABEL, "y_prob")


@query
def q_gbt_scores(t: StandIns) -> DataFrame:
    return _test_scores(t)


@query
def q_scored_rows(t: StandIns) -> DataFrame:
    """The test days' records with label, and whether their class follows from their score."""
    classed = mt.with_class(_test_scores(t))
    right = (F.col("y_pred") == (F.col("y_prob") > mt.THRESHOLD).cast("int")) & F.col("y_prob").between(0, 1)
    return classed.select("id", md.LABEL, right.alias("class_follows"))


@query
def q_model_roundtrip(t: StandIns) -> DataFrame:
    """Scores of the saved and loaded model beside those of the model in memory."""
    rows_, _, path = _trained(t)
    again = md.score(tables.load_model(path), rows_.where("split = 'test'"), "y_again").select("id", "y_again")
    same = F.abs(F.col("y_prob") - F.col("y_again")) < 1e-12
    return _test_scores(t).join(again, "id").select("id", md.LABEL, same.alias("same"))


@query
def q_round_losses(t: StandIns) -> DataFrame:
    """Rounds of both splits: whether training loss is no higher than at first, and the last loss that of the scores."""
    rows_, model, _ = _trained(t)
    losses = md.round_losses(model, {name: rows_.where(F.col("split") == name) for name in ("train", "test")})
    scored = mt.log_loss(_test_scores(t).withColumnRenamed(md.LABEL, "y_true")).select(F.col("log_loss").alias("of_scores"))
    first = F.first("log_loss").over(Window.partitionBy("split").orderBy("round"))
    is_last = (F.col("split") == "test") & (F.col("round") == BOOST.rounds)
    return losses.crossJoin(F.broadcast(scored)).select(
        "split",
        "round",
        F.when(F.col("split") == "train", F.col("log_loss") <= first).alias("no_higher"),
        F.when(is_last, F.abs(F.col("log_loss") - F.col("of_scores")) < 1e-9).alias("as_scored"),
    )


@query
def q_feature_importance(t: StandIns) -> DataFrame:
    found = md.feature_importance(_trained(t)[1])
    total = F.sum("importance").over(Window.partitionBy(F.lit(0)))
    return found.select("feature", (F.col("importance") >= 0).alias("not_negative"), F.round(total, 9).alias("total"))


@query
def q_search_runs(t: StandIns) -> DataFrame:
    """Random search with balanced weights: points drawn, distinct ones, the best loss, and one refit."""
    train = mt.with_class_weight(_trained(t)[0].where("split = 'train'"), md.LABEL)
    folded = written(sp.hash_folds(train, 2), "search-rows")
    result = md.random_search(folded, n_iter=2, folds=2, seed=1, parallelism=2, rounds=3, space=SEARCH)
    points = [tuple(sorted(point.items())) for point in result.points]
    refit = result.model.bestModel
    row = (
        len(points),
        len(set(points)),
        result.losses[result.best] == min(result.losses),
        refit.getNumTrees == 3 and refit.getOrDefault("stepSize") == result.points[result.best]["stepSize"],
    )
    return t.spark.createDataFrame([row], "points int, distinct_points int, best_is_least boolean, refit boolean")


#: One tree without sampling, which SQL can follow, and a short training with the published shares.
FIRST_TREE = lw.LeafwiseParams(rounds=1, column_share=1.0, row_share=1.0)
LEAFWISE = lw.LeafwiseParams(rounds=2, min_rows=50)
# Fixed value: a small model in the public text format; node 0 of the first tree has a default for NaN, the second
# tree takes zero as missing.
MODEL_TEXT = """tree
version=v4
num_class=1
num_tree_per_iteration=1
label_index=0
max_feature_idx=2
objective=binary sigmoid:2
feature_names=diesel hour e5
feature_infos=[0:3] [0:23] [0:3]
tree_sizes=0 0

Tree=0
num_leaves=4
num_cat=0
split_feature=0 1 2
split_gain=3 2 1
threshold=1.45 11.5 1.6
decision_type=10 2 2
left_child=1 -1 -2
right_child=2 -3 -4
leaf_value=0.25 0.5 -0.125 -0.75
leaf_count=1 1 1 1
internal_count=4 2 2
is_linear=0
shrinkage=1

Tree=1
num_leaves=2
num_cat=0
split_feature=1
split_gain=1
threshold=17
decision_type=4
left_child=-1
right_child=-2
leaf_value=-0.03125 0.0625
leaf_count=1 1
internal_count=2
is_linear=0
shrinkage=1

end of trees
"""


@query
def q_leafwise_trees(t: StandIns) -> DataFrame:
    """Splits of the first tree, in the order in which they were made."""
    train = _model_rows(t).where("split = 'train'")
    model = lw.train_leafwise(train, md.FEATURES, md.LABEL, FIRST_TREE)
    nodes = tr.node_table(t.spark, model).where("node >= 0")
    return nodes.select(F.col("node").alias("step"), "feature", *_rounded("threshold", "gain"), F.col("count").alias("records"))


def _by_nodes(spark: SparkSession, model: tr.TreeModel, rows_: DataFrame) -> DataFrame:
    """Raw scores of the rows by joins with the table of nodes, a level at a time."""
    nodes = F.broadcast(tr.node_table(spark, model).drop("gain", "count"))
    at = rows_.join(nodes.where("node = 0 OR node = -1").groupBy("tree").agg(F.max("node").alias("node")))
    value = F.coalesce(*[F.when(F.col("feature") == f, F.col(f).cast("double")) for f in model.features])
    for _ in range(max(tree.depth() for tree in model.trees)):
        step = at.join(nodes.drop("value"), ["tree", "node"])
        child = F.when(value <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = step.select("tree", *rows_.columns, F.when(F.col("node") < 0, F.col("node")).otherwise(child).alias("node"))
    return at.join(nodes.select("tree", "node", "value"), ["tree", "node"]).groupBy("id").agg(F.sum("value").alias("by_nodes"))


@query
def q_leafwise_model(t: StandIns) -> DataFrame:
    """Facts that a bad model fails, on the test days: its area, its scores by other ways, its gains."""
    rows_ = _model_rows(t)
    model = lw.train_leafwise(rows_.where("split = 'train'"), md.FEATURES, md.LABEL, LEAFWISE)
    test = rows_.where("split = 'test'").select("id", *md.FEATURES, F.col(md.LABEL).alias("y_true"))
    path = f"{scratch_path(t.spark, 'booster')}/model.txt"
    writers.write_model_text(t.spark, model, path)
    scored = tr.raw_scores(tables.read_model_text(t.spark, path), tr.raw_scores(model, test), "again")
    scored = written(scored.join(_by_nodes(t.spark, model, test), "id"), "scored")
    area = lambda of: F.greatest(F.col(of), 1 - F.col(of))
    single = [mt.roc_auc(test.withColumn("y_prob", F.col(f).cast("double"))) for f in md.FEATURES]
    single = [frame.select(area("roc_auc").alias("single")) for frame in single]
    best = single[0]
    for frame in single[1:]:
        best = best.unionByName(frame)
    own = mt.roc_auc(scored.withColumnRenamed("raw", "y_prob")).select("roc_auc")
    gains = tr.node_table(t.spark, model).where("node >= 0").groupBy("feature").agg(F.sum("gain").alias("sum"), F.count("*").alias("n"))
    table = tr.split_importance(t.spark, model).join(gains, "feature", "left")
    fact = lambda frame, name, holds: frame.agg(F.coalesce(F.every(holds), F.lit(False)).alias("holds")).select(F.lit(name).alias("fact"), "holds")
    close = lambda a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) < 1e-9
    parts = [
        fact(own.crossJoin(F.broadcast(best.agg(F.max("single").alias("single")))), "better than each feature", F.col("roc_auc") > F.col("single")),
        fact(scored, "scores follow from the nodes", close(F.col("raw"), F.col("by_nodes"))),
        fact(scored, "text gives the same scores", F.col("raw") == F.col("again")),
        fact(table, "gains add up", close(F.col("gain"), F.col("sum")) & (F.col("splits") == F.coalesce("n", F.lit(0)))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def q_leafwise_search(t: StandIns) -> DataFrame:
    """Search over points of the published grid; the scans are in units of those of the costliest point alone."""
    train = mt.with_class_weight(_model_rows(t).where("split = 'train'"), md.LABEL)
    folded = written(sp.hash_folds(train, 2), "search-rows")
    found = lw.search_leafwise(folded, md.FEATURES, md.LABEL, n_iter=4, folds=2, rounds=1, seed=3)
    jobs = [(lw.replace(lw.LeafwiseParams(rounds=1, seed=3), **point), 0) for point in found.points]
    alone = max(lw.grow(folded, md.FEATURES, [job], md.LABEL, "weight", "fold", data=found.data).scans for job in jobs)
    facts = [
        ("points", len(found.points)),
        ("distinct points", len({tuple(point.items()) for point in found.points})),
        ("scans of one point", round(found.scans / alone)),
        ("best is least", int(found.losses[found.best] == min(found.losses))),
        ("trees of the refit", len(found.model.trees)),
    ]
    return t.spark.createDataFrame(facts, "fact string, n long")


@query
def q_model_text(t: StandIns) -> DataFrame:
    """All prices, some of them missing, scored with a model that is read from a text file."""
    path = scratch_path(t.spark, "model-text")
    t.spark.createDataFrame([(MODEL_TEXT,)], "value string").coalesce(1).write.text(path)
    model = tables.read_model_text(t.spark, path)
    prices = pr.normalise_prices(t.prices_raw).withColumn("hour", F.hour("date"))
    scored = tr.score_trees(model, tr.raw_scores(model, prices))
    return scored.select("id", *_rounded("raw", "y_prob"))


@query
def q_sinks(t: StandIns) -> DataFrame:
    """What is read back from a slice stored by split, an oil series as CSV, and two appended runs."""
    path = scratch_path(t.spark, "sinks")
    writers.write_table(_slice(t), f"{path}/slice", ["split"])
    writers.write_csv(t.oil_daily, f"{path}/oil")
    for _ in range(2):
        writers.append_run(mt.log_loss(t.scores), f"{path}/runs")
    slice_, runs = t.spark.read.parquet(f"{path}/slice"), t.spark.read.parquet(f"{path}/runs")
    oil = tables.read_oil(t.spark, f"{path}/oil", skip_first=False)
    rows_ = slice_.groupBy(F.concat(F.lit("slice "), "split").alias("sink")).agg(
        F.count("*").alias("records"), F.sum("id").cast("double").alias("value")
    )
    days = oil.select(F.concat(F.lit("oil "), _day("date")).alias("sink"), F.lit(1).cast("long").alias("records"), F.col("close").alias("value"))
    losses = runs.where("run_at IS NOT NULL").groupBy(F.lit("runs").alias("sink")).agg(
        F.count("*").alias("records"), F.avg("log_loss").alias("value")
    )
    return rows_.unionByName(days).unionByName(losses).select("sink", "records", rounded("value").alias("value"))


def _forecast_rows(t: StandIns) -> DataFrame:
    """Every priced record with what was known before its day, split by time; the dictionary knows the training days."""
    records = _prices(t).transform(mn.with_day_key).transform(pr.with_time_features)
    rows_ = fc.with_time_split(fc.forecast_rows(records, _daily(t), t.oil_daily))
    rows_ = written(rows_, "forecast-rows")
    codes = en.category_codes(rows_.where("split = 'train'"), "uuid")
    encoded = en.encode(rows_, codes, "uuid", "station_id_encoded")
    return encoded.select("id", "uuid", "day_key", "split", "e5", *md.FORECAST_FEATURES)


@query
def q_forecast_rows(t: StandIns) -> DataFrame:
    doubles = [name for name in md.FORECAST_FEATURES if name != "station_id_encoded"]
    return _forecast_rows(t).select("id", "split", rounded("e5").alias("e5"), "station_id_encoded", *_rounded(*doubles))


@query
def q_price_forecast(t: StandIns) -> DataFrame:
    """Predictions for the test days of a model that saw the training days."""
    records = written(_forecast_rows(t), "forecast-encoded")
    model = md.train_regressor(records.where("split = 'train'"), params=BOOST)
    return mt.comparison(md.forecast(model, records.where("split = 'test'")), "id", "e5", "predicted_e5")
