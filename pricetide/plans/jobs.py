"""The jobs: extract, build features, train, evaluate, tune, forecast.

Every job reads tables and writes tables; a stage border is a written table, so nothing before it is
computed twice and a lost executor costs a part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.features import day_key
from pricetide.functions.features import moment as moment_of
from pricetide.operators import encode as en
from pricetide.operators import forecast as fc
from pricetide.operators import leafwise as lw
from pricetide.operators import live as lv
from pricetide.operators import means as mn
from pricetide.operators import metrics as mt
from pricetide.operators import model as md
from pricetide.operators import prices as pr
from pricetide.operators import split as sp
from pricetide.operators import trees as tr
from pricetide.operators.frames import drop_incomplete
from pricetide.plans.workspace import Workspace
from pricetide.schemas import LIVE_SCHEMA, PRICE_SECTION, STATION_SECTION
from pricetide.session import own_scratch
from pricetide.sources import dump, rows, tables, writers

ENCODED = ["brand", "uuid"]
ROW_ORDER = ["day_key", "uuid", "date", "id"]

# Defaults of the search.
SEARCH_DRAWS, SEARCH_FOLDS, SEARCH_SEED, SEARCH_ROUNDS = 50, 4, 42, 100


def _job(work: Callable) -> Callable:
    """A job: what it returns reads tables of the workspace only, so its scratch tables go at its end."""

    @wraps(work)
    def run(ws: Workspace, *args, **options):
        with own_scratch(ws.spark):
            return work(ws, *args, **options)

    return run


def _write_prices(ws: Workspace, parsed: DataFrame) -> None:
    """Price rows stored by usability and day: one pass gives the records and the rejects."""
    usable = F.col("reject").isNull()
    stored = mn.with_day_key(parsed).withColumns(
        {"usable": usable.cast("int"), "line": F.when(~usable, F.col("line"))}
    )
    writers.write_table(stored, ws.path("price_rows"), ["usable", "day_key"])


def _write_stations(ws: Workspace, parsed: DataFrame) -> None:
    writers.write_table(rows.accepted(parsed).transform(pr.latest_stations), ws.path("stations"))
    writers.write_table(rows.rejected(parsed), ws.path("station_rejects"))


@_job
def extract(ws: Workspace, dump_path: str, as_of: datetime | Column | None = None) -> None:
    """Text dump to price rows of the last 60 days and stations, with the rejects of both."""
    lines = dump.land_dump(ws.spark, dump_path, ws.path("dump_lines"))
    sections = dump.copy_sections(lines, [PRICE_SECTION, STATION_SECTION])
    parsed = dump.parse_price_lines(sections[PRICE_SECTION])
    _write_prices(ws, parsed.where(F.col("reject").isNotNull() | pr.is_recent(parsed, as_of=as_of)))
    _write_stations(ws, dump.parse_station_lines(sections[STATION_SECTION]))


@_job
def load_files(ws: Workspace, prices_tsv: str, stations_tsv: str) -> None:
    """Price and station files (TSV) to the same tables as `extract`."""
    parsed = tables.read_prices(ws.spark, prices_tsv).transform(pr.parse_dates)
    undated = F.when(F.col("date").isNull(), "date not readable")
    _write_prices(ws, parsed.withColumn("reject", F.coalesce("reject", undated)))
    _write_stations(ws, tables.read_stations(ws.spark, stations_tsv))


@_job
def load_oil(ws: Workspace, oil_csv: str, skip_first: bool = True) -> None:
    """Landed oil series to a table with one row per day."""
    series = mn.one_close_per_day(tables.read_oil(ws.spark, oil_csv, skip_first))
    writers.write_table(series, ws.path("oil"))


@_job
def build_features(ws: Workspace) -> None:
    """Enriched price table (stored by day, with record id) and the final table."""
    features = pr.price_features(ws.prices.drop("day_key"), ws.read("stations"))
    writers.write_table(features.transform(mn.with_day_key), ws.path("features"), ["day_key"])
    final = pr.final_table(ws.read("features").drop("day_key"))
    writers.write_table(final, ws.path("final"), ["month", "day"], order=pr.FINAL_ORDER)


@_job
def build_means(ws: Workspace, frame: str = "observed") -> None:
    """Daily and rolling means per station, and the feature table with them attached."""
    features = ws.read("features")
    writers.write_table(mn.rolling_means(mn.daily_means(features), frame=frame), ws.path("means"))
    writers.write_table(mn.attach_means(features, ws.read("means")), ws.path("features_with_means"), ["day_key"])


@_job
def build_slice(ws: Workspace, day_mode: str = "date", codes_from: str = "train") -> None:
    """Encoded training slice with `day_idx` and `split`, and the dictionaries.

    Dictionaries know the training days only; `codes_from="all"` makes them from train and test rows.
    `day_mode="mmdd"` orders days without the year.
    """
    train_rows = sp.train_rows(ws.read("features"))
    if day_mode != "date":
        train_rows = train_rows.withColumn("day_key", day_key(F.col("date"), day_mode))
    writers.write_table(train_rows.transform(sp.with_day_split), ws.path("slice_raw"), ["split"])
    encoded = ws.read("slice_raw")
    known = encoded if codes_from == "all" else encoded.where("split = 'train'")
    for column in ENCODED:
        writers.write_table(en.category_codes(known, column), ws.path(f"codes_{column}"))
        encoded = en.encode(encoded, ws.read(f"codes_{column}"), column)
    writers.write_table(encoded, ws.path("slice"), ["split"])


def _part(ws: Workspace, split: str) -> DataFrame:
    return ws.read("slice").where(F.col("split") == split)


@_job
def train(ws: Workspace, params: md.BoostParams = md.BoostParams(), features: list[str] = md.FEATURES) -> None:
    """Fit the change model on the training days; save it with its losses per round and importances.

    `features=LEAKY_FEATURES` gives the published feature set, whose quality is the leak's.
    """
    model = md.train_classifier(_part(ws, "train"), features, params)
    writers.save_model(model, ws.path("model"))
    splits = {split: _part(ws, split) for split in ("train", "test")}
    writers.write_table(md.round_losses(model, splits), ws.path("round_losses"))
    writers.write_table(md.feature_importance(model), ws.path("importance"))


@_job
def train_leafwise(ws: Workspace, params: lw.LeafwiseParams = lw.LeafwiseParams(), features: list[str] = md.FEATURES) -> None:
    """Fit the published learner on the training days; save it as a text file, with its nodes and importances."""
    model = lw.train_leafwise(_part(ws, "train"), features, md.LABEL, params)
    writers.write_model_text(ws.spark, model, ws.path("model.txt"))
    writers.write_table(tr.node_table(ws.spark, model), ws.path("model_nodes"))
    writers.write_table(tr.split_importance(ws.spark, model), ws.path("split_importance"))


@_job
def evaluate(ws: Workspace, threshold: float = mt.THRESHOLD, model_text: str | None = None) -> DataFrame:
    """Score the test days with the saved model, append the report to the runs and return it.

    `model_text` is a model in the public text format that is taken instead, such as that of `train_leafwise`. `leaky`
    tells that the model was trained with the next price.
    """
    if model_text is None:
        model = tables.load_model(ws.path("model"))
        known, scored = model.stages[0].getInputCols(), md.score(model, _part(ws, "test"))
    else:
        trees = tables.read_model_text(ws.spark, model_text)
        known, scored = trees.features, tr.score_trees(trees, _part(ws, "test"))
    scored = scored.select("id", "y_prob", F.col(md.LABEL).alias("y_true"))
    writers.write_table(scored, ws.path("scores"))
    classed = mt.with_class(ws.read("scores"), threshold)
    report = mt.classification_report(classed)
    area = mt.roc_auc(classed).first()["roc_auc"]
    loss = mt.log_loss(classed).first()["log_loss"]
    leaky = "diesel_shift" in known
    lines, cells = report.collect(), mt.confusion_matrix(classed).collect()  # five rows and four
    record = ws.spark.createDataFrame(
        [(threshold, area, loss, leaky, cells, lines)],
        "threshold double, roc_auc double, log_loss double, leaky boolean, "
        "confusion array<struct<y_true:int,y_pred:int,n:long>>, "
        "report array<struct<label:string,precision:double,recall:double,f1_score:double,support:long>>",
    )
    writers.append_run(record, ws.path("runs_eval"))
    return report


@_job
def tune(
    ws: Workspace,
    train_days: int = sp.TRAIN_DAYS,
    n_iter: int = SEARCH_DRAWS,
    cv_folds: int = SEARCH_FOLDS,
    parallelism: int = 4,
    random_state: int = SEARCH_SEED,
    rounds: int = SEARCH_ROUNDS,
    features: list[str] = md.FEATURES,
    folds_by: str = "hash",
    space: dict[str, list] | None = None,
    learner: str = "spark",
) -> md.SearchResult | lw.Search:
    """Random search on the training days; the run, its loss per point and the best point are appended.

    `folds_by="rows"` gives contiguous stratified folds, `"hash"` spreads records without a shuffle. The learner
    `"leafwise"` searches the published grid, all points from the same scans, and saves the refit as a text file.
    """
    resplit = sp.resplit(ws.read("slice"), train_days)
    train_rows = mt.with_class_weight(resplit.where("split = 'train'"), md.LABEL)
    if folds_by == "hash":
        folded = sp.hash_folds(train_rows, cv_folds)
    elif folds_by == "rows":
        folded = sp.stratified_folds(train_rows, cv_folds, ROW_ORDER, md.LABEL)
    else:
        raise ValueError(f"unknown folds: {folds_by}")
    writers.write_table(folded, ws.path("search_rows"))
    settings = {"n_iter": n_iter, "folds": cv_folds, "seed": random_state, "rounds": rounds}
    if learner == "leafwise":
        result = lw.search_leafwise(ws.read("search_rows"), features, md.LABEL, space=space or lw.SEARCH_SPACE, **settings)
        writers.write_model_text(ws.spark, result.model, ws.path("model_tuned.txt"))
    elif learner == "spark":
        settings |= {"parallelism": parallelism, "space": space or md.SEARCH_SPACE}
        result = md.random_search(ws.read("search_rows"), features, **settings)
    else:
        raise ValueError(f"unknown learner: {learner}")
    run = (train_days, len(result.points), cv_folds, random_state, "diesel_shift" in features)
    records = [
        (*run, i == result.best, loss, {name: str(value) for name, value in point.items()})
        for i, (point, loss) in enumerate(zip(result.points, result.losses))
    ]
    columns = (
        "train_days int, n_iter int, cv_folds int, random_state long, leaky boolean, best boolean, "
        "log_loss double, params map<string,string>"
    )
    writers.append_run(ws.spark.createDataFrame(records, columns), ws.path("runs_tune"))
    return result


def _forecast_rows(ws: Workspace) -> DataFrame:
    """All priced records with features from days before their own, and their split by time."""
    features = ws.read("features")
    records = features.select("id", "uuid", "date", "e5", "day_key").transform(pr.with_time_features)
    return fc.with_time_split(fc.forecast_rows(records, mn.daily_means(features, ["e5"]), ws.read("oil")))


@_job
def train_forecast(ws: Workspace, params: md.BoostParams = md.BoostParams()) -> None:
    """Fit and save the e5 forecast with its station dictionary; both know the training days only."""
    writers.write_table(_forecast_rows(ws), ws.path("forecast_records"), ["split"])
    records = ws.read("forecast_records")
    writers.write_table(en.category_codes(records.where("split = 'train'"), "uuid"), ws.path("codes_forecast"))
    encoded = en.encode(records, ws.read("codes_forecast"), "uuid", "station_id_encoded")
    kept = encoded.select("id", "uuid", "day_key", "split", "e5", *md.FORECAST_FEATURES)
    writers.write_table(kept, ws.path("forecast_rows"), ["split"])
    train_rows = ws.read("forecast_rows").where("split = 'train'")
    writers.save_model(md.train_regressor(train_rows, params=params), ws.path("forecast_model"))


@_job
def forecast(ws: Workspace) -> DataFrame:
    """Predict e5 for the test days; writes predictions and returns the metrics.

    The run records the border of the split, the share of predictions within a cent, and the p-value of r
    (NULL where r has none).
    """
    model = tables.load_model(ws.path("forecast_model"))
    rows_ = ws.read("forecast_rows")
    predicted = md.forecast(model, rows_.where("split = 'test'"))
    writers.write_table(mt.comparison(predicted, "id", "e5", "predicted_e5"), ws.path("predictions"))
    predictions = ws.read("predictions")
    first_test = rows_.where("split = 'test'").agg(F.min("day_key").alias("test_from"))
    metrics = (
        mt.regression_metrics(predictions)
        .crossJoin(F.broadcast(predictions.agg(fc.hit_share().alias("within_goal"))))
        .crossJoin(F.broadcast(mt.pearson_p_value(predictions).select("p_value")))
        .crossJoin(F.broadcast(first_test))
    )
    writers.append_run(metrics, ws.path("runs_forecast"))
    return metrics


def forecast_live(ws: Workspace, live_json: str, moment: datetime) -> DataFrame:
    """Predict e5 for every complete station of landed live lists, at `moment`.

    Lags and averages come from the station's history, the oil price from the last day before `moment`; without one
    it is the usual price.
    """
    documents = ws.spark.read.text(live_json, wholetext=True)
    live = drop_incomplete(tables.flatten_stations(documents, "value", LIVE_SCHEMA))
    history = lv.history_features(mn.daily_means(ws.read("features"), ["e5"]))
    oil = mn.oil_features(ws.read("oil")).where(F.col("date") < F.to_date(moment_of(moment)))
    last = oil.orderBy(F.desc("date")).first()  # one row, or none
    price, mean = (last["oil_price"], last["oil_7d_avg"]) if last else (lv.DEFAULT_OIL_PRICE, lv.DEFAULT_OIL_PRICE)
    featured = lv.live_features(live, history, moment, "e5", price, mean, last_known=True)
    known = featured.withColumn("uuid", F.col("id"))
    encoded = en.encode(known, ws.read("codes_forecast"), "uuid", "station_id_encoded")
    predicted = md.forecast(tables.load_model(ws.path("forecast_model")), encoded)
    return mt.comparison(predicted, "id", "e5", "predicted_e5")
