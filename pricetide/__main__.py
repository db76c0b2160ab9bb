"""Jobs for `spark-submit`: extract, features, train, eval, tune, forecast."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pricetide.operators import leafwise as lw
from pricetide.operators import model as md
from pricetide.operators import metrics as mt
from pricetide.operators import split as sp
from pricetide.plans import jobs
from pricetide.plans.workspace import Workspace
from pricetide.session import build_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pricetide", description=__doc__)
    top.add_argument("--root", required=True, help="folder of the job tables, shared by all executors")
    commands = top.add_subparsers(dest="command", required=True)

    extract = commands.add_parser("extract", help="text dump to price and station tables")
    extract.add_argument("dump")
    extract.add_argument("--oil", help="landed oil series (CSV)")

    files = commands.add_parser("load-files", help="price and station files to the same tables")
    files.add_argument("prices")
    files.add_argument("stations")
    files.add_argument("--oil", help="landed oil series (CSV)")

    commands.add_parser("features", help="feature tables and daily means")

    train = commands.add_parser("train", help="encoded slice and change model")
    train.add_argument("--rounds", type=int, default=md.BoostParams.rounds)
    train.add_argument("--keep-slice", action="store_true", help="train on the slice that is there")
    train.add_argument("--leafwise", action="store_true", help="the published learner; the model is a text file")
    train.add_argument("--leaky", action="store_true", help="train with the next price, as published")

    evaluate = commands.add_parser("eval", help="score the test days with the saved model")
    evaluate.add_argument("--threshold", type=float, default=mt.THRESHOLD)

    evaluate.add_argument("--model-text", help="a model in the public text format instead")

    tune = commands.add_parser("tune", help="random search")
    tune.add_argument("--leafwise", action="store_true", help="the published learner and its grid")
    tune.add_argument("--train-days", type=int, default=sp.TRAIN_DAYS)
    tune.add_argument("--n-iter", type=int, default=jobs.SEARCH_DRAWS)
    tune.add_argument("--cv-folds", type=int, default=jobs.SEARCH_FOLDS)
    tune.add_argument("--n-jobs", type=int, default=4, help="fits submitted at the same time; below 1: a fixed number")
    tune.add_argument("--random-state", type=int, default=jobs.SEARCH_SEED)
    tune.add_argument("--rounds", type=int, default=jobs.SEARCH_ROUNDS)

    forecast = commands.add_parser("forecast", help="train and apply the price forecast")
    forecast.add_argument("--rounds", type=int, default=md.BoostParams.rounds)

    live = commands.add_parser("forecast-live", help="apply the price forecast to landed live lists")
    live.add_argument("lists", help="JSON files of live stations")
    live.add_argument("--at", type=datetime.fromisoformat, help="moment (UTC unless it has an offset); default now")
    return top


def run(ws: Workspace, args: argparse.Namespace) -> None:
    if args.command == "extract":
        jobs.extract(ws, args.dump)
        if args.oil:
            jobs.load_oil(ws, args.oil)
    elif args.command == "load-files":
        jobs.load_files(ws, args.prices, args.stations)
        if args.oil:
            jobs.load_oil(ws, args.oil)
    elif args.command == "features":
        jobs.build_features(ws)
        jobs.build_means(ws)
    elif args.command == "train":
        if not args.keep_slice:
            jobs.build_slice(ws)
        features = md.LEAKY_FEATURES if args.leaky else md.FEATURES
        if args.leafwise:
            jobs.train_leafwise(ws, lw.LeafwiseParams(rounds=args.rounds), features)
        else:
            jobs.train(ws, md.BoostParams(rounds=args.rounds), features)
    elif args.command == "eval":
        jobs.evaluate(ws, args.threshold, args.model_text).show()
        if ws.read("runs_eval").orderBy("run_at", ascending=False).first()["leaky"]:
            print("The model knows the next price: these figures show a leak, no forecast skill.")
    elif args.command == "tune":
        found = jobs.tune(
            ws, args.train_days, args.n_iter, args.cv_folds, args.n_jobs, args.random_state, args.rounds,
            learner="leafwise" if args.leafwise else "spark",
        )
        print(f"best log loss {found.losses[found.best]:.6f} with {found.points[found.best]}")
    elif args.command == "forecast":
        jobs.train_forecast(ws, md.BoostParams(rounds=args.rounds))
        jobs.forecast(ws).show()
    elif args.command == "forecast-live":
        jobs.forecast_live(ws, args.lists, args.at or datetime.now(timezone.utc)).show()


if __name__ == "__main__":
    arguments = parser().parse_args()
    run(Workspace(build_session(), arguments.root), arguments)
