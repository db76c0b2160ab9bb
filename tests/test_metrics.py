"""Metrics against hand-made and brute-force values, and the published report."""

from __future__ import annotations

import math
import random

import pytest

from pricetide.operators import metrics as mt


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.random() < 0.4), round(rng.random(), 1)) for i in range(400)]
    return spark.createDataFrame(rows, "id int, y_true int, y_prob double"), rows


def test_published_report(spark):
    # The published confusion matrix and report.
    cells = spark.createDataFrame([(905284, 681, 1617, 2760728)], "tn long, fp long, fn long, tp long")
    report = {r.label: r for r in mt.report_from_cells(cells).collect()}
    published = {
        "0": (0.9982, 0.9992, 0.9987, 905965),
        "1": (0.9998, 0.9994, 0.9996, 2762345),
        "macro avg": (0.9990, 0.9993, 0.9992, 3668310),
        "weighted avg": (0.9994, 0.9994, 0.9994, 3668310),
    }
    for label, figures in published.items():
        row = report[label]
        assert (round(row.precision, 4), round(row.recall, 4), round(row.f1_score, 4), row.support) == figures
    assert round(report["accuracy"].f1_score, 4) == 0.9994 and report["accuracy"].precision is None


def test_empty_cells(spark):
    ones = spark.createDataFrame([(1, 1), (1, 1)], "y_true int, y_pred int")
    assert {(r.y_true, r.y_pred): r.n for r in mt.confusion_matrix(ones).collect()} == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}
    zero = [r for r in mt.classification_report(ones).collect() if r.label == "0"][0]
    assert (zero.precision, zero.recall, zero.f1_score, zero.support) == (0.0, 0.0, 0.0, 0)


def test_auc_counts_ties_half(scored):
    frame, rows = scored
    positive = [p for _, y, p in rows if y]
    negative = [p for _, y, p in rows if not y]
    wins = sum((p > n) + (p == n) / 2 for p in positive for n in negative)
    assert mt.roc_auc(frame).first().roc_auc == pytest.approx(wins / len(positive) / len(negative), abs=1e-12)


def test_log_loss_is_clipped(scored, spark):
    frame, rows = scored
    clip = lambda p: min(max(p, 1e-15), 1 - 1e-15)
    expected = -sum(math.log(clip(p) if y else 1 - clip(p)) for _, y, p in rows) / len(rows)
    assert mt.log_loss(frame).first().log_loss == pytest.approx(expected)
    sure = spark.createDataFrame([(0, 1.0)], "y_true int, y_prob double")
    assert 34 < mt.log_loss(sure).first().log_loss < 35


def test_class_weights(scored):
    frame, rows = scored
    n1 = sum(y for _, y, _ in rows)
    weights = {r.y_true: r.weight for r in mt.class_weights(frame, "y_true").collect()}
    assert weights == pytest.approx({1: 400 / (2 * n1), 0: 400 / (2 * (400 - n1))})
    weighted = mt.with_class_weight(frame, "y_true")
    assert weighted.count() == 400
    assert weighted.groupBy().sum("weight").first()[0] == pytest.approx(400)


def test_regression_metrics(spark):
    pairs = [(1.0, 1.1), (2.0, 1.9), (3.0, 3.2), (4.0, 3.7), (5.0, 5.4), (None, 1.0)]
    frame = spark.createDataFrame(pairs, "actual double, predicted double")
    row = mt.regression_metrics(frame).first()
    known = pairs[:-1]
    assert row.n == 5
    assert row.mse == pytest.approx(sum((a - p) ** 2 for a, p in known) / 5)
    assert row.mae == pytest.approx(sum(abs(a - p) for a, p in known) / 5)
    ma, mp = sum(a for a, _ in known) / 5, sum(p for _, p in known) / 5
    cov = sum((a - ma) * (p - mp) for a, p in known)
    r = cov / math.sqrt(sum((a - ma) ** 2 for a, _ in known) * sum((p - mp) ** 2 for _, p in known))
    assert row.pearson == pytest.approx(r)
    t = r * math.sqrt(3 / (1 - r * r))
    assert row.t == pytest.approx(t)
    test = mt.pearson_p_value(frame).first()
    assert test.t == pytest.approx(t)
    # Student t with 3 degrees of freedom has a closed distribution function.
    x = t / math.sqrt(3)
    assert test.p_value == pytest.approx(1 - 2 / math.pi * (x / (1 + x * x) + math.atan(x)), rel=1e-6)
