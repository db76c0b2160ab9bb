"""Evaluation metrics as one-pass aggregates."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.features import over_threshold

# Default decision threshold and the smallest probability a log is taken of.
THRESHOLD = 0.59
SMALLEST = 1e-15


def with_class(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.withColumn("y_pred", over_threshold(F.col("y_prob"), threshold))


def _cells(scored: DataFrame) -> DataFrame:
    """The four cells of the 2x2 matrix in one row."""
    true, pred = F.col("y_true"), F.col("y_pred")
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return scored.agg(*[F.count_if((true == t) & (pred == p)).alias(name) for name, (t, p) in cells.items()])


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """Rows (y_true, y_pred, n) of the full 2x2 grid, empty cells included."""
    return _cells(scored).selectExpr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (y_true, y_pred, n)")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def _harmonic(a: Column, b: Column) -> Column:
    return _ratio(2 * a * b, a + b)


def classification_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages."""
    return report_from_cells(_cells(scored))


def report_from_cells(cells: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(name) for name in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    measures = {
        "0": (_ratio(tn, tn + fn), _ratio(tn, tn + fp), tn + fp),
        "1": (_ratio(tp, tp + fp), _ratio(tp, tp + fn), tp + fn),
    }
    rows = {name: (p, r, _harmonic(p, r), n) for name, (p, r, n) in measures.items()}
    (*zero, n0), (*one, n1) = rows["0"], rows["1"]
    rows["accuracy"] = (F.lit(None).cast("double"), F.lit(None).cast("double"), _ratio(tn + tp, total), total)
    rows["macro avg"] = (*[(a + b) / 2 for a, b in zip(zero, one)], total)
    rows["weighted avg"] = (*[_ratio(a * n0 + b * n1, total) for a, b in zip(zero, one)], total)
    lines = [
        F.struct(
            F.lit(label).alias("label"),
            p.alias("precision"),
            r.alias("recall"),
            f1.alias("f1_score"),
            n.alias("support"),
        )
        for label, (p, r, f1, n) in rows.items()
    ]
    return cells.select(F.inline(F.array(*lines)))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Rows are counted per score and class first, which combines on the map side; the evaluator then sorts
    the distinct scores by range. `numBins=0` keeps every distinct score. One number comes back.
    """
    counts = scored.groupBy(F.col("y_prob").cast("double").alias("y_prob"), F.col("y_true").cast("double").alias("y_true")).agg(
        F.count("*").cast("double").alias("n")
    )
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="y_prob", labelCol="y_true", weightCol="n", numBins=0)
    return scored.sparkSession.createDataFrame([(evaluator.evaluate(counts),)], "roc_auc double")


def log_loss(scored: DataFrame) -> DataFrame:
    """Mean negative log of the probability given to the true class, over rows with a label and a score."""
    clipped = F.greatest(F.least(F.col("y_prob"), F.lit(1 - SMALLEST)), F.lit(SMALLEST))
    given = F.when(F.col("y_true") == 1, clipped).otherwise(1 - clipped)
    known = scored.where("y_true IS NOT NULL AND y_prob IS NOT NULL")
    return known.agg(F.avg(-F.log(given)).alias("log_loss"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes * rows of the class), one row per class."""
    everything = Window.partitionBy(F.lit(0))
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    classes = F.count("*").over(everything)
    return counts.withColumn("weight", F.sum("n").over(everything) / (classes * F.col("n")))


def with_class_weight(rows: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weight column for training on a 0/1 label (two rows are broadcast)."""
    weights = class_weights(rows.where(F.col(label).isin(0, 1)), label).select(label, F.col("weight").alias(name))
    return rows.join(F.broadcast(weights), label, "left")


def comparison(rows: DataFrame, key: str, actual: str, predicted: str) -> DataFrame:
    """Actual-against-predicted table."""
    return rows.select(key, F.col(predicted).alias("predicted"), F.col(actual).alias("actual"))


def regression_metrics(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Pearson r with its t statistic, MSE and MAE in one pass, over rows where both sides are known."""
    both = rows.dropna(subset=[actual, predicted])
    error = F.col(actual) - F.col(predicted)
    r = F.col("pearson")
    return both.agg(
        F.count("*").alias("n"),
        F.corr(actual, predicted).alias("pearson"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
    ).withColumn("t", r * F.sqrt((F.col("n") - 2) / (1 - r * r)))


def pearson_p_value(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Two-sided p-value of Pearson r, with its t statistic.

    The slope of a one-feature least-squares fit has the same t test as r. The normal-equation solver
    needs one pass over the rows.
    """
    both = rows.dropna(subset=[actual, predicted])
    spread = both.agg(F.count("*").alias("n"), F.stddev_pop(actual).alias("a"), F.stddev_pop(predicted).alias("p")).first()
    if spread.n < 3 or not spread.a or not spread.p:  # r is not defined
        return rows.sparkSession.createDataFrame([(None, None)], "p_value double, t double")
    vectors = VectorAssembler(inputCols=[predicted], outputCol="_x").transform(both)
    fit = LinearRegression(featuresCol="_x", labelCol=actual, solver="normal").fit(vectors)
    slope = [(fit.summary.pValues[0], fit.summary.tValues[0])]
    return rows.sparkSession.createDataFrame(slope, "p_value double, t double")
