"""Evaluation of predictions: accuracy, per-label precision, recall and F1, confusion matrix, threshold sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from .decision import Thresholds, decide_label, no_scores, pending_questions


def accuracy(d: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """One row; 0 for no rows."""
    return d.agg(F.coalesce(F.avg((F.col(gold) == F.col(pred)).cast("double")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def ratio(x: Column, y: Column) -> Column:
    return F.when(y > 0, x / y).otherwise(0.0)


def per_label(d: DataFrame, labels: Sequence[str] = L.LABELS, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """label, support, precision, recall, f1: a row for each label, even without rows. One shuffle of (gold, pred) counts."""
    cells = d.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("g").alias("label"), F.lit("gold").alias("side")), F.struct(F.col("p").alias("label"), F.lit("pred").alias("side")))).alias("x"), "g", "p", "n")
    total = sides.groupBy("x.label").agg(
        F.sum(F.when((F.col("x.side") == "gold") & (F.col("g") == F.col("p")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("x.side") == "gold", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("x.side") == "pred", F.col("n")).otherwise(0)).alias("predicted"),
    )
    every = d.sparkSession.createDataFrame([(k,) for k in labels], "label string")
    c = F.broadcast(every).join(total, "label", "left").na.fill(0, ["tp", "support", "predicted"])
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return c.select("label", "support", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def macro_f1(d: DataFrame, labels: Sequence[str] = L.LABELS, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Mean F1 of the labels that occur; 0 if none does."""
    return per_label(d, labels, gold, pred).where("support > 0").agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def accuracy_and_f1(d: DataFrame, labels: Sequence[str] = L.LABELS, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """accuracy() and macro_f1() in one row and one pass over the rows, which are counted by gold and predicted label first."""
    g, p, n = F.col("g"), F.col("p"), F.col("n")
    cells = d.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    counts = [F.struct(total((g == k) & (p == k)).alias("tp"), total(g == k).alias("support"), total(p == k).alias("predicted")) for k in labels]
    # a row without a gold or a predicted label counts in n, but is neither right nor wrong
    one = cells.agg(total(g == p).alias("right"), total((g == p).isNotNull()).alias("judged"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array(*counts).alias("counts"))
    occurring = F.filter("counts", lambda c: c["support"] > 0)

    def f1(c: Column) -> Column:
        precision, recall = ratio(c["tp"], c["predicted"]), ratio(c["tp"], c["support"])
        return ratio(2 * precision * recall, precision + recall)

    mean = ratio(F.aggregate(F.transform(occurring, f1), F.lit(0.0), lambda acc, x: acc + x), F.size(occurring))
    return one.select(ratio(F.col("right"), F.col("judged")).alias("accuracy"), mean.alias("macro_f1"), "n")


def confusion_matrix(d: DataFrame, labels: Sequence[str] = L.LABELS, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return d.groupBy(F.col(gold).alias("gold")).pivot(pred, list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def mistakes(d: DataFrame, gold: str = "gold", pred: str = "pred", chars: int = 110) -> DataFrame:
    return d.where(F.col(gold) != F.col(pred)).select(gold, pred, F.substring("text", 1, chars).alias("text"))


def report(d: DataFrame, labels: Sequence[str] = L.LABELS) -> DataFrame:
    """A formatted line for each label."""
    p = per_label(d, labels)
    cell = lambda c: F.lpad(F.format_number(F.col(c) * 100, 1), 6, " ")
    return p.select("label", F.concat_ws(" ", F.rpad("label", 16, " "), cell("precision"), cell("recall"), cell("f1"), F.lpad(F.col("support").cast("string"), 5, " ")).alias("line"))


def model_call_count(questions: DataFrame, column: str = "questions") -> DataFrame:
    return questions.agg(F.coalesce(F.sum(F.size(column)), F.lit(0)).cast("long").alias("calls"))


def masked(scores: Column, asked: Column) -> Column:
    """The scores of the questions that were asked."""
    return F.struct(*[F.when(F.array_contains(asked, q), scores[q]).alias(q) for q in ("hiring", "bait", "scam")])


def in_rounds(d: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds `pred` and `calls` to rows of features, text_units and scores: what comes out if only the questions that the rules leave open are answered, in two rounds."""
    f, units, s = F.col("features"), F.col("text_units"), F.col("scores")
    # step by step, so that each is computed once, whatever mentions it
    d = d.select("*", pending_questions(f, no_scores(), units, t).alias("_first"))
    d = d.select("*", masked(s, F.col("_first")).alias("_known"))
    d = d.select("*", F.array_union("_first", pending_questions(f, F.col("_known"), units, t)).alias("_asked"))
    d = d.select("*", masked(s, F.col("_asked")).alias("_scores"))
    return d.select("*", decide_label(f, F.col("_scores"), t).alias("pred"), F.size("_asked").alias("calls")).drop("_first", "_known", "_asked", "_scores")


def outcomes(d: DataFrame) -> DataFrame:
    """Adds `outcomes`, the eight labels that scores can lead to, at 4 * (hiring passed) + 2 * (bait over) + (scam over), to rows of features and text_units."""
    f, units, half = F.col("features"), F.col("text_units"), Thresholds(0.5, 0.5, 0.5)
    bit = lambda on: F.lit(1.0 if on else 0.0)
    d = d.select("*", pending_questions(f, no_scores(), units, half).alias("_first"))
    # only a passed hiring question opens others
    passed = F.struct(bit(1).alias("hiring"), F.lit(None).cast("double").alias("bait"), F.lit(None).cast("double").alias("scam"))
    d = d.select("*", F.array_union("_first", pending_questions(f, passed, units, half)).alias("_asked"))
    each = [masked(F.struct(bit(k & 4).alias("hiring"), bit(k & 2).alias("bait"), bit(k & 1).alias("scam")), F.col("_asked")) for k in range(8)]
    return d.select("*", F.array(*[decide_label(f, s, half) for s in each]).alias("outcomes")).drop("_first", "_asked")


def swept_labels(d: DataFrame, hiring: Sequence[float], bait: Sequence[float], scam: Sequence[float], labels: Sequence[str] = L.LABELS) -> DataFrame:
    """sweep() of all thresholds over rows of gold, features, text_units and scores.

    A row's label depends on the thresholds only by which of them its scores reach, and only
    for questions that can change its label. So rows are first counted by gold label, possible
    outcomes and the numbers of thresholds reached; only these counts meet the grid. Null
    scores reach every hiring threshold and no other.
    """
    reached = lambda c, grid: F.size(F.filter(F.lit(sorted(grid)), lambda t: c >= t))
    s, o = F.col("scores"), lambda k: F.get("outcomes", F.lit(k))
    matters = {q: sum(((o(k) != o(k | b)).cast("int") for k in range(8) if not k & b), F.lit(0)) > 0 for q, b in (("hiring", 4), ("bait", 2), ("scam", 1))}
    grids = {"hiring": hiring, "bait": bait, "scam": scam}
    places = [F.when(~matters[q], 0).when(s[q].isNull(), len(g) if q == "hiring" else 0).otherwise(reached(s[q], g)).alias(q) for q, g in grids.items()]
    cells = outcomes(d.select("gold", "features", "text_units", "scores")).select("gold", "outcomes", *places).groupBy("gold", "outcomes", *grids).agg(F.count("*").alias("weight"))
    grid = threshold_grid(d.sparkSession, hiring, bait, scam)
    over = [(F.col(q) >= F.array_position(F.lit(sorted(g)), F.col(f"t_{q}"))).cast("int") for q, g in grids.items()]
    return sweep(cells, grid, F.get("outcomes", 4 * over[0] + 2 * over[1] + over[2]), labels, weight="weight")


def steps(low: float, high: float, by: float) -> list[float]:
    return [round(low + k * by, 2) for k in range(round((high - low) / by) + 1)]


#: The thresholds that a sweep tries.
GRID = {"hiring": steps(0.05, 0.95, 0.05), "bait": steps(0.5, 0.99, 0.03), "scam": steps(0.5, 0.99, 0.03)}


def current_row(swept: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """How the thresholds in use do; no row if they are not in the grid."""
    return swept.where((F.col("t_hiring") == t.hiring) & (F.col("t_bait") == t.bait) & (F.col("t_scam") == t.scam))


def threshold_grid(spark: SparkSession, hiring: Sequence[float], bait: Sequence[float], scam: Sequence[float]) -> DataFrame:
    """Every combination of a few listed thresholds, in order; its size is that of the lists, not of any data."""
    rows = [(i, h, b, s) for i, (h, b, s) in enumerate((h, b, s) for h in hiring for b in bait for s in scam)]
    return spark.createDataFrame(rows, "grid_ord int, t_hiring double, t_bait double, t_scam double")


def sweep(d: DataFrame, grid: DataFrame, pred: Column, labels: Sequence[str] = L.LABELS, gold: str = "gold", weight: str | None = None) -> DataFrame:
    """Per grid row: accuracy and macro-F1 of `pred`, an expression over the rows' columns and t_hiring, t_bait, t_scam. weight: rows that a row stands for.

    Rows are first reduced to counts of (gold, prediction) cells within their grid row by partial aggregation.
    """
    cells = d.join(F.broadcast(grid)).groupBy("grid_ord", "t_hiring", "t_bait", "t_scam", F.col(gold).alias("g"), pred.alias("p")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    at = ["grid_ord", "t_hiring", "t_bait", "t_scam"]
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    aggs = [F.sum("n").alias("n"), n(F.col("g") == F.col("p")).alias("right")]
    for i, k in enumerate(labels):
        aggs += [n((F.col("g") == k) & (F.col("p") == k)).alias(f"tp{i}"), n(F.col("g") == k).alias(f"gold{i}"), n(F.col("p") == k).alias(f"pred{i}")]
    wide = cells.groupBy(*at).agg(*aggs)
    f1 = [F.when(F.col(f"gold{i}") > 0, ratio(2.0 * F.col(f"tp{i}"), F.col(f"gold{i}") + F.col(f"pred{i}"))) for i in range(len(labels))]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in f1), F.lit(0.0))
    occurring = sum((x.isNotNull().cast("int") for x in f1), F.lit(0))
    return wide.select(*at, ratio(F.col("right").cast("double"), F.col("n")).alias("accuracy"), ratio(total, occurring).alias("macro_f1"))


def best_order() -> list[Column]:
    """Higher F1, then accuracy, then stricter thresholds, then grid order; rounded so that equal sums tie."""
    return [F.desc(F.round("macro_f1", 9)), F.desc(F.round("accuracy", 9)), F.desc(F.round(F.col("t_scam") + F.col("t_bait"), 6)), F.asc("grid_ord")]


def sweep_top(swept: DataFrame, k: int = 8) -> DataFrame:
    return swept.orderBy(*best_order()).limit(k)


def best_per_hiring(swept: DataFrame) -> DataFrame:
    return swept.withColumn("at", F.row_number().over(W.partitionBy("t_hiring").orderBy(*best_order()))).where("at = 1").drop("at")
