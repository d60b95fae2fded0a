"""Machine-learning utility: train on one table, test on the other."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from twinscope.frames import CANDIDATE, TablePair, column_kinds, null_nan
from twinscope.plans import bagging
from twinscope.plans.codes import attach_codes, code_dictionary
from twinscope.plans.forest import class_shares, train
from twinscope.plans.ordered import running_totals
from twinscope.plans.scratch import save_scratch

MISSING = "nan"  # fixed value: name of the missing category
TASK_ROWS = 4096  # of a forest's table: a row costs a walk down every tree on every level
FEW_ROWS = 1 << 14  # with no more to learn from, Spark ML's forest is quick enough row by row


def encode_for_learning(train: DataFrame, test: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with strings as codes fitted on ``train``; a category that ``train`` lacks
    becomes its first class, in the target too."""
    strings = [c for c, k in column_kinds(train).items() if k == "string"]
    if not strings:
        return train, test
    dictionary = code_dictionary(train, strings, missing=MISSING)
    return (
        attach_codes(train, dictionary, strings, unknown=0, missing=MISSING),
        attach_codes(test, dictionary, strings, unknown=0, missing=MISSING),
    )


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """Rows over all cores: a forest's table has few bytes, so that its scan would be a task or two."""
    parts = min(-(-n // TASK_ROWS), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts) if parts > 1 else rows


def train_and_test(train: DataFrame, test: DataFrame, target: str, trees: int = 100, seed: int = 42,
                   depth: int = 30) -> DataFrame:
    """Random forest fitted on ``train``, applied to ``test``: (label, prediction, probability).

    Every row takes part.  A missing number becomes the median of ``train``, and each column that
    lacks numbers in ``train`` has a flag beside it; 0 stands in where ``train`` has no number at all.
    ``probability`` is an array with one entry per training class.

    More than FEW_ROWS rows are counted by their bins, if those are few enough, and grow the trees as such
    (``plans.bagging``); Spark ML grows all other forests.
    """
    kinds = column_kinds(train)
    train, test = encode_for_learning(train, test, target)
    features = [c for c in train.columns if c != target]
    if kinds[target] != "string":
        # Number targets are numbered too; a test value unseen in training can never be right.
        classes = code_dictionary(train.select(F.col(target).cast("double").alias(target)), [target])
        train, test = (
            attach_codes(t.withColumn(target, F.col(target).cast("double")), classes, [target], unknown=-1)
            for t in (train, test)
        )
    train, test = (null_nan(t.select(target, *[F.col(c).cast("double").alias(c) for c in features])) for t in (train, test))
    # One row: the number of rows, the median and the number of gaps of each column.
    found = train.agg(F.count("*").alias("n"), *[F.percentile_approx(c, 0.5, 10_000).alias(f"m{i}") for i, c in enumerate(features)],
                      *[F.count_if(F.col(c).isNull()).alias(f"g{i}") for i, c in enumerate(features)]).first()
    flags = [c for i, c in enumerate(features) if found[f"g{i}"]]
    numeric = [F.coalesce(F.col(c), F.lit(float(found[f"m{i}"] or 0.0))).alias(f"x{i}") for i, c in enumerate(features)]
    numeric += [F.col(c).isNull().cast("double").alias(f"f{i}") for i, c in enumerate(flags)]
    inputs = [f"x{i}" for i in range(len(features))] + [f"f{i}" for i in range(len(flags))]

    def numbers(t):
        return t.select(*numeric, F.col(target).cast("double").alias("label"))

    if features and found["n"] > FEW_ROWS:
        known = numbers(train)
        scored = bagging.predictions(known, numbers(test), bagging.thresholds(known, inputs), trees, depth, seed)
        if scored is not None:
            return scored
    gather = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")

    def prepared(t):
        return gather.transform(numbers(t)).select("features", "label")

    # Training passes over its input many times: materialise it once.
    ready = save_scratch(_spread(prepared(train), found["n"]), "train")
    forest = RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=depth, maxMemoryInMB=512)
    # A copy lacks the training summary, which holds the session: after an observed query no task can take that.
    scored = forest.fit(ready).copy().transform(_spread(prepared(test), test.count()))
    return scored.select("label", "prediction", vector_to_array("probability").alias("probability"))


def classification_scores(predictions: DataFrame) -> DataFrame:
    """One row: accuracy and support-weighted F1 (0 where undefined) from (label, prediction)."""
    return _scores_of_cells(predictions.groupBy("label", "prediction").agg(F.count("*").alias("n")))


def _scores_of_cells(cells: DataFrame, by=()) -> DataFrame:
    """The same from (by..., label, prediction, n)."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    long = cells.select(
        *by, F.inline(F.array(
            F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("tp")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
        ))
    )
    per_class = long.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return per_class.groupBy(*by).agg(
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1_score"),
    )


def auc_one_vs_rest(scores: DataFrame, binary_is_zero: bool = False) -> DataFrame:
    """One row ``auc``: area under the curve per class by rank sums, weighted by support.

    ``scores`` has (class, score, is_class, weight) or comes from ``class_scores``.  Counts per
    score are accumulated in score order over buckets, so no class is ranked in one task.
    ``binary_is_zero`` reproduces the behaviour of reporting 0 for two classes.
    """
    return _areas(scores, F.lit(1), (), binary_is_zero)


def _areas(scores: DataFrame, weight, by=(), binary_is_zero: bool = False) -> DataFrame:
    by = list(by)
    hit = F.col("is_class")
    counts = scores.groupBy(*by, "class", F.col("score").cast("double").alias("value")).agg(
        F.sum(F.when(hit, weight).otherwise(0)).cast("long").alias("pos"), F.sum(F.when(~hit, weight).otherwise(0)).cast("long").alias("neg")
    )
    run = running_totals(counts, ["pos", "neg"], [*by, "class"])
    below = F.col("run_neg") - F.col("neg") / 2.0  # ties count half
    per_class = run.groupBy(*by, "class").agg(
        F.sum(F.col("pos") * below).alias("wins"), F.max("tot_pos").alias("p"), F.max("tot_neg").alias("q")
    )
    area = F.try_divide(F.col("wins"), F.col("p").cast("double") * F.col("q"))
    total = per_class.groupBy(*by).agg(
        F.try_divide(F.sum(area * F.col("p")), F.sum(F.when(area.isNotNull(), F.col("p")))).alias("auc"),
        F.count("*").alias("k"),
    )
    auc = F.coalesce("auc", F.lit(0.0))
    return total.select(*by, F.when((F.col("k") <= 2) & F.lit(binary_is_zero), 0.0).otherwise(auc).alias("auc"))


def class_scores(predictions: DataFrame) -> DataFrame:
    """(class, score, is_class): one row per test row and training class."""
    return predictions.select("label", F.posexplode("probability").alias("class", "score")).select(
        "class", "score", (F.col("label") == F.col("class")).alias("is_class")
    )


def utility(train: DataFrame, test: DataFrame, target: str, **forest) -> DataFrame:
    """One row: accuracy, f1_score, auc of a forest trained on ``train`` and tested on ``test``."""
    predictions = save_scratch(train_and_test(train, test, target, **forest), "predictions")
    scores = classification_scores(predictions).withColumn("j", F.lit(1))
    return scores.join(auc_one_vs_rest(class_scores(predictions)).withColumn("j", F.lit(1)), "j", "left").drop("j")


def candidate_forests(pair: TablePair, target: str, **forest) -> DataFrame:
    """(candidate, accuracy, f1_score, auc): forests of all candidates grown in one plan (``plans.forest``),
    tested on the real rows, which are read once.

    Columns are as in ``train_and_test``: a class that a candidate lacks becomes its first one if the
    target is a string, and can never be right otherwise. A candidate without rows gets none.
    """
    grown, real = train(pair, target, **forest)
    shares = save_scratch(class_shares(grown, real), "shares")
    # The best score and, among equals, the smaller class.
    guess = shares.groupBy(CANDIDATE, "bins").agg(F.min(F.struct((-F.col("score")).alias("s"), "class")).alias("m")).select(CANDIDATE, "bins", F.col("m.class").alias("prediction"))
    unseen = F.col("classes")[0] if pair.kinds[target] == "string" else F.lit(None).cast("string")
    truth = real.join(guess, "bins").join(F.broadcast(grown.classes), CANDIDATE).withColumn(   # one row a candidate
        "label", F.when(F.array_contains("classes", F.col("label")), F.col("label")).otherwise(unseen))
    truth = save_scratch(truth.groupBy(CANDIDATE, "bins", "classes", "label", "prediction").agg(F.sum("n").alias("n")), "tested")
    cells = truth.groupBy(CANDIDATE, "label", "prediction").agg(F.sum("n").alias("n"))
    held = truth.select(CANDIDATE, "bins", F.explode("classes").alias("class"), "label", "n")
    scored = held.join(shares, [CANDIDATE, "bins", "class"], "left").select(
        CANDIDATE, "class", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(F.col("label") == F.col("class"), F.lit(False)).alias("is_class"), "n")
    return _scores_of_cells(cells, [CANDIDATE]).join(_areas(scored, F.col("n"), [CANDIDATE]), CANDIDATE, "left")


def cross_test(pair: TablePair, target: str, **forest) -> DataFrame:
    """(direction, accuracy, f1_score, auc) for both directions."""
    there = utility(pair.synthetic, pair.real, target, **forest).withColumn("direction", F.lit("synthetic_to_real"))
    back = utility(pair.real, pair.synthetic, target, **forest).withColumn("direction", F.lit("real_to_synthetic"))
    return there.unionByName(back).select("direction", "accuracy", "f1_score", "auc")
