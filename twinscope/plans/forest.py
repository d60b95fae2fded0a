"""Forests of many candidates in one job: level-wise trees as grouped sums.

Features are cut into bins at quantiles of the real table, so that every side shares them; 0 is
"missing". Rows with the same bins and class collapse into one with a count. A level of all trees of all
candidates is one aggregate on (candidate, tree, node, feature, bin, class); sums of squares of class
counts run along the bins in a window, and the largest picks the split. There is no loop over candidates
or trees and nothing but cut points comes to the driver; the splits of a level are written, so a lost
executor repeats a level at most. Rows are not: they walk down the trees anew, a few steps each.

A tree is an array of ``feature * 256 + bin`` by node, the children of node k being 2k and 2k + 1, so depth
is at most ``DEEPEST``. Models are joined by candidate and chunk of trees, never collected.

Draws are digests of (seed, tree, ...): a row group's weight in a tree is Poisson with its count, the
features of a node are those with the least digests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinscope.frames import CANDIDATE, TablePair
from twinscope.functions.measures import hash_uniform, inverse_normal
from twinscope.plans.frequencies import value_counts
from twinscope.plans.ordered import running_totals
from twinscope.plans.scratch import save_scratch

NODE = [CANDIDATE, "tree", "node"]
MISSING = "nan"     # fixed value: name of the missing class
POISSON_ROWS = 12   # above this mean a count is drawn from the normal curve
DEEPEST = 14
TREES_A_ROW = 25
TASK_ROWS = 500_000   # rows of trees in a task, about
MOST_BINS = 254


def cut_points(real: DataFrame, kinds: dict[str, str], columns, bins: int) -> dict[str, list]:
    """Ascending lower ends of the bins of each column; at most ``bins`` of them, all from the real side."""
    out: dict[str, list] = {c: [] for c in columns}
    for as_type, names in (("string", [c for c in columns if kinds[c] == "string"]), ("double", [c for c in columns if kinds[c] != "string"])):
        if names:
            run = running_totals(value_counts(real, names, as_type), ["n"], ["column"])
            place = F.floor((F.col("run_n") - F.col("n")) * bins / F.col("tot_n"))
            for r in run.groupBy("column", place.alias("bin")).agg(F.min("value").alias("cut")).collect():   # columns x bins
                out[r["column"]].append(r["cut"])
    return {c: sorted(cuts) for c, cuts in out.items()}


def binned(rows: DataFrame, kinds: dict[str, str], cuts: dict[str, list], target: str) -> DataFrame:
    """(candidate, bins, label, n): distinct binned rows and how often they occur."""
    def place(c):
        value = F.col(c).cast("string" if kinds[c] == "string" else "double")
        return F.when(value.isNull(), 0).otherwise(1 + F.size(F.filter(F.array(*[F.lit(x) for x in cuts[c]]), lambda x: x <= value))).cast("int")

    label = F.col(target) if kinds[target] == "string" else F.col(target).cast("double")
    return rows.select(
        CANDIDATE, F.array(*[place(c) for c in cuts]).alias("bins"), F.coalesce(label.cast("string"), F.lit(MISSING)).alias("label")
    ).groupBy(CANDIDATE, "bins", "label").agg(F.count("*").alias("n"))


def _drawn(n: Column, seed: int, key: Column) -> Column:
    """A Poisson count with mean ``n``, by inversion; large means by the normal curve."""
    # The digest is bound to a variable, so that it is taken once and not at every step.
    return F.transform(F.array(hash_uniform(seed, "bootstrap", key)), lambda u: _poisson(n, u))[0]


def _poisson(n: Column, u: Column) -> Column:
    start = F.struct(F.exp(-n).alias("p"), F.exp(-n).alias("sum"), F.lit(0).cast("long").alias("k"))

    def step(s, i):
        p = s["p"] * n / i
        return F.when(s["sum"] > u, s).otherwise(F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), i.cast("long").alias("k")))

    few = F.aggregate(F.sequence(F.lit(1), F.lit(4 * POISSON_ROWS)), start, step, lambda s: s["k"])
    many = F.greatest(F.lit(0), F.round(n + F.sqrt(n) * inverse_normal(u))).cast("long")
    return F.when(n <= POISSON_ROWS, few).otherwise(many)


@dataclass
class Forest:
    """``splits`` (candidate, tree, node, code), ``leaves`` (candidate, tree, node, label, share), ``classes`` (candidate, classes)."""

    splits: DataFrame
    leaves: DataFrame
    classes: DataFrame
    trees: int
    depth: int


def grow(groups: DataFrame, n_features: int, trees: int, depth: int, seed: int = 42, bootstrap: bool = True, features_a_node: int | None = None) -> Forest:
    """Trees of every candidate from (candidate, bins, label, n).

    A node splits where that makes the classes purer (Gini); the smaller feature and bin wins a tie.
    """
    if depth > DEEPEST:
        raise ValueError(f"trees are {DEEPEST} levels deep at most")
    spark, tried = groups.sparkSession, n_features if features_a_node is None else min(features_a_node, n_features)
    row = F.concat_ws("|", CANDIDATE, F.concat_ws(",", "bins"), "label")
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    weights = F.transform(every, lambda t: _drawn(F.col("n"), seed, F.concat_ws("|", t, row)) if bootstrap else F.col("n"))
    rows = _spread(groups, trees).select(CANDIDATE, "bins", "label", weights.alias("weights"))
    rows = save_scratch(rows, "forest-rows")
    classes = save_scratch(groups.groupBy(CANDIDATE).agg(F.sort_array(F.collect_set("label")).alias("classes")), "forest-classes")
    splits = spark.createDataFrame([], f"{CANDIDATE} string, tree int, node int, code int")
    reached = 0
    for level in range(depth):
        state = _walked(rows, Forest(splits, splits, classes, trees, level)).filter((F.col("w") > 0) & (F.col("node") >= 1 << level))
        best = save_scratch(_best_splits(state, n_features, tried, seed), "forest-splits")
        if best.isEmpty():
            break
        splits, reached = splits.unionByName(best), level + 1
    grown = Forest(splits, splits, classes, trees, reached)
    totals = _walked(rows, grown).filter("w > 0").groupBy(*NODE, "label").agg(F.sum("w").alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy(*NODE))   # a node's classes
    grown.leaves = save_scratch(totals.select(*NODE, "label", share.alias("share")), "forest-leaves")
    return grown


def _spread(rows: DataFrame, times: int) -> DataFrame:
    """Few rows that become ``times`` as many each are dealt to as many tasks as those need."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * times // TASK_ROWS))
    return rows.repartition(tasks)


def _models(forest: Forest) -> DataFrame:
    """(candidate, first, models): arrays of codes by node for each chunk of trees."""
    trees = forest.classes.select(CANDIDATE, F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree"))
    if not forest.depth:
        nodes = trees.withColumn("codes", F.array(F.lit(-1)))
    else:
        places = trees.withColumn("node", F.explode(F.sequence(F.lit(1), F.lit((1 << forest.depth) - 1))))
        filled = places.join(forest.splits, NODE, "left").select(*NODE, F.coalesce("code", F.lit(-1)).alias("code"))
        nodes = filled.groupBy(CANDIDATE, "tree").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "code"))), lambda x: x["code"]).alias("codes"))
    chunk = F.floor(F.col("tree") / TREES_A_ROW) * TREES_A_ROW
    listed = F.transform(F.sort_array(F.collect_list(F.struct("tree", "codes"))), lambda x: x["codes"])
    return save_scratch(nodes.groupBy(CANDIDATE, chunk.cast("int").alias("first")).agg(listed.alias("models")), "forest-models")


def _node(codes: Column, bins: Column, depth: int) -> Column:
    """Where a row with these bins comes to rest."""
    def step(node, _):
        code = F.get(codes, node - 1)
        right = (F.get(bins, F.shiftright(code, 8)) > code.bitwiseAND(F.lit(255))).cast("int")
        return F.when(code < 0, node).otherwise(2 * node + right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step) if depth else F.lit(1)


def _walked(rows: DataFrame, forest: Forest) -> DataFrame:
    """(candidate, tree, node, bins, label, w): each row in every tree."""
    joined = rows.join(_models(forest), CANDIDATE)
    at = F.transform("models", lambda m, i: F.struct(
        (F.col("first") + i).cast("int").alias("tree"), _node(m, F.col("bins"), forest.depth).alias("node"), F.get("weights", F.col("first") + i).alias("w")))
    return joined.select(CANDIDATE, "bins", "label", F.inline(at))


def _best_splits(state: DataFrame, n_features: int, tried: int, seed: int) -> DataFrame:
    """(candidate, tree, node, code): rows with a larger bin go right."""
    every = F.sequence(F.lit(0), F.lit(n_features - 1))
    if tried < n_features:
        ranked = F.sort_array(F.transform(every, lambda f: F.struct(F.xxhash64(F.lit(seed), "tree", "node", f).alias("h"), f.alias("f"))))
        every = F.transform(F.slice(ranked, 1, tried), lambda s: s["f"])
    cells = state.select(*NODE, "label", "w", F.inline(F.transform(every, lambda f: F.struct(f.alias("feature"), F.get("bins", f).alias("bin")))))
    # A tree's cells lie together from here on: all that follows needs no other exchange.
    cells = cells.groupBy(*NODE, "feature", "bin", "label").agg(F.sum("w").cast("double").alias("w")).repartition(CANDIDATE, "tree")
    of_class = Window.partitionBy(*NODE, "feature", "label")
    after = F.sum("w").over(of_class.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    c = cells.select("*", after.alias("after"), F.sum("w").over(of_class).alias("all"))
    after, before, rest = F.col("after"), F.col("after") - F.col("w"), F.col("all")
    steps = c.groupBy(*NODE, "feature", "bin").agg(
        F.sum("w").alias("w"), F.sum(after * after - before * before).alias("left_step"),
        F.sum((rest - after) * (rest - after) - (rest - before) * (rest - before)).alias("right_step"))
    whole = Window.partitionBy(*NODE, "feature")
    along = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.select(
        *NODE, "feature", "bin", *[F.sum(s).over(along).alias(s) for s in ("w", "left_step", "right_step")],
        F.sum("w").over(whole).alias("total"), F.sum("left_step").over(whole).alias("squares"))   # the steps add up to the squares of all
    right = F.col("total") - F.col("w")
    purity = F.round(F.col("left_step") / F.col("w") + F.try_divide(F.col("squares") + F.col("right_step"), right), 6)
    found = run.filter(right > 0).withColumn("purity", purity).filter(F.col("purity") > F.round(F.col("squares") / F.col("total"), 6))
    best = F.max(F.struct("purity", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("m")
    return found.groupBy(*NODE).agg(best).select(*NODE, (-F.col("m.f") * 256 - F.col("m.b")).cast("int").alias("code"))


def class_shares(forest: Forest, vectors: DataFrame) -> DataFrame:
    """(candidate, bins, class, score): mean share over the trees, for every distinct ``bins`` and candidate.

    Classes that no tree gives a vector have no row.
    """
    distinct = save_scratch(vectors.select("bins").distinct(), "vectors")
    distinct = _spread(distinct, forest.trees).withColumn("j", F.lit(1))
    rows = distinct.join(_models(forest).withColumn("j", F.lit(1)), "j").drop("j")   # a row a candidate and chunk of trees: what is asked for
    at = F.transform("models", lambda m, i: F.struct((F.col("first") + i).cast("int").alias("tree"), _node(m, F.col("bins"), forest.depth).alias("node")))
    at = rows.select(CANDIDATE, "bins", F.inline(at))
    shares = at.join(forest.leaves, NODE).groupBy(CANDIDATE, "bins", F.col("label").alias("class")).agg(F.sum("share").alias("s"))
    return shares.select(CANDIDATE, "bins", "class", F.round(F.col("s") / forest.trees, 12).alias("score"))


def train(pair: TablePair, target: str, bins: int = 32, trees: int = 100, depth: int = 10, seed: int = 42,
          bootstrap: bool = True, features_a_node: int | None = 0) -> tuple[Forest, DataFrame]:
    """A forest for every candidate of a pair, and the real side as (bins, label, n).

    ``features_a_node`` 0 is the square root of their number, None all of them.
    """
    if not 1 <= bins <= MOST_BINS:
        raise ValueError(f"between 1 and {MOST_BINS} bins")
    features = [c for c in pair.columns if c != target]
    cuts = cut_points(pair.real, pair.kinds, features, bins)
    rows = save_scratch(binned(pair.rows, pair.kinds, cuts, target), "binned")
    some = max(1, round(len(features) ** 0.5)) if features_a_node == 0 else features_a_node
    forest = grow(rows.filter(F.col(CANDIDATE).isNotNull()), len(features), trees, depth, seed, bootstrap, some)
    return forest, rows.filter(F.col(CANDIDATE).isNull()).drop(CANDIDATE)
