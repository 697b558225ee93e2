"""The training frame, pseudo-labels, splits, the forest and its evaluation."""

from __future__ import annotations

import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow import fixed
from winnow.config import Settings
from winnow.functions import skills
from winnow.functions.common import is_blank
from winnow.operators.dashboard import first_uploads
from winnow.operators.slices import Part, materialize, ordered_rank, scratch_folder, spread

# The forest and its evaluation.
TREES, DEPTH, SEED = 200, 10, 42
MIN_SPLIT = 5  # rows a node needs to be split
TEST_SHARE, FOLDS = 0.2, 5
MIN_CLASS_ROWS, RELABEL_QUANTILE = 5, 0.75
# Histogram cells per pass of an exact quantile, and leading hash digits that split a class into parts.
CELLS, HASH_DIGITS = 1000, 4
# Counts that fits side by side may keep in all: MLlib holds one of 4 bytes per row and tree for as long as a fit lasts.
FIT_COUNTS = 1_000_000_000
# Ranks that the sketch of a quantile tells apart.
SKETCH = 100_000


# --- rows ------------------------------------------------------------------------------------------------------------

def store_rows(candidates: DataFrame) -> DataFrame:
    """Stored candidates usable for training: those with text, the job defaulted."""
    return candidates.filter(F.col("raw_text").isNotNull() & ~is_blank(F.col("raw_text"))).withColumn(
        "job_description", F.coalesce("job_description", F.lit(fixed.DEFAULT_TRAINING_JOB)))


def first_by_filename(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per file name over all batches, the earliest."""
    return first_uploads(rows, ["filename"], order)


def combine(sheet: DataFrame, stored: DataFrame) -> DataFrame:
    """Both sources with the union of their columns, told apart by ``from_sheet``."""
    return sheet.withColumn("from_sheet", F.lit(True)).unionByName(
        stored.withColumn("from_sheet", F.lit(False)), allowMissingColumns=True)


def skills_count_by_source(from_sheet: Column, sheet_skills: Column, stored_skills: Column, text: Column,
                           settings: Settings) -> Column:
    """Sheet rows count terms in their Skills text, stored rows their list, others terms in the text."""

    def count(col: Column) -> Column:
        return F.size(skills.matched_skills(col, settings.vocabulary))

    return (
        F.when(from_sheet & sheet_skills.isNotNull(), count(sheet_skills))
        .when(stored_skills.isNotNull(), F.size(stored_skills))
        .otherwise(count(text))
    )


def years_by_source(from_sheet: Column, sheet_years: Column, extracted: Column) -> Column:
    """The sheet's years, whole and capped; unusable or absent ones fall back to the extracted years."""
    stated = sheet_years.try_cast("double").try_cast("int")
    usable = from_sheet & stated.isNotNull()
    return F.when(usable, F.least(stated, F.lit(fixed.MAX_YEARS))).otherwise(extracted)


# --- labels ------------------------------------------------------------------------------------------------------------

def kth_smallest(counted: DataFrame, k: int) -> float:
    """The value at 0-based place ``k`` of ``counted`` values (``v, n``), exactly.

    Each pass counts the values into at most ``CELLS`` cells (combined on the map side) and goes on with the one
    cell that holds the place, so no task ever holds the column.
    """
    value = F.col("v")
    low, high = counted.agg(F.min("v"), F.max("v")).head()
    while low < high:
        inside = counted.filter((value >= low) & (value <= high))
        cell = F.floor((value - low) / (high - low) * CELLS)
        cells = inside.groupBy(cell.alias("cell")).agg(
            F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for entry in cells.orderBy("cell").collect():  # at most CELLS + 1 rows
            if k < entry["n"]:
                low, high = entry["low"], entry["high"]
                break
            k -= entry["n"]
    return low


def exact_quantile(rows: DataFrame, name: str, q: float) -> float:
    """Quantile with linear interpolation between neighbours, exact, in two passes over ``rows``.

    A mergeable sketch, off by at most one rank in ``SKETCH``, brackets the place. A second pass counts what lies below
    the bracket and each value inside it; the few counted values are written down and settle the place. Should the sketch
    have missed it, as it may for few rows, the pass is taken again without a bracket.
    """
    value, off = F.col(name), 4 / SKETCH
    sketch = F.percentile_approx(name, F.array(F.lit(max(q - off, 0.0)), F.lit(min(q + off, 1.0))), SKETCH)
    known, ends = rows.agg(F.count(name), sketch).head()
    if not known:
        raise ValueError(f"no rows with {name}: a quantile needs at least one")
    place = q * (known - 1)
    first, last = math.floor(place), math.ceil(place)
    for low, high in (ends, (None, None)):
        inside = F.lit(True) if low is None else value >= low
        upto = value.isNotNull() if high is None else value <= high
        counted = materialize(rows.filter(upto).groupBy(F.when(inside, value).alias("v")).agg(F.count(F.lit(1)).alias("n")))
        below = counted.filter("v is null").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
        near = counted.filter("v is not null")
        within = near.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
        if below <= first and last < below + within:
            break
    lower = kth_smallest(near, first - below)
    upper = lower if first == last else kth_smallest(near, last - below)
    return lower + (upper - lower) * (place - first)


def label_threshold(rows: DataFrame, name: str = "quality_score") -> float:
    """The fixed threshold, or the upper quartile if that leaves a class with too few rows."""
    strong = F.count_if(F.col(name) >= fixed.STRONG_THRESHOLD)
    counts = rows.agg(strong.alias("strong"), (F.count(F.lit(1)) - strong).alias("weak")).head()
    if min(counts["strong"], counts["weak"]) >= MIN_CLASS_ROWS:
        return fixed.STRONG_THRESHOLD
    return exact_quantile(rows, name, RELABEL_QUANTILE)


def pseudo_labels(rows: DataFrame, name: str = "quality_score") -> DataFrame:
    """Adds ``threshold`` and ``shortlisted``. Pass materialized ``rows``: the threshold takes passes of its own."""
    threshold = label_threshold(rows, name)
    return rows.select("*", F.lit(threshold).alias("threshold"),
                       (F.col(name) >= threshold).cast("int").alias("shortlisted"))


def feature_summary(rows: DataFrame) -> DataFrame:
    """One row: means and deviations of the scores, means of the counts, sums of the flags, quality range."""
    spread = ["skills_match_score", "certificate_relevance", "project_relevance", "education_quality"]
    return rows.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in spread],
        *[F.stddev_samp(c).alias(f"std_{c}") for c in spread],
        *[F.avg(c).alias(f"mean_{c}") for c in ("skills_count", "experience_years")],
        *[F.sum(c).cast("bigint").alias(f"sum_{c}") for c in ("has_experience", "has_contact")],
        F.min("quality_score").alias("min_quality"), F.max("quality_score").alias("max_quality"),
        F.avg("quality_score").alias("mean_quality"), F.count(F.lit(1)).alias("n"),
    )


# --- splits ------------------------------------------------------------------------------------------------------------

def shuffled_rank(rows: DataFrame, label: str, key: str, name: str) -> DataFrame:
    """Place of each row in a fixed random order of its class, by hash of its key.

    Classes are few and large; the hash's leading digits split each into parts that rank in parallel.
    """
    hashed = rows.withColumn("_hash", F.md5(F.col(key).cast("string")))
    return ordered_rank(hashed, [label], [Part(F.substring("_hash", 1, HASH_DIGITS))],
                        [F.col("_hash"), F.col(key)], name).drop("_hash")


def _checked(rows: DataFrame, label: str) -> DataFrame:
    """``rows``; a label that is null or neither 0 nor 1 stops the query instead of losing the row."""
    wrong = F.raise_error(F.concat(F.lit(f"{label} must be 0 or 1, not "), F.coalesce(F.col(label).cast("string"), F.lit("null"))))
    return rows.withColumn(label, F.when(F.coalesce(F.col(label).isin(0, 1), F.lit(False)), F.col(label)).otherwise(
        wrong.cast(rows.schema[label].dataType)))


def _class_sizes(rows: DataFrame, label: str) -> DataFrame:
    """Rows per class: labels are 0 and 1, so at most two rows, which are safe to broadcast."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))


def stratified_split(rows: DataFrame, label: str, key: str, share: float = TEST_SHARE) -> DataFrame:
    """Adds ``is_test``: the first ``share`` of each class in shuffled order, rounded up."""
    rows = _checked(rows, label)
    ranked = shuffled_rank(rows, label, key, "_place").join(
        F.broadcast(_class_sizes(rows, label)), label)
    return ranked.withColumn("is_test", F.col("_place") <= F.ceil(F.col("_size") * share)).drop("_place", "_size")


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int = FOLDS) -> DataFrame:
    """Adds ``fold``, dealing each class out in shuffled order."""
    ranked = shuffled_rank(_checked(rows, label), label, key, "_place")
    return ranked.withColumn("fold", ((F.col("_place") - 1) % folds).cast("int")).drop("_place")


def balance_weights(rows: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` = n / (classes * class size)."""
    rows = _checked(rows, label)
    both = Window.partitionBy(F.lit(0))  # over the class sizes: at most two rows
    factors = _class_sizes(rows, label).select(
        label, (F.sum("_size").over(both) / (F.count(F.lit(1)).over(both) * F.col("_size"))).alias("weight"))
    return rows.join(F.broadcast(factors), label)


# --- forest --------------------------------------------------------------------------------------------------------------

def _prepared(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in fixed.MODEL_FEATURES})


def fit_forest(rows: DataFrame, label: str = "shortlisted", trees: int = TREES, depth: int = DEPTH,
               seed: int = SEED, min_split: int = MIN_SPLIT) -> PipelineModel:
    """A class-balanced random forest over the model features, nulls as 0. Nodes of fewer than ``min_split`` rows are
    leaves. Pass materialized ``rows``.

    Every level of the trees is a pass over the rows, and a row costs all trees, so a table of few bytes is a lot of work:
    the rows are dealt to all cores, however few files or splits hold them.
    """
    dealt = spread(_prepared(rows).select(label, *fixed.MODEL_FEATURES))
    weighted = balance_weights(dealt, label).withColumn(label, F.col(label).cast("double"))
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    assembler = VectorAssembler(inputCols=list(fixed.MODEL_FEATURES), outputCol="features")
    fitted = Pipeline(stages=[assembler, forest]).fit(weighted.select(label, "weight", *fixed.MODEL_FEATURES))
    return PipelineModel([fitted.stages[0], with_min_split(fitted.stages[1], rows.sparkSession, min_split)])


def forest_nodes(path: str, spark) -> DataFrame:
    """The node table of a forest saved at ``path``: ``treeID, nodeData``."""
    return spark.read.parquet(f"{path}/data")


def small_splits_collapsed(nodes: DataFrame, min_split: int) -> DataFrame:
    """``nodes`` of a forest without the descendants of nodes with fewer than ``min_split`` rows, which become leaves.

    A node's statistics hold its prediction, so a leaf needs nothing new. A child has no more rows than its parent, so a
    node stays exactly if its parent is still split. Nodes are numbered anew, in order, from 0 in each tree; a tree has at
    most ``2 ** (depth + 1)`` of them.
    """
    node = F.col("nodeData")
    split = (node["leftChild"] >= 0) & (node["rawCount"] >= min_split)
    marked = nodes.select("treeID", "nodeData", split.alias("split"), node["id"].alias("id"))
    children = marked.filter("split").select("treeID", F.explode(F.array("nodeData.leftChild", "nodeData.rightChild")).alias("id"))
    kept = marked.join(children, ["treeID", "id"], "left_semi").unionByName(marked.filter("id = 0"))
    number = F.row_number().over(Window.partitionBy("treeID").orderBy("id")) - 1
    kept = kept.withColumn("new", number)
    names = kept.select("treeID", F.col("id").alias("old"), F.col("new").alias("name"))
    left, right = names.withColumnsRenamed({"old": "leftChild", "name": "newLeft"}), names.withColumnsRenamed({"old": "rightChild", "name": "newRight"})
    joined = kept.select("*", "nodeData.leftChild", "nodeData.rightChild").join(
        left, ["treeID", "leftChild"], "left").join(right, ["treeID", "rightChild"], "left")
    fields = nodes.schema["nodeData"].dataType
    none = {"leftChild": F.lit(-1), "rightChild": F.lit(-1), "gain": F.lit(-1.0),
            "split": F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"),
                              F.lit(-1).alias("numCategories"))}
    split_values = {"leftChild": F.col("newLeft"), "rightChild": F.col("newRight")}
    values = {f.name: node[f.name] for f in fields} | {"id": F.col("new")}
    for name, leaf in none.items():
        values[name] = F.when(F.col("split"), split_values.get(name, node[name])).otherwise(leaf.cast(fields[name].dataType))
    return joined.select("treeID", F.struct(*[v.cast(fields[k].dataType).alias(k) for k, v in values.items()]).alias("nodeData"))


def with_min_split(forest: RandomForestClassificationModel, spark, min_split: int) -> RandomForestClassificationModel:
    """``forest`` with small splits collapsed, by way of its saved form in the shared folder."""
    saved, edited = (f"{scratch_folder(spark)}/forest-{uuid.uuid4().hex}" for _ in range(2))
    forest.save(saved)
    small_splits_collapsed(forest_nodes(saved, spark), min_split).coalesce(1).write.parquet(f"{edited}/data")
    spark.read.parquet(f"{saved}/treesMetadata").coalesce(1).write.parquet(f"{edited}/treesMetadata")
    spark.read.text(f"{saved}/metadata").coalesce(1).write.text(f"{edited}/metadata")
    return RandomForestClassificationModel.load(edited)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds ``probability_strong`` and ``predicted``. The rows' own columns keep their values."""
    own = F.struct(*rows.columns).alias("_own")
    scored = model.transform(_prepared(rows.select("*", own)))
    probabilities = vector_to_array("probability")
    # A model that saw only one class has no probability for the other.
    strong = F.coalesce(F.get(probabilities, F.lit(1)), F.lit(0.0))
    return scored.select("_own.*", strong.alias("probability_strong"),
                         F.col("prediction").cast("int").alias("predicted"))


def cross_validate(rows: DataFrame, label: str, key: str, trees: int = TREES, folds: int = FOLDS) -> DataFrame:
    """One row per fold with its held-out accuracy. Pass materialized ``rows``. Folds are fitted side by side, so that
    the short jobs of one fill the gaps of another, as far as ``FIT_COUNTS`` allows; of many rows one after the other."""
    dealt = materialize(stratified_folds(rows, label, key, folds))
    at_once = max(1, min(folds, FIT_COUNTS // (trees * max(1, dealt.count()))))

    @inheritable_thread_target(rows.sparkSession)
    def score(fold: int) -> DataFrame:
        model = fit_forest(dealt.filter(F.col("fold") != fold), label, trees)
        held_out = predict(model, spread(dealt.filter(F.col("fold") == fold)))
        return held_out.groupBy("fold").agg(
            F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"),
            F.count(F.lit(1)).alias("n"))

    with ThreadPoolExecutor(at_once) as pool:
        return reduce(DataFrame.unionByName, pool.map(score, range(folds)))


def accuracy_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"))


def importances(model: PipelineModel, spark) -> DataFrame:
    """Feature importances, least important first. One row per feature."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    return spark.createDataFrame(list(zip(fixed.MODEL_FEATURES, values)), "feature string, importance double").orderBy(
        "importance")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark, path: str) -> PipelineModel | None:
    """The saved model, or None if there is none: callers then score without a model."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location):
        return None
    return PipelineModel.load(path)


# --- evaluation --------------------------------------------------------------------------------------------------------

def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """All four cells of the 2x2 matrix, empty ones as 0."""
    hit = [F.count_if((F.col(label) == a) & (F.col(predicted) == p)) for a in (0, 1) for p in (0, 1)]
    cells = F.array(*[F.struct(F.lit(i // 2).alias("actual"), F.lit(i % 2).alias("predicted"), F.col(f"c{i}").alias("n"))
                      for i in range(4)])
    return rows.agg(*[h.alias(f"c{i}") for i, h in enumerate(hit)]).select(F.inline(cells))


def class_report(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class and averaged, and accuracy; undefined ratios count as 0."""
    y, p = F.col(label), F.col(predicted)
    counts = rows.agg(
        F.count_if((y == 0) & (p == 0)).alias("c00"), F.count_if((y == 0) & (p == 1)).alias("c01"),
        F.count_if((y == 1) & (p == 0)).alias("c10"), F.count_if((y == 1) & (p == 1)).alias("c11"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    c = {name: F.col(name) for name in ("c00", "c01", "c10", "c11")}
    per_class = counts.select(
        *c.values(),
        ratio(c["c00"], c["c00"] + c["c10"]).alias("p0"), ratio(c["c00"], c["c00"] + c["c01"]).alias("r0"),
        ratio(c["c11"], c["c11"] + c["c01"]).alias("p1"), ratio(c["c11"], c["c11"] + c["c10"]).alias("r1"),
        (c["c00"] + c["c01"]).alias("s0"), (c["c10"] + c["c11"]).alias("s1"))
    f = per_class.select(
        "*", ratio(2 * F.col("p0") * F.col("r0"), F.col("p0") + F.col("r0")).alias("f0"),
        ratio(2 * F.col("p1") * F.col("r1"), F.col("p1") + F.col("r1")).alias("f1"),
        (F.col("s0") + F.col("s1")).alias("s"))

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), support.alias("support"))

    def macro(m: str) -> Column:
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2

    def weighted(m: str) -> Column:
        return ratio(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), F.col("s"))

    accuracy = ratio(F.col("c00") + F.col("c11"), F.col("s"))
    return f.select(F.inline(F.array(
        line("Weak", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        line("Strong", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        line("accuracy", accuracy, accuracy, accuracy, F.col("s")),
        line("macro avg", macro("p"), macro("r"), macro("f"), F.col("s")),
        line("weighted avg", weighted("p"), weighted("r"), weighted("f"), F.col("s")))))
