"""Classifiers on Spark ML: group filter, candidate filter, keep/flip of a contested start."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import AtomicType

from codonlake import constants as C
from codonlake.functions.sequence import kmer_words, ratio
from codonlake.operators.orf import GROUP
from codonlake.operators.starts import settle_contest, top_two
from codonlake.operators.sweeps import threshold_sweep
from codonlake.session import cut_lineage

FLIP_THRESHOLDS = [0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90]


def add_class_weight(rows: DataFrame, label: str = "label") -> DataFrame:
    """Weight n_negative / n_positive for positives, 1 for negatives. No positives is an error."""
    c = rows.agg(F.sum(label).alias("p"), F.count("*").alias("n")).first()
    if not c["p"]:
        raise ValueError("the training set has no positive examples")
    scale = (c["n"] - c["p"]) / c["p"]
    return rows.withColumn("class_weight", F.when(F.col(label) == 1, F.lit(float(scale))).otherwise(1.0))


def _prepare(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    missing = [f for f in features if f not in rows.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    keep = [c for c in rows.columns if c not in features]
    return rows.select(*keep, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])


def in_fixed_order(rows: DataFrame) -> DataFrame:
    """Rows dealt by their key, where they have one, and sorted by what they hold. Fits draw rows by partition and place, and the order in
    which files are listed or shuffled rows arrive is another in each run."""
    plain = [f.name for f in rows.schema.fields if isinstance(f.dataType, AtomicType)]
    named = [c for c in (*GROUP, "start") if c in plain]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *(named or plain)).sortWithinPartitions(*dict.fromkeys(named + plain))


def boosted_trees(label: str = "label", weighted: bool = True, validation: str | None = None, **params) -> GBTClassifier:
    settings = {"maxIter": 40, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42, **params}
    clf = GBTClassifier(labelCol=label, featuresCol="features", **settings)
    if weighted:
        clf = clf.setWeightCol("class_weight")
    return clf.setValidationIndicatorCol(validation) if validation else clf


def train_classifier(rows: DataFrame, features: list[str], label: str = "label", validation: str | None = None,
                     scale: bool = False, estimator=None, **params) -> PipelineModel:
    """Assembler, optional scaler, boosted trees (or another estimator), with class weights.

    With ``validation`` (a boolean column) boosting stops when the held-out loss no longer falls.
    """
    data = add_class_weight(in_fixed_order(_prepare(rows, features, label)), label)
    raw = "raw_features" if scale else "features"
    stages = [VectorAssembler(inputCols=features, outputCol=raw)]
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol="features", withMean=True))
    stages.append(estimator or boosted_trees(label, True, validation, **params))
    return Pipeline(stages=stages).fit(data)


def train_sequence_classifier(rows: DataFrame, features: list[str], label: str = "label", sequence: str = "sequence",
                              k: int = 3, buckets: int = 128, layers: tuple[int, ...] = (32,), network: bool = False,
                              **params) -> PipelineModel:
    """Candidate classifier on the tabular features and hashed k-mers of the whole sequence."""
    data = with_kmers(add_class_weight(in_fixed_order(_prepare(rows, features, label)), label), sequence, k)
    stages = [HashingTF(inputCol="kmers", outputCol="kmer_vector", numFeatures=buckets),
              VectorAssembler(inputCols=[*features, "kmer_vector"], outputCol="joined")]
    if network:
        stages.append(StandardScaler(inputCol="joined", outputCol="features"))
        stages.append(MultilayerPerceptronClassifier(labelCol=label, featuresCol="features", seed=42, maxIter=60,
                                                     layers=[len(features) + buckets, *layers, 2]))
    else:
        stages[-1] = VectorAssembler(inputCols=[*features, "kmer_vector"], outputCol="features")
        stages.append(boosted_trees(label, True, **params))
    return Pipeline(stages=stages).fit(data)


def with_kmers(rows: DataFrame, sequence: str = "sequence", k: int = 3) -> DataFrame:
    return rows.withColumn("kmers", kmer_words(F.col(sequence), k))


def model_features(model: PipelineModel) -> list[str]:
    """Tabular columns that a stored model needs."""
    made = {s.getOutputCol() for s in model.stages if s.hasParam("outputCol")}
    cols: list[str] = []
    for s in model.stages:
        if isinstance(s, VectorAssembler):
            cols += [c for c in s.getInputCols() if c not in made]
    return cols


def score_table(model: Transformer, rows: DataFrame, out: str = "prob") -> DataFrame:
    """Probability of class 1. Missing feature columns are named in the error."""
    data = _prepare(rows, model_features(model), out)
    scored = model.transform(data)
    prob = vector_to_array("probability")[1]
    extra = [c for c in scored.columns if c in rows.columns]
    return scored.select(*extra, prob.alias(out))


# ---- stages of the prediction job ------------------------------------------------------------------
def keep_groups(rows: DataFrame, group_scores: DataFrame, threshold: float = C.GROUP_FILTER_PROB,
                prob: str = "prob") -> DataFrame:
    """ORFs of groups whose probability reaches the threshold."""
    return rows.join(group_scores.where(F.col(prob) >= threshold).select(*GROUP), GROUP, "left_semi")


def keep_candidates(scored: DataFrame, threshold: float = C.FINAL_FILTER_PROB, prob: str = "prob") -> DataFrame:
    return scored.where(F.col(prob) >= threshold).withColumnRenamed(prob, "hybrid_prob")


def choose_starts(rows: DataFrame, pair_scores: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """Best start per group; the classifier may flip contested groups. ``pair_scores``: GROUP + prob_keep."""
    pairs = top_two(rows, weights).join(pair_scores.select(*GROUP, "prob_keep"), GROUP, "left")
    chosen = settle_contest(pairs, **options).select(*GROUP, F.col("chosen_start").alias("start"))
    return rows.join(chosen, [*GROUP, "start"], "left_semi")


def pair_labels(pairs: DataFrame, reference_starts: DataFrame) -> DataFrame:
    """label 1 where the first contestant is the true start, 0 where the second is; other pairs are left out."""
    p = pairs.join(reference_starts.select(*GROUP, "true_start"), GROUP)
    return p.where((F.col("true_start") == F.col("start_1")) | (F.col("true_start") == F.col("start_2"))).withColumn(
        "label", (F.col("true_start") == F.col("start_1")).cast("int")).drop("true_start")


def top_choice_report(scored: DataFrame, prob: str = "prob", gap: float = 0.05,
                      thresholds: tuple[float, ...] = (0.01, 0.05, 0.10, 0.20, 0.30, 0.50)) -> DataFrame:
    """Group-level quality of the top candidate, and of taking the second where the gap is small."""
    order = Window.partitionBy(*GROUP).orderBy(F.col(prob).desc(), "start")
    rows = scored.withColumn("_r", F.row_number().over(order))
    at = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    per = rows.groupBy(*GROUP).agg(
        F.max("label").alias("true"), at(1, prob).alias("p1"), at(2, prob).alias("p2"), at(1, "label").alias("l1"),
        at(2, "label").alias("l2"))
    fall = F.when((F.col("p1") - F.col("p2") < gap), F.col("l2")).otherwise(F.col("l1"))
    n = F.count("*")
    agg = per.agg(
        n.alias("groups"), F.sum("true").alias("true_groups"), F.sum("l1").alias("_hit"), F.sum(fall).alias("_fall"),
        *[(F.count_if(F.col("p1") >= t) / n).alias(f"share_{t:g}".replace(".", "_")) for t in thresholds])
    d = lambda c: F.col(c).cast("double")
    return agg.select(
        "groups", "true_groups", ratio(d("_hit"), F.col("true_groups")).alias("recall"),
        ratio(d("_hit"), F.col("groups")).alias("precision"), ratio(d("_fall"), F.col("true_groups")).alias("fallback_recall"),
        ratio(d("_fall"), F.col("groups")).alias("fallback_precision"), *[c for c in agg.columns if c.startswith("share_")])


# ---- studies ---------------------------------------------------------------------------------------
def auc(scored: DataFrame, prob: str = "prob", label: str = "label") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=prob, labelCol=label).evaluate(scored)


def leave_one_group_out(rows: DataFrame, features: list[str], group: str = "tax_group", label: str = "label",
                        flips: list[float] = FLIP_THRESHOLDS, **params) -> DataFrame:
    """One model per left-out taxonomic group: AUROC and keep/flip accuracy at every flip threshold.

    The loop is over taxonomic groups (a handful of names); each fold is a distributed fit.
    """
    names = [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]
    out = None
    for name in names:
        train, test = rows.where(F.col(group) != name), rows.where(F.col(group) == name)
        kinds = train.agg(F.sum(label), F.count("*")).first()
        if not kinds[0]:
            continue
        scored = score_table(train_classifier(train, features, label, scale=True, **params), test)
        both = scored.agg(F.min(label), F.max(label)).first()
        value = auc(scored, label=label) if both[0] != both[1] else None
        keep = scored.select(label, "prob", F.explode(F.array(*map(F.lit, flips))).alias("flip"))
        right = (F.col("prob") >= 1 - F.col("flip")) == (F.col(label) == 1)
        part = keep.groupBy("flip").agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"))
        part = part.select(F.lit(name).alias("left_out"), F.lit(value).cast("double").alias("auroc"), "flip", "n", "accuracy")
        out = part if out is None else out.unionByName(part)
    return out


def grid_search(rows: DataFrame, features: list[str], grid: list[dict], group: str = "tax_group", label: str = "label",
                flips: list[float] = FLIP_THRESHOLDS, at_once: int = 4) -> DataFrame:
    """One row per parameter set: accuracy at its best flip threshold over all left-out groups, best first by ``place``.

    The rows are assembled and stored once in a fixed order, which a checkpoint keeps, and all fits read them. Fits are independent jobs, ``at_once`` of which run at
    a time. All models are judged together by one aggregation. Equal accuracies are placed in the order of the grid.
    """
    ordered = in_fixed_order(_prepare(rows, features, label).select(*dict.fromkeys([c for c in (*GROUP, "start") if c in rows.columns] + [group, label, *features])))
    data = cut_lineage(VectorAssembler(inputCols=features, outputCol="raw_features").transform(ordered).select(group, label, "raw_features"))
    counts = {r[group]: (r["p"], r["n"]) for r in data.groupBy(group).agg(F.sum(label).alias("p"), F.count("*").alias("n")).collect()}
    names = sorted(g for g in counts if sum(p for k, (p, _) in counts.items() if k != g))  # groups whose complement has positives
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)

    def fit(task: tuple[int, str]) -> DataFrame:
        number, name = task
        train = add_class_weight(data.where(F.col(group) != name), label)
        model = Pipeline(stages=[scaler, boosted_trees(label, **grid[number])]).fit(train)
        scored = model.transform(data.where(F.col(group) == name))
        return scored.select(F.lit(number).alias("setting"), F.col(label).alias("label"), vector_to_array("probability")[1].alias("prob"))

    tasks = [(number, name) for number in range(len(grid)) for name in names]
    with ThreadPoolExecutor(at_once) as pool:
        parts = list(pool.map(inheritable_thread_target(fit), tasks))
    if not parts:
        return data.sparkSession.createDataFrame([], "setting int, parameters string, place int, flip double, rows long, accuracy double")
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    right = lambda t: (F.col("prob") >= 1 - t) == (F.col("label") == 1)
    per = scored.groupBy("setting").agg(F.count("*").alias("rows"), F.array(*[
        F.struct(F.avg(right(t).cast("double")).alias("accuracy"), F.lit(-t).alias("back")) for t in flips]).alias("tries"))
    best = per.withColumn("best", F.array_max("tries"))
    named = F.element_at(F.array(*[F.lit(", ".join(f"{k}={v}" for k, v in sorted(p.items()))) for p in grid]), F.col("setting") + 1)
    place = F.row_number().over(Window.orderBy(F.col("best.accuracy").desc(), "setting"))  # one row per parameter set
    return best.select("setting", named.alias("parameters"), place.alias("place"), (-F.col("best.back")).alias("flip"), "rows", F.col("best.accuracy").alias("accuracy"))


def compare_models(train: DataFrame, test: DataFrame, features: list[str], label: str = "label") -> list[tuple[str, float]]:
    """AUROC of logistic regression, random forest and boosted trees on the same split."""
    choices = {
        "logistic_regression": LogisticRegression(labelCol=label, weightCol="class_weight", maxIter=50),
        "random_forest": RandomForestClassifier(labelCol=label, weightCol="class_weight", numTrees=50, seed=42),
        "boosted_trees": boosted_trees(label, maxIter=20),
    }
    return [(name, auc(score_table(train_classifier(train, features, label, scale=True, estimator=e), test), label=label))
            for name, e in choices.items()]


def feature_importance(model: PipelineModel, top: int = 10) -> list[tuple[str, float]]:
    names = model_features(model)
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, map(float, values[: len(names)])), key=lambda x: -x[1])[:top]


def isotonic(scored: DataFrame, prob: str = "prob", label: str = "label") -> PipelineModel:
    """Monotone map from probability to calibrated probability."""
    stages = [VectorAssembler(inputCols=[prob], outputCol="_p"),
              IsotonicRegression(featuresCol="_p", labelCol=label, predictionCol="calibrated")]
    return Pipeline(stages=stages).fit(scored)


def sweep_two_models(scored: DataFrame, old: str, new: str, label: str, thresholds: list[float]) -> DataFrame:
    a = threshold_sweep(scored, old, label, thresholds).withColumn("model", F.lit("old"))
    return a.unionByName(threshold_sweep(scored, new, label, thresholds).withColumn("model", F.lit("new")))
