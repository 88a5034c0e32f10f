"""Outcome models on MLlib: base learners, calibration, combination, CV, search and persistence.

Labels are -1/0/1 in tables and 0/1/2 inside MLlib.  Every model adds the columns
p_away, p_draw, p_home (or the names asked for) to a table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.fixed_values import CALIB_C, CALIB_HIGH, CALIB_LOW, CALIB_PRIOR_MIX, VOTE_GRID, VOTE_WEIGHTS
from terrace.operators import metrics, splits, sweeps
from terrace.operators.bayes import fit_naive_bayes, select_k_best
from terrace.scale import checkpoint

PROBS = list(metrics.PROBS)


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Ordered feature vector plus the MLlib label and a weight column."""
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    out = va.transform(df.withColumn("label", (F.col("y") + 1).cast("double")))
    return out if "weight" in out.columns else out.withColumn("weight", F.lit(1.0))


def scale(df: DataFrame) -> tuple[DataFrame, Model]:
    model = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(df)
    return model.transform(df), model


def spread_probability(df: DataFrame, names: list[str] = PROBS, vector: str = "probability") -> DataFrame:
    arr = vector_to_array(F.col(vector))
    return df.withColumns({n: arr[i] for i, n in enumerate(names)}).drop(vector, "rawPrediction", "prediction")


@dataclass
class OutcomeModel:
    """A fitted learner that scores a table with an assembled feature vector."""

    stages: list
    features: list[str]
    kind: str

    def score(self, df: DataFrame, names: list[str] = PROBS) -> DataFrame:
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"feature mismatch: the model needs {len(self.features)} columns, missing {missing[:5]}")
        kept = df.columns
        if "y" not in kept:
            df = df.withColumn("y", F.lit(0))
        out = assemble(df, self.features)
        if self.kind == "gbt":
            for i, stage in enumerate(self.stages):
                out = stage.transform(out).withColumn(f"_g{i}", vector_to_array(F.col("probability"))[1])
                out = out.drop("probability", "rawPrediction", "prediction")
            total = F.col("_g0") + F.col("_g1") + F.col("_g2")
            return out.select(*kept, *[(F.col(f"_g{i}") / total).alias(n) for i, n in enumerate(names)])
        for stage in self.stages:
            out = stage.transform(out)
        return spread_probability(out, names).select(*kept, *names)

    def importances(self) -> list[tuple[str, float]]:
        """Mean tree importances by feature name."""
        trees = [s for s in self.stages if hasattr(s, "featureImportances")]
        arrays = [t.featureImportances.toArray() for t in trees]
        return [(f, float(sum(a[i] for a in arrays) / len(arrays))) for i, f in enumerate(self.features)] if arrays else []


def fit_logistic(df: DataFrame, features: list[str], c: float = 0.5, max_iter: int = 100) -> OutcomeModel:
    data, scaler = scale(assemble(df, features))
    lr = LogisticRegression(
        featuresCol="scaled", labelCol="label", weightCol="weight", family="multinomial", maxIter=max_iter, regParam=1.0 / (c * max(df.count(), 1))
    )
    return OutcomeModel([scaler, lr.fit(data)], features, "logistic")


def fit_forest(df: DataFrame, features: list[str], trees: int = 400, depth: int = 10, min_leaf: int = 5, seed: int = 42) -> OutcomeModel:
    rf = RandomForestClassifier(
        labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed
    )
    return OutcomeModel([rf.fit(assemble(df, features))], features, "forest")


def fit_boosted(df: DataFrame, features: list[str], rounds: int = 300, depth: int = 4, step: float = 0.05, seed: int = 42) -> OutcomeModel:
    """One boosted model per class against the rest; shares are normalised."""
    data = assemble(df, features)
    stages = []
    for cls in range(3):
        one = data.withColumn("label", F.when(F.col("label") == cls, 1.0).otherwise(0.0))
        gbt = GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=20, seed=seed)
        stages.append(gbt.fit(one))
    return OutcomeModel(stages, features, "gbt")


FITTERS = {"logistic": fit_logistic, "forest": fit_forest, "gbt": fit_boosted}


def with_class_weight(df: DataFrame, recency: str | None = None) -> DataFrame:
    return splits.class_weight(df, "y", recency).withColumnRenamed("sample_weight", "weight")


def normalise(df: DataFrame, names: list[str] = PROBS) -> DataFrame:
    total = F.col(names[0]) + F.col(names[1]) + F.col(names[2])
    return df.withColumns({n: F.when(total > 0, F.col(n) / total).otherwise(1.0 / 3) for n in names})


# --- out-of-fold scores, isotonic calibration, combination -------------------


def hash_fold(key: str, folds: int):
    return F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")


def out_of_fold(df: DataFrame, features: list[str], kind: str, folds: int = 3, key: str = "match_id", **params) -> DataFrame:
    """Scores of each row from a model that did not see it; folds are hashes of the key."""
    tagged = checkpoint(df.withColumn("_fold", hash_fold(key, folds)))
    parts = []
    for k in range(folds):
        model = FITTERS[kind](tagged.filter(F.col("_fold") != k), features, **params)
        parts.append(model.score(tagged.filter(F.col("_fold") == k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_fold")


@dataclass
class IsotonicCalibrator:
    models: list

    def transform(self, df: DataFrame, names: list[str] = PROBS) -> DataFrame:
        for i, (n, m) in enumerate(zip(names, self.models)):
            df = m.setFeaturesCol(n).setPredictionCol(f"_c{i}").transform(df)
        df = df.drop(*names).withColumnsRenamed({f"_c{i}": n for i, n in enumerate(names)})
        return normalise(df, names)


def fit_isotonic(scored: DataFrame, names: list[str] = PROBS) -> IsotonicCalibrator:
    """One monotone map per class over out-of-fold scores.

    Rows of equal scores are summed first, so the fit sees one weighted point per
    distinct score.
    """
    models = []
    for cls, n in zip(metrics.CLASSES, names):
        hit = F.when(F.col("y") == cls, 1.0).otherwise(0.0)
        points = scored.groupBy(n).agg(F.avg(hit).alias("hit"), F.count("*").cast("double").alias("w"))
        models.append(IsotonicRegression(featuresCol=n, labelCol="hit", weightCol="w").fit(points))
    return IsotonicCalibrator(models)


def soft_vote(df: DataFrame, members: list[list[str]], weights=VOTE_WEIGHTS, names: list[str] = PROBS) -> DataFrame:
    """Weighted mean of several probability triples."""
    total = float(sum(weights))
    cols = {}
    for i, n in enumerate(names):
        acc = F.col(members[0][i]) * float(weights[0])
        for w, m in zip(weights[1:], members[1:]):
            acc = acc + F.col(m[i]) * float(w)
        cols[n] = acc / total
    return df.withColumns(cols)


def member_scores(df: DataFrame, models: dict[str, OutcomeModel]) -> tuple[DataFrame, list[list[str]]]:
    """Score a table with several models, one column triple each."""
    names = []
    for tag, m in models.items():
        cols = [f"{tag}_{n}" for n in PROBS]
        df = m.score(df, cols)
        names.append(cols)
    return df, names


def fit_stack(df: DataFrame, members: list[list[str]], max_iter: int = 50) -> OutcomeModel:
    """A logistic meta-learner over out-of-fold member probabilities."""
    return fit_logistic(df, [c for m in members for c in m], max_iter=max_iter)


def legacy_mix(train: DataFrame, df: DataFrame, features: list[str], max_iter: int = 50) -> DataFrame:
    """Mean of naive Bayes and softmax probabilities."""
    nb = fit_naive_bayes(train, features)
    nb_cols, lr_cols = [f"nb_{n}" for n in PROBS], [f"lr_{n}" for n in PROBS]
    both = fit_logistic(train, features, max_iter=max_iter).score(nb.transform(df, nb_cols), lr_cols)
    return soft_vote(both, [nb_cols, lr_cols], (0.5, 0.5)).drop(*nb_cols, *lr_cols)


# --- Dirichlet calibration ----------------------------------------------------


@dataclass
class DirichletCalibrator:
    model: OutcomeModel
    prior: list[float]
    mix: float
    c: float

    def transform(self, df: DataFrame) -> DataFrame:
        raw = [f"_r{i}" for i in range(3)]
        out = self.model.score(log_space(df), raw)
        cols = {n: (1.0 - self.mix) * F.col(r) + self.mix * p for n, r, p in zip(PROBS, raw, self.prior)}
        return normalise(out.drop(*LOGS).withColumns(cols).drop(*raw))


LOGS = ["_l0", "_l1", "_l2"]


def log_space(df: DataFrame) -> DataFrame:
    clip = lambda n: F.ln(F.least(F.greatest(F.col(n), F.lit(CALIB_LOW)), F.lit(CALIB_HIGH)))
    return df.withColumns({log: clip(n) for log, n in zip(LOGS, PROBS)})


def class_prior(df: DataFrame) -> list[float]:
    counts = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    return [counts.get(c, 0) / total for c in metrics.CLASSES]


def fit_dirichlet(scored: DataFrame, order: list[str], grid_c=CALIB_C, grid_mix=CALIB_PRIOR_MIX, max_iter: int = 50) -> DirichletCalibrator:
    """Multinomial logistic on clipped log-probabilities.

    Strength and prior mix are chosen by log-loss on the later 30 percent; every mix
    of one strength is scored in a single pass.
    """
    held = splits.holdout_split(log_space(scored), order, 0.3)
    held = checkpoint(held.withColumn("inner", F.col("role") != "train").drop("role", "row_no"))
    fit_rows, val = held.filter("not inner"), held.filter("inner")
    prior = class_prior(fit_rows)
    best = None
    for c in grid_c:
        model = fit_logistic(fit_rows, LOGS, c=c, max_iter=max_iter)
        raw = [f"_r{i}" for i in range(3)]
        s = model.score(val, raw)
        losses = []
        for w in grid_mix:
            mixed = [(1.0 - w) * F.col(r) + w * p for r, p in zip(raw, prior)]
            losses.append(F.avg(metrics.log_loss(F.col("y"), mixed)))
        row = s.agg(*[x.alias(f"w{i}") for i, x in enumerate(losses)]).first()
        for i, w in enumerate(grid_mix):
            if best is None or row[f"w{i}"] < best[0]:
                best = (row[f"w{i}"], c, w)
    _, c, w = best
    return DirichletCalibrator(fit_logistic(held, LOGS, c=c, max_iter=max_iter), class_prior(held), w, c)


# --- CV, search, honest holdout ----------------------------------------------


@dataclass
class CvReport:
    folds: list[dict] = field(default_factory=list)

    def mean(self, name: str) -> float:
        vals = [f[name] for f in self.folds]
        return sum(vals) / len(vals) if vals else float("nan")


def purged_cv(df: DataFrame, features: list[str], kind: str, order: list[str], n_folds: int = 5, gap: int = 0, burn_in: int = 0, **params) -> CvReport:
    """Expanding folds with a purge gap; the first ``burn_in`` folds train nothing that is reported."""
    tagged = checkpoint(splits.purged_folds(df, order, n_folds, gap))
    report = CvReport()
    for k in range(burn_in + 1, n_folds + 1):
        train = with_class_weight(tagged.filter(F.col("train_from") <= k))
        scored = FITTERS[kind](train, features, **params).score(tagged.filter(F.col("test_fold") == k))
        row = metrics.summary(scored, F.col("y"), metrics.argmax_class(), digits=6).first()
        if row is not None and row["n"]:
            report.folds.append({"fold": k, **row.asDict()})
    return report


def greedy_search(df: DataFrame, features: list[str], order: list[str], grids: dict[str, list[dict]], n_folds: int = 3, gap: int = 0) -> dict[str, dict]:
    """Best parameters per learner by macro-F1 minus twice RPS."""
    best: dict[str, dict] = {}
    for kind, grid in grids.items():
        top = None
        for params in grid:
            r = purged_cv(df, features, kind, order, n_folds, gap, **params)
            score = r.mean("macro_f1") - 2.0 * r.mean("rps")
            if top is None or score > top[0]:
                top = (score, params)
        best[kind] = {"score": top[0], "params": top[1]}
    return best


def choose_vote(df: DataFrame, members: list[list[str]], grid=VOTE_GRID) -> tuple[float, ...]:
    """The weight triple with the best macro-F1 minus twice RPS, all scored in one pass each."""
    best = None
    for w in grid:
        row = metrics.summary(soft_vote(df, members, w), F.col("y"), metrics.argmax_class(), digits=6).first()
        score = row["macro_f1"] - 2.0 * row["rps"]
        if best is None or score > best[0]:
            best = (score, w)
    return best[1]


def choose_blend(calibration: DataFrame, second: list[str], weights=sweeps.BLEND_WEIGHTS) -> float:
    """The blend weight with the lowest RPS on the calibration slice (never on the test slice)."""
    row = sweeps.blend_grid(calibration, tuple(PROBS), tuple(second), weights=weights).orderBy("rps", "weight").first()
    return float(row["weight"])


def apply_blend(df: DataFrame, weight: float, second: list[str]) -> DataFrame:
    return df.withColumns(dict(zip(PROBS, sweeps.blend(weight, tuple(PROBS), tuple(second)))))


def honest_holdout(
    df: DataFrame, features: list[str], order: list[str], kind: str = "logistic", second: list[str] | None = None, fraction: float = 0.2, **params
) -> tuple[DataFrame, dict]:
    """Fit before the holdout, calibrate on its first half, score its second half.

    Returns the calibrated test predictions and the choices made.
    """
    tagged = checkpoint(splits.holdout_split(df, order, fraction))
    train = with_class_weight(tagged.filter("role = 'train'"))
    model = FITTERS[kind](train, features, **params)
    cal, test = (model.score(tagged.filter(F.col("role") == r)) for r in ("calibrate", "test"))
    weight = choose_blend(cal, second) if second else 0.0
    if second:
        cal, test = apply_blend(cal, weight, second), apply_blend(test, weight, second)
    calibrator = fit_dirichlet(cal, order)
    return calibrator.transform(test), {"blend": weight, "c": calibrator.c, "mix": calibrator.mix}


def select_features(df: DataFrame, features: list[str], k: int | None) -> list[str]:
    return select_k_best(df, features, k)


def combinations(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, vals)) for vals in product(*grid.values())]


# --- persistence ---------------------------------------------------------------


def save_model(model: OutcomeModel, path: str, extra: dict | None = None) -> None:
    """MLlib stages plus one metadata row."""
    from pyspark.sql import Row

    PipelineModel(model.stages).write().overwrite().save(f"{path}/stages")
    meta = {"features": model.features, "kind": model.kind, **(extra or {})}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([Row(meta=json.dumps(meta))]).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str, expected: list[str] | None = None) -> OutcomeModel:
    """Load a saved model; a different feature list fails loudly."""
    meta = json.loads(spark.read.parquet(f"{path}/metadata").first()["meta"])
    if expected is not None and list(expected) != list(meta["features"]):
        raise ValueError(f"feature count mismatch: got {len(expected)} features but the model expects {len(meta['features'])}")
    return OutcomeModel(list(PipelineModel.load(f"{path}/stages").stages), meta["features"], meta["kind"])
