"""Model training, selection and scoring on MLlib."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.quantiles import exact_quantiles
from demandloom.functions.semantics import past, ratio, rnd, series
from demandloom.functions.vocabulary import HORIZONS, SYNTHETIC, UCI, WEEKLY_LAGS, WEEKLY_SPANS, WEEKLY_WINDOWS
from demandloom.operators import metrics
from demandloom.operators.features import GRAIN
from demandloom.operators.scenarios import MEMORY, TERMS, State, before, days, last_values, numbers, terms
from demandloom.operators.trees import Boosted, first_trees, nonnegative_sum
from demandloom.session import side_by_side, stored

SEED = 42
TREES = 150  # trees of a forest and iterations of a boosted model, unless a caller asks for fewer
WEEKLY_NUMERIC = (
    *[f"lag_{k}" for k in WEEKLY_LAGS], *[f"rolling_{s}_{w}" for w in WEEKLY_WINDOWS for s in ("mean", "std", "min", "max")], *[f"ewm_{s}" for s in WEEKLY_SPANS],
    "price_lag1", "promo_lag1", "week_of_year", "month", "quarter", "year", "sin_week", "cos_week", "sin_month", "cos_month",
)
HOLIDAY_NUMERIC = ("is_holiday_week", "holiday_count", "weeks_to_next_holiday", "weeks_since_last_holiday", "holiday_x_promo")
WEEKLY_CATEGORICAL = ("season", "category", "sub_category", "brand")


def chronological(df: DataFrame, order: str = "week") -> DataFrame:
    """80/10/10 split by time of each source, rows without history dropped."""
    span = df.groupBy("source_dataset").agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    days = F.date_diff("hi", "lo")
    rows = df.join(F.broadcast(span), "source_dataset")
    split = (
        F.when(F.date_diff(order, "lo") < F.floor(days * 0.8), "train")
        .when(F.date_diff(order, "lo") < F.floor(days * 0.9), "validation").otherwise("test")
    )
    return rows.withColumn("split", split).drop("lo", "hi").where(F.col("lag_1").isNotNull())


class FeaturePreparer(Estimator):
    """What features need to know of the training rows: medians, columns with gaps, shares of the levels of a category."""

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str] = ()):
        super().__init__()
        self.numeric, self.categorical = list(numeric), list(categorical)

    def _fit(self, dataset: DataFrame) -> PreparedFeatures:
        found = dataset.approxQuantile(self.numeric, [0.5], 0.001)
        gaps = dataset.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in self.numeric], F.count("*").alias("_rows")).first()
        shares = {}
        if self.categorical:
            long = dataset.select(*[F.col(c).cast("string").alias(c) for c in self.categorical]).unpivot([], self.categorical, "_column", "_level")
            levels = stored(long.where(F.col("_level").isNotNull()).groupBy("_column", "_level").agg((F.count("*") / gaps["_rows"]).alias("_freq")), "levels")
            shares = {c: levels.where(F.col("_column") == c).select(F.col("_level").alias(f"_{c}_level"), F.col("_freq").alias(f"{c}_freq")) for c in self.categorical}
        return PreparedFeatures(self.numeric, {c: (m[0] if m else 0.0) for c, m in zip(self.numeric, found)}, [c for c in self.numeric if gaps[c]], shares)


class PreparedFeatures(Model):
    """Medians in the gaps, a mark for each gap, and for a category the share of the training rows with its level (0: unseen or none)."""

    def __init__(self, numeric: list[str], medians: dict[str, float], gaps: list[str], shares: dict[str, DataFrame]):
        super().__init__()
        self.numeric, self.medians, self.gaps, self.shares = numeric, medians, gaps, shares
        self.names = [*numeric, *[f"{c}_missing" for c in gaps], *[f"{c}_freq" for c in shares]]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = dataset.columns
        rows = dataset.withColumns({f"_{n}": F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for n, c in enumerate(self.numeric)})
        rows = rows.withColumns({f"_gap_{c}": F.col(c).isNull().cast("double") for c in self.gaps})
        for c, share in self.shares.items():
            rows = rows.join(share.withColumnRenamed(f"{c}_freq", f"_share_{c}"), F.col(c).cast("string") == F.col(f"_{c}_level"), "left")
        rows = rows.withColumns({f"_share_{c}": F.coalesce(f"_share_{c}", F.lit(0.0)) for c in self.shares})
        inputs = [*[f"_{n}" for n in range(len(self.numeric))], *[f"_gap_{c}" for c in self.gaps], *[f"_share_{c}" for c in self.shares]]
        return VectorAssembler(inputCols=inputs, outputCol="features").transform(rows).select(*own, "features")


def with_indicators(df: DataFrame, numeric: Sequence[str], target: str = "units_sold") -> DataFrame:
    cast = {c: F.col(c).cast("double") for c in numeric}
    missing = {f"{c}_missing": F.col(c).isNull().cast("double") for c in numeric}
    return df.withColumns({**missing, **cast, "label": F.col(target).cast("double")})


def boosted(trees: int = TREES, depth: int = 5, step: float = 0.1) -> GBTRegressor:
    return GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8, seed=SEED)


def candidates(trees: int = TREES, depth: int = 6) -> dict:
    args = {"featuresCol": "features", "labelCol": "label"}
    return {
        "random_forest": RandomForestRegressor(numTrees=max(1, trees // 3), maxDepth=2 * depth, minInstancesPerNode=8, featureSubsetStrategy="sqrt", seed=SEED, **args),
        "gradient_boosting": boosted(trees, depth),
        "linear": LinearRegression(regParam=0.1, **args),
        "poisson": GeneralizedLinearRegression(family="poisson", link="log", regParam=1.0, maxIter=25, **args),
    }


def nonnegative(c: str = "prediction") -> Column:
    """Finite predictions floored at zero."""
    v = F.col(c).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), 0.0).otherwise(F.greatest(F.lit(0.0), v))


def fit(rows: DataFrame, numeric: Sequence[str], estimator, categorical: Sequence[str] = ()) -> PipelineModel:
    return Pipeline(stages=[FeaturePreparer(numeric, categorical), estimator]).fit(rows)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows).withColumn("prediction", nonnegative())
    return out.drop("features", "rawPrediction", "probability")


def fit_all(train: DataFrame, prepared: PreparedFeatures, estimators: Sequence[Estimator]) -> list[Model]:
    """Models of the same training rows: features are made once, laid on disk and read by all fits, which run side by side."""
    ready = prepared.transform(train).select("label", "features").persist(StorageLevel.DISK_ONLY)
    try:
        return side_by_side(train.sparkSession, [partial(e.fit, ready) for e in estimators])
    finally:
        ready.unpersist()


def score_all(prepared: PreparedFeatures, models: Mapping, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A row for each row and model (``_model``: its key) with the prediction, from one pass over the rows."""
    rows = prepared.transform(rows).select(*keep, "features")
    for k, model in enumerate(models.values()):
        rows = model.copy().setPredictionCol(f"_p{k}").transform(rows)
    each = F.array(*[F.struct(F.lit(key).alias("_model"), nonnegative(f"_p{k}").alias("prediction")) for k, key in enumerate(models)])
    return rows.select(*keep, F.inline(each))


def train_and_compare(rows: DataFrame, numeric: Sequence[str], models: Mapping | None = None, categorical: Sequence[str] = ()) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Accuracy of every candidate on validation and test, ranked by validation."""
    rows = stored(with_indicators(rows, numeric), "training")
    train, models = rows.where("split = 'train'"), models or candidates()
    prepared = FeaturePreparer(numeric, categorical).fit(train)
    found = dict(zip(models, fit_all(train, prepared, list(models.values())), strict=True))
    scored = score_all(prepared, found, rows.where("split <> 'train'"), ["source_dataset", "split", "label"]).withColumnRenamed("_model", "model")
    table = metrics.accuracy(scored, ["source_dataset", "split", "model"], "label", "prediction")
    order = Window.partitionBy("source_dataset", "split").orderBy("wape", "mae", "rmse", "smape", "model")
    return table.withColumn("rank", F.row_number().over(order)), {name: PipelineModel([prepared, model]) for name, model in found.items()}


def native_importance(model: PipelineModel, rows: DataFrame) -> DataFrame:
    values = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    table = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(v).alias("importance")) for n, v in zip(model.stages[0].names, values, strict=True)])
    return rows.sparkSession.range(1).select(F.inline(table))


def shuffled(rows: DataFrame, column: str, keys: Sequence[str], seed: int, buckets: int) -> DataFrame:
    """The column moved to another random row.

    Rows get a random bucket and place from a hash of their key, and take the
    value of the row before them in the bucket (the first takes the last one's):
    a random permutation made in many small windows, the same on every re-run.
    """
    draw = F.xxhash64(*keys, F.lit(seed))
    placed = rows.withColumns({"_b": F.pmod(draw, F.lit(buckets)), "_o": F.xxhash64(draw)})
    w = Window.partitionBy("_b").orderBy("_o")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(w) == 1
    moved = F.when(first, F.last(column).over(whole)).otherwise(F.lag(column).over(w))
    return placed.withColumn(column, moved).drop("_b", "_o")


def _rises(model: Boosted, inputs_of: Mapping[str, Sequence[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function of batches (label, inputs, inputs with every feature moved) that returns each feature's sum of errors when it alone has moved.

    A tree that does not know the feature says what it said; feature '' is the error with none moved.
    """
    def rises(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label = numbers(batch["label"])
            there = ~np.isnan(label)
            inputs, moved = (np.ascontiguousarray(numbers(batch[c].flatten()).reshape(batch.num_rows, -1).T) for c in ("_inputs", "_moved_inputs"))
            error = lambda parts: float(np.abs(label - nonnegative_sum(parts))[there].sum())
            parts = model.parts(inputs)
            found = {"": error(parts)}
            for feature, own in inputs_of.items():
                held = inputs[own]
                inputs[own] = moved[own]
                found[feature] = error(model.changed(inputs, parts, own))
                inputs[own] = held
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values())), pa.array([int(there.sum())] * len(found), pa.int64())], ["feature", "total", "n"])

    return rises


def permutation_importance(model: PipelineModel, rows: DataFrame, keys: Sequence[str], repeats: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """Mean rise of the absolute error when a feature is shuffled.

    A repeat shuffles all features together; where a row then lies, the model as arrays scores it once for each feature, with only that
    one moved, and only by the trees that know the feature.
    """
    rows = stored(rows, "permutation")
    prepared = model.stages[0]
    features = [*prepared.numeric, *prepared.shares]
    inputs_of = {c: [n for n, name in enumerate(prepared.names) if name in ((f"{c}_freq",) if c in prepared.shares else (c, f"{c}_missing"))] for c in features}
    buckets = max(1, rows.count() // bucket_rows)
    parts = None
    for k in range(repeats):
        part = shuffled(rows.withColumn("_moved", F.struct(*features)), "_moved", keys, SEED + k, buckets)
        parts = part if parts is None else parts.unionByName(part)
    own = prepared.transform(parts).withColumn("_inputs", vector_to_array("features")).drop("features", *features)
    both = prepared.transform(own.select("*", "_moved.*").drop("_moved")).select("label", "_inputs", vector_to_array("features").alias("_moved_inputs"))
    found = both.mapInArrow(_rises(Boosted.of(model.stages[-1]), inputs_of), "feature string, total double, n long")
    error = stored(found.groupBy("feature").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("m")), "errors")
    base = error.where("feature = ''").select(F.col("m").alias("_base"))
    return error.where("feature <> ''").crossJoin(F.broadcast(base)).select("feature", rnd(F.col("m") - F.col("_base"), 6).alias("mae_increase"), F.lit(repeats).cast("long").alias("repeats"))


def hurdle(rows: DataFrame, numeric: Sequence[str], thresholds: Sequence[float] = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8), trees: int = TREES) -> DataFrame:
    """Demand classifier times positive-demand regressor; threshold by validation WAPE.

    All thresholds of both periods are measured in one aggregate.
    """
    rows = stored(with_indicators(rows, numeric), "training")
    train = rows.where("split = 'train'")
    positive = train.withColumn("label", (F.col("label") > 0).cast("double"))
    clf, reg = side_by_side(rows.sparkSession, [
        partial(fit, positive, numeric, GBTClassifier(maxIter=trees, maxDepth=5, subsamplingRate=0.8, seed=SEED)),
        partial(fit, train.where("label > 0"), numeric, boosted(trees))])
    keys = ["source_dataset", "entity_id", "product_key", "date"]
    # both models score a row where it lies
    held = score(reg, rows.where("split <> 'train'").na.drop(subset=keys)).withColumnRenamed("prediction", "q")
    both = clf.transform(held).select("split", "label", "q", vector_to_array("probability")[1].alias("p"))
    pairs = both.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    pairs = pairs.withColumn("prediction", F.when(F.col("p") < F.col("threshold"), 0.0).otherwise(F.col("q")))
    table = metrics.finite(pairs, "label", "prediction").groupBy("split", "threshold").agg(
        *metrics.accuracy_columns("label", "prediction"), *metrics.zero_slice_columns("label", "prediction"))
    best = table.where("split = 'validation'").agg(F.min_by("threshold", F.struct("wape", "threshold")).alias("b")).select("b").scalar()
    return table.withColumn("selected", F.col("threshold") == best)


def direct_horizons(panel: DataFrame, numeric: Sequence[str], horizons: Sequence[int], trees: int = TREES) -> DataFrame:
    """One model per source and horizon on its own leakage-safe panel; test accuracy.

    A source without a complete training row at a horizon has no model there.
    """
    out = None
    panel = stored(panel, "direct")
    complete = panel.where(F.col("role") == "train").where(" AND ".join(f"{c} IS NOT NULL" for c in numeric))
    able = sorted((r.horizon, r.source_dataset) for r in complete.select("horizon", "source_dataset").distinct().collect() if r.horizon in horizons)

    def at(h: int, source: str) -> DataFrame:
        rows = with_indicators(panel.where((F.col("horizon") == h) & (F.col("source_dataset") == source)), numeric, "target")
        model = fit(rows.where("role = 'train'"), numeric, boosted(trees))
        return metrics.accuracy(score(model, rows.where("role = 'test'")), ["source_dataset", "horizon"], "label", "prediction")

    for part in side_by_side(panel.sparkSession, [partial(at, h, source) for h, source in able]):
        out = part if out is None else out.unionByName(part)
    if out is None:
        return metrics.accuracy(panel.limit(0).select("source_dataset", "horizon", F.lit(0.0).alias("label"), F.lit(0.0).alias("prediction")), ["source_dataset", "horizon"], "label", "prediction")
    return out


def conformal_intervals(predictions: DataFrame, by: Sequence[str] = ("source_dataset",), low: float = 0.1, high: float = 0.9, within: Sequence[str] = (), least: int = 50) -> DataFrame:
    """P10/P50/P90 of every scored row of validation and test, from validation residuals.

    ``within``: columns that cut a group ``by`` further (its regimes). Residuals are those of the row's own part of the group if
    that has at least ``least`` of them, of the whole group otherwise; null parts are parts. Bounds are
    non-negative and sorted; a group without any residual has null ones.
    """
    by, within = list(by), list(within)
    residual = predictions.where("split = 'validation'").withColumn("_r", F.col("actual") - F.col("prediction"))
    whole = exact_quantiles(residual, "_r", [low, 0.5, high], by, ["_lo", "_mid", "_hi"]).drop("n")
    rows = predictions.where("split IN ('validation', 'test') AND prediction IS NOT NULL").join(whole, by, "left")
    cuts = {c: F.col(c) for c in ("_lo", "_mid", "_hi")}
    if within:
        own = exact_quantiles(residual, "_r", [low, 0.5, high], [*by, *within], ["_plo", "_pmid", "_phi"]).where(F.col("n") >= least).drop("n")
        own = own.select(*[F.col(c).alias(f"_of_{c}") for c in [*by, *within]], "_plo", "_pmid", "_phi")
        same = F.lit(True)
        for c in [*by, *within]:
            same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        rows = rows.join(own, same, "left").drop(*[f"_of_{c}" for c in [*by, *within]])
        cuts = {c: F.when(F.col("_pmid").isNotNull(), F.col(f"_p{c[1:]}")).otherwise(F.col(c)) for c in cuts}
    p = F.col("prediction")
    sorted_ = F.array_sort(F.array(*[F.when(c.isNotNull(), F.greatest(F.lit(0.0), p + c)) for c in cuts.values()]))
    return rows.withColumn("_q", sorted_).withColumns({
        "lower_bound": F.col("_q")[0], "p50": F.col("_q")[1], "upper_bound": F.col("_q")[2]
    }).drop("_q", "_lo", "_mid", "_hi", "_plo", "_pmid", "_phi")


def prediction_regimes(predictions: DataFrame, by: Sequence[str] = ("source_dataset",)) -> DataFrame:
    """``predictions`` with ``regime``: zero, low, medium or high, by tertiles of the group's validation predictions above 0.

    What a forecast says is known when it is made, unlike the demand that ``metrics.with_regime`` goes by.
    """
    known = predictions.where("split = 'validation' AND prediction > 0")
    cuts = exact_quantiles(known, "prediction", [1 / 3, 2 / 3], list(by), ["_q1", "_q2"]).drop("n")
    p = F.col("prediction")
    regime = F.when(p == 0, "zero").when(p <= F.col("_q1"), "low").when(p <= F.col("_q2"), "medium").when(p.isNotNull(), "high")
    return predictions.join(cuts, list(by), "left").withColumn("regime", regime).drop("_q1", "_q2")


STRIDES = {UCI: 5, SYNTHETIC: 7}  # test rows of a series from one origin to the next
FUTURE = max(HORIZONS)


OWN_TERMS = tuple(c for c in TERMS if c not in ("discount_pct", "promotion_flag"))


def _states(flat: np.ndarray, there: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, known) of states: the values ``there`` among the ``rows`` of ``flat`` in front of each of ``ends``."""
    values, known = before(flat, ends, rows)
    if there.all():
        return values, known
    held = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(MEMORY, bool), there]), MEMORY)[ends] & (np.arange(MEMORY, 0, -1) <= known[:, None])
    order = np.argsort(held, axis=1, kind="stable")  # those there to the end, in their order
    return np.where(np.take_along_axis(held, order, 1), np.take_along_axis(values, order, 1), 0.0), held.sum(axis=1)


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms, price and units of the rows to learn from, of rows that come sorted within their series and numbered from 1 in it."""
    flat, there = np.zeros(0), np.zeros(0, bool)
    for batch in batches:
        carried = len(flat)
        flat, there = np.concatenate([flat, numbers(batch["units_sold"])]), np.concatenate([there, batch["units_sold"].is_valid().to_numpy(zero_copy_only=False)])
        chosen = np.flatnonzero(batch["_learn"].to_numpy(zero_copy_only=False))
        values, known = _states(flat, there, chosen + carried, np.minimum(batch["_at"].to_numpy()[chosen] - 1, MEMORY))
        some = known > 0
        chosen, none = chosen[some], np.zeros(some.sum())
        found = terms(State(values[some], known[some], days(batch["date"])[chosen], none, none))
        own = [batch[c].take(pa.array(chosen)) for c in ("_price", "units_sold")]
        yield pa.RecordBatch.from_arrays([*[pa.array(found[c], from_pandas=True) for c in OWN_TERMS], *own], [*OWN_TERMS, "price", "units_sold"])
        flat, there = flat[-MEMORY:], there[-MEMORY:]


def with_price(panel: DataFrame, keys: Sequence[str] = GRAIN) -> DataFrame:
    """``panel`` (keys, date, units_sold, revenue) with the last known price before each row."""
    price = F.when(F.col("units_sold") > 0, F.col("revenue") / F.col("units_sold"))
    return panel.withColumn("_price", F.last(price, ignorenulls=True).over(past(series(keys))))


def learned_rows(panel: DataFrame, keys: Sequence[str] = GRAIN) -> DataFrame:
    """What ``scenarios.terms`` says before each training row that has a value before it, its price and its units.

    A series passes as it is sorted, a row at a time and not its last values with every row.
    """
    rows = with_price(panel, keys).withColumn("_at", F.row_number().over(series(keys))).select(
        "_at", "date", F.col("units_sold").cast("double"), F.col("_price").cast("double"), F.coalesce(F.col("split") == "train", F.lit(False)).alias("_learn"))
    return rows.mapInArrow(_learned, ", ".join(f"{c} double" for c in (*OWN_TERMS, "price", "units_sold")))


def recursive_origins(panel: DataFrame, strides: Mapping[str, int] = STRIDES, keys: Sequence[str] = GRAIN) -> DataFrame:
    """State of each (series, origin): the values before it, the price, and the rows that follow (at most FUTURE).

    Origins are every so many test rows of a series; one needs a value before it and a row after its first step. Two
    bounded frames over one sort: no series is gathered as a whole.
    """
    w = series(keys)
    # only what a test row looks back or ahead to is gathered
    near = F.max(F.coalesce(F.col("split") == "test", F.lit(False))).over(w.rowsBetween(1 - FUTURE, MEMORY))
    rows = with_price(panel, keys).withColumn("_near", near).where("_near").withColumns({
        "_values": F.collect_list(F.col("units_sold").cast("double")).over(w.rowsBetween(-MEMORY, -1)),
        "_future": F.collect_list(F.struct("date", F.col("units_sold").cast("double").alias("y"))).over(w.rowsBetween(0, FUTURE - 1)),
        "_origin": F.lag("date", 1).over(w),
        "_test": F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1,
    })
    chosen = (F.col("split") == "test") & (F.pmod(F.col("_test"), _by_source(strides)) == 0) & (F.size("_values") > 0) & (F.size("_future") > 1)
    return rows.where(chosen).select(*keys, "_origin", "_values", "_price", "_future")


def _by_source(values: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for source, value in values.items():
        out = F.when(F.col("source_dataset") == source, F.lit(value)).otherwise(out)
    return out


def _walk(model: PipelineModel | None, horizons: Sequence[int], keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function of batches of states that takes each as far as it has rows to come, and returns a row for each of ``horizons``."""
    trees = None if model is None else Boosted.of(model.stages[-1])
    medians, gaps = ({}, []) if model is None else (model.stages[0].medians, model.stages[0].gaps)
    names, steps, last = [*OWN_TERMS, "price"], set(horizons), max(horizons)

    def predicted(state: State, price: np.ndarray, known_price: np.ndarray) -> np.ndarray:
        if trees is None:
            return np.zeros(len(state.known))
        found = terms(state)
        given = {**{c: ~np.isnan(found[c]) for c in OWN_TERMS}, "price": known_price}
        found["price"] = price
        inputs = np.stack([*[np.where(given[c], found[c], medians[c]) for c in names], *[np.where(given[c], 0.0, 1.0) for c in gaps]])
        return nonnegative_sum(trees.parts(inputs))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, known = last_values(batch["_values"])
            price, known_price = numbers(batch["_price"]), batch["_price"].is_valid().to_numpy(zero_copy_only=False)
            future = batch["_future"]
            ahead, size = future.flatten(), future.value_lengths().to_numpy(zero_copy_only=False)
            begin, day = np.cumsum(size) - size, days(ahead.field("date"))
            live, none = np.arange(batch.num_rows), np.zeros(batch.num_rows)
            for h in range(1, last + 1):
                keep = size[live] >= h
                live, values, known = live[keep], values[keep], known[keep]
                if not len(live):
                    break
                at = begin[live] + h - 1
                made = predicted(State(values, known, day[at], none[live], none[live]), price[live], known_price[live])
                if h in steps:
                    own, target = batch.select([*keys, "_origin"]).take(pa.array(live)), ahead.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, target.field("date"), pa.array(np.full(len(live), h, "int32")), target.field("y"), pa.array(made)],
                        [*keys, "origin_date", "target_date", "horizon", "actual", "prediction"])
                values, known = np.hstack([values[:, 1:], made[:, None]]), np.minimum(known + 1, MEMORY)

    return walk


def recursive(panel: DataFrame, horizons: Sequence[int] = HORIZONS, strides: Mapping[str, int] = STRIDES, trees: int = TREES, keys: Sequence[str] = GRAIN) -> DataFrame:
    """Forecasts that feed each prediction back, for every series and origin of the test period, at each of ``horizons``.

    ``panel``: rows of one source with splits. The model learns from the training rows; a state holds the last MEMORY values, the
    price as it was at the origin and the rows to come. A state is walked where it lies, by the model as arrays, as long
    as it has rows to come.
    """
    names = [*OWN_TERMS, "price"]
    train = stored(learned_rows(panel, keys), "training")
    state = stored(recursive_origins(panel, strides, keys), "origins")
    model = None if train.isEmpty() else fit(with_indicators(train, names), names, boosted(trees))  # None: nothing to learn from
    kinds = ", ".join(f"`{c}` {panel.schema[c].dataType.simpleString()}" for c in keys)
    date = panel.schema["date"].dataType.simpleString()
    return state.mapInArrow(_walk(model, horizons, keys), f"{kinds}, origin_date {date}, target_date {date}, horizon int, actual double, prediction double")


def fold_models(rows: DataFrame, folds: DataFrame, numeric: Sequence[str], count: int, estimator=None, categorical: Sequence[str] = ()) -> DataFrame:
    """Retrain on every fold's past and score its validation period."""
    rows = stored(with_indicators(rows, numeric), "folds")

    def fold(k: int) -> DataFrame:
        spec = folds.where(F.col("fold") == k)
        part = rows.join(F.broadcast(spec), "source_dataset").where(F.col("week") <= F.col("val_end"))
        model = fit(part.where(F.col("week") <= F.col("train_end")), numeric, estimator or boosted(), categorical)
        return score(model, part.where(F.col("week") >= F.col("val_start"))).select("source_dataset", "product_key", "week", "fold", "label", "prediction")

    out = None
    for scored in side_by_side(rows.sparkSession, [partial(fold, k) for k in range(count)]):
        out = scored if out is None else out.unionByName(scored)
    return out


def grid(trees: int = TREES) -> list[dict]:
    """Eight settings around a number of iterations."""
    return [{"maxIter": i, "maxDepth": d, "stepSize": s} for i in (max(1, trees // 2), trees) for d in (3, 6) for s in (0.05, 0.1)]


def tune(rows: DataFrame, numeric: Sequence[str], configs: Sequence[Mapping] | None = None, categorical: Sequence[str] = ()) -> DataFrame:
    """Settings compared on the validation WAPE.

    Settings that differ in their iterations only are one fit: the model of fewer is the first trees of the model of most.
    """
    configs = configs or grid()
    rows = stored(with_indicators(rows, numeric), "training")
    train, val = rows.where("split = 'train'"), rows.where("split = 'validation'")
    others = [tuple(sorted((k, v) for k, v in cfg.items() if k != "maxIter")) for cfg in configs]
    most = {o: max(cfg["maxIter"] for cfg, x in zip(configs, others, strict=True) if x == o) for o in dict.fromkeys(others)}
    prepared = FeaturePreparer(numeric, categorical).fit(train)
    found = dict(zip(most, fit_all(train, prepared, [GBTRegressor(seed=SEED, maxIter=n, **dict(o)) for o, n in most.items()]), strict=True))
    models = {i: first_trees(found[o], cfg["maxIter"]) for i, (cfg, o) in enumerate(zip(configs, others, strict=True))}
    table = metrics.accuracy(score_all(prepared, models, val, ["source_dataset", "label"]), ["source_dataset", "_model"], "label", "prediction")
    said = F.array(*[F.struct(F.lit(i).alias("config"), F.lit(c["maxIter"]).alias("max_iter"), F.lit(c["maxDepth"]).alias("max_depth"), F.lit(c["stepSize"]).alias("step_size")) for i, c in enumerate(configs)])
    out = table.select("source_dataset", *[c for c in table.columns if c not in ("source_dataset", "_model")], said[F.col("_model")].alias("_c")).select("*", "_c.*").drop("_c")
    best = Window.partitionBy("source_dataset").orderBy("wape", "mae", "config")
    return out.withColumn("rank", F.row_number().over(best))


def weekly_candidate(features: DataFrame, backtest: DataFrame, numeric: Sequence[str], folds: int, estimator=None, categorical: Sequence[str] = ()) -> DataFrame:
    """A model per fold replaces the candidate of the rolling-origin rows.

    A fold's model sees weeks up to its origin only, and its target weeks are
    scored from features frozen at the origin week.
    """
    features = stored(with_indicators(features, numeric), "folds")
    origins = stored(backtest.groupBy("source_dataset", "fold").agg(F.min("forecast_origin").alias("origin")), "origins")
    keys = ["source_dataset", "product_key"]
    back = F.row_number().over(series(keys, F.desc("week")))

    def fold(k: int) -> DataFrame:
        spec = origins.where(F.col("fold") == k).select("source_dataset", "origin")
        past = features.join(F.broadcast(spec), "source_dataset").where(F.col("week") <= F.col("origin"))
        model = fit(past.where(F.col("lag_1").isNotNull()), numeric, estimator or boosted(), categorical)
        newest = past.withColumn("_back", back).where(F.col("_back") == 1).drop("_back")
        return score(model, newest).select(*keys, F.lit(k).alias("fold"), F.col("prediction").alias("model_forecast"))

    out = None
    for scored in side_by_side(features.sparkSession, [partial(fold, k) for k in range(folds)]):
        out = scored if out is None else out.unionByName(scored)
    joined = backtest.join(out, [*keys, "fold"], "left")
    return joined.withColumn("candidate_forecast", F.coalesce("model_forecast", "seasonal_naive_forecast")).drop("model_forecast")


def batch_forecast(model: PipelineModel, rows: DataFrame, bounds: DataFrame, keys: Sequence[str], version: str = "v1") -> DataFrame:
    """Point forecast with its interval companion, in the delivery schema."""
    point = score(model, rows).select(*keys, "prediction")
    return point.join(bounds, list(keys), "left").withColumns({"model_name": F.lit("gradient_boosting"), "model_version": F.lit(version)})


def flat_multi_step(model: PipelineModel, origin_rows: DataFrame, horizon: int = 6, extended: int = 8) -> DataFrame:
    """One score per series, repeated for every step with its production status."""
    scored = score(model, origin_rows)
    step = F.explode(F.sequence(F.lit(1), F.lit(extended))).alias("horizon")
    rows = scored.select("source_dataset", "product_key", F.col("week").alias("forecast_origin"), "prediction", step)
    return rows.select(
        "source_dataset", "product_key", "forecast_origin", "horizon", F.col("prediction").alias("forecast_demand"),
        metrics.horizon_label(F.col("horizon"), horizon).alias("forecast_status"), F.lit(horizon).alias("supported_horizon"))


def classify_probability(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """P(demand > 0) of held-out rows from a logistic model."""
    rows = stored(with_indicators(rows, numeric).withColumn("label", (F.col("units_sold") > 0).cast("double")), "training")
    model = fit(rows.where("split = 'train'"), numeric, LogisticRegression(maxIter=50, regParam=1e-4), categorical)
    return model.transform(rows.where("split <> 'train'")).select("source_dataset", "split", "label", vector_to_array("probability")[1].alias("score"))


def share_within(df: DataFrame) -> DataFrame:
    """Coverage of the intervals per source."""
    inside = (F.col("actual") >= F.col("lower_bound")) & (F.col("actual") <= F.col("upper_bound"))
    return df.groupBy("source_dataset").agg(F.count("*").alias("n"), rnd(ratio(F.count_if(inside), F.count("*")) * 100.0, 4).alias("coverage_pct"))
