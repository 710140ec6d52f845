"""Risk: winter features, the overload model, and the ranking of protection zones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feederlake.functions.calendar import winter_name
from feederlake.operators.ranks import average_precision, percent_ranks, roc_auc
from feederlake.plans.gold import transformer_profile
from feederlake.plans.network import Network, product
from feederlake.schemas import OVERLOAD_PCT, TIER_HIGH, TIER_LOW, TIER_MEDIUM
from feederlake.session import settle, shared_folder
from feederlake.sources.tables import TableStore

FEATURES = ("max_overload_pct", "p95_overload_pct", "days_over_120", "days_over_150", "kva_per_degree_below_15",
            "kva", "age_years", "n_customers", "electric_heating_share", "customers_per_10kva", "is_urban")

# Weights of the zone score and its tiers.
SCORE_WEIGHTS = {"chi_6m": 0.45, "_trend": 0.20, "avg_pole_age_years": 0.20, "high_risk_transformers": 0.15}
ZONE_HIGH, ZONE_MEDIUM = 0.75, 0.5
OVERLOAD_LOW, OVERLOAD_MEDIUM = 0.3, 0.6


# ---------------------------------------------------------------- features

def _winter_readings(net: Network, winter: int) -> DataFrame:
    """The readings of one winter; those of the network's two winters are looked up together, once."""
    loads = net.table("gold.transformer_load_daily").select(
        "transformer_id", "winter_label", "peak_kva", "overload_pct", "temp_min_c")
    if winter in net.settings.winters:
        both = F.col("winter_label").isin(*map(winter_name, net.settings.winters))
        loads = net.once("winter-readings", lambda: loads.filter(both))
    return loads.filter(F.col("winter_label") == winter_name(winter))


def winter_features(net: Network, winter: int) -> DataFrame:
    """One row per transformer with readings in the winter."""
    over = F.col("overload_pct")
    # a day without a temperature counts as no cold at all
    cold = F.greatest(F.lit(0.0), F.lit(15.0) - F.col("temp_min_c"))
    season = (_winter_readings(net, winter).groupBy("transformer_id").agg(
                  F.max(over).alias("max_overload_pct"),
                  F.percentile_approx(over, 0.95).alias("p95_overload_pct"),
                  F.count_if(over > 120).alias("days_over_120"),
                  F.count_if(over > OVERLOAD_PCT).alias("days_over_150"),
                  F.regr_slope(F.col("peak_kva"), cold).alias("kva_per_degree_below_15")))
    urban = net.table("silver.operating_centers").select("ced_code", F.col("is_urban").cast("int").alias("is_urban"))
    return transformer_profile(net).join(urban, "ced_code").join(season, "transformer_id").select(
        "transformer_id", "line_id", "ced_code", "kva", "age_years", "n_customers",
        F.coalesce("electric_heating_share", F.lit(0.0)).alias("electric_heating_share"),
        F.try_divide(F.lit(10.0) * F.col("n_customers"), F.col("kva")).alias("customers_per_10kva"), "is_urban",
        "max_overload_pct", "p95_overload_pct", "days_over_120", "days_over_150", "kva_per_degree_below_15")


def winter_label_table(net: Network, winter: int) -> DataFrame:
    """Whether each transformer went over the limit in the winter."""
    return (_winter_readings(net, winter).groupBy("transformer_id")
            .agg((F.max("overload_pct") > OVERLOAD_PCT).cast("int").alias("overload_next_winter")))


def training_set(net: Network) -> DataFrame:
    features = winter_features(net, net.settings.feature_winter)
    return features.join(winter_label_table(net, net.settings.label_winter), "transformer_id")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight each row by n / (2 * size of its class)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))  # two rows
    total = sizes.agg(F.sum("_n")).scalar()
    weights = sizes.withColumn("_total", total).select(
        label, (F.col("_total") / (F.lit(2.0) * F.col("_n"))).alias("weight"))
    return df.join(weights, label)


def hold_out(df: DataFrame, share: float = 0.25, label: str = "overload_next_winter") -> tuple[DataFrame, DataFrame]:
    """(training, test), stratified: of every class the ids with the smallest hashes, up to its share, are the test.

    Hashes fall into 4,096 buckets; a class is cut after the bucket that reaches the share, so a rare one has a row in
    the test as well.
    """
    df = df.withColumn("_bucket", F.expr("CAST(conv(left(md5(transformer_id), 8), 16, 10) AS BIGINT) % 4096"))
    sizes = df.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("n"))  # 4,096 rows per class at most
    upto = Window.partitionBy(label).orderBy("_bucket")
    whole = Window.partitionBy(label)
    cuts = (sizes.select(label, "_bucket", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("all"))
            .filter(F.col("before") < share * F.col("all")).groupBy(label).agg(F.max("_bucket").alias("_cut")))
    marked = df.join(F.broadcast(cuts), label)  # one row per class
    test = F.col("_bucket") <= F.col("_cut")
    return marked.filter(~test).drop("_bucket", "_cut"), marked.filter(test).drop("_bucket", "_cut")


# ---------------------------------------------------------------- model

@dataclass(frozen=True)
class ModelSpec:
    """Boosted trees; Spark's have no L2 penalty."""

    rounds: int = 300
    rate: float = 0.05
    depth: int = 4
    seed: int = 42


def overload_pipeline(spec: ModelSpec) -> Pipeline:
    """The slope is missing when the temperature never varied: fill it and say so."""
    others = [c for c in FEATURES if c != "kva_per_degree_below_15"]
    return Pipeline(stages=[
        Imputer(inputCols=["kva_per_degree_below_15"], outputCols=["slope_filled"], strategy="median"),
        VectorAssembler(inputCols=[*others, "slope_filled", "slope_missing"], outputCol="features",
                        handleInvalid="keep"),
        GBTClassifier(featuresCol="features", labelCol="overload_next_winter", weightCol="weight",
                      maxIter=spec.rounds, stepSize=spec.rate, maxDepth=spec.depth, seed=spec.seed,
                      checkpointInterval=10, cacheNodeIds=False),
    ])


def _numeric(df: DataFrame) -> DataFrame:
    df = df.withColumns({c: F.col(c).cast("double") for c in FEATURES})
    return df.withColumn("slope_missing", F.col("kva_per_degree_below_15").isNull().cast("double"))


def fit(train: DataFrame, spec: ModelSpec) -> PipelineModel:
    shared_folder(train.sparkSession)  # boosting checkpoints there
    return overload_pipeline(spec).fit(balanced_weights(_numeric(train), "overload_next_winter"))


def with_score(features: DataFrame, model: PipelineModel) -> DataFrame:
    scored = model.transform(_numeric(features))
    return scored.withColumn("risk_score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction", "slope_filled", "slope_missing")


def quality(scored: DataFrame) -> DataFrame:
    """ROC AUC, average precision, recall of the model and of last winter's overloads."""
    label = F.col("overload_next_winter")
    positives = F.greatest(F.lit(1), F.sum(label))
    return scored.agg(
        F.avg(label).alias("positive_rate"),
        (F.sum(F.when((F.col("max_overload_pct") > OVERLOAD_PCT) & (label == 1), 1).otherwise(0)) / positives)
        .alias("baseline_last_winter_recall"),
        (F.sum(F.when((F.col("risk_score") >= 0.5) & (label == 1), 1).otherwise(0)) / positives)
        .alias("model_recall_at_0_5"),
    ).withColumns({"roc_auc": roc_auc(scored, "risk_score", "overload_next_winter").scalar(),
                   "pr_auc": average_precision(scored, "risk_score", "overload_next_winter").scalar()})


def baseline(test: DataFrame) -> DataFrame:
    """What is known before any model: held-out rows, their positive rate, and the recall of last winter's overloads."""
    label = F.col("overload_next_winter")
    again = F.when((F.col("max_overload_pct") > OVERLOAD_PCT) & (label == 1), 1).otherwise(0)
    return test.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(label), 9).alias("positive_rate"),
                    F.round(F.sum(again) / F.greatest(F.lit(1), F.sum(label)), 9).alias("baseline_last_winter_recall"))


def evaluate(net: Network, spec: ModelSpec) -> DataFrame:
    """Quality on held-out transformers."""
    train, test = hold_out(settle(training_set(net), "training"))
    return quality(settle(with_score(test, fit(train, spec)), "held-out"))


MODEL_TABLE = "models.overload"


def publish(store: TableStore, model: PipelineModel) -> int:
    """Save the model as the next version and point the champion at it."""
    version = store.version(MODEL_TABLE) + 1
    path = f"{store.root}/{MODEL_TABLE}.v{version}"
    model.write().overwrite().save(path)
    pointer = store.spark.createDataFrame([("champion", version, path)], "alias string, version int, path string")
    return store.replace(MODEL_TABLE, pointer, version=version)


def champion(store: TableStore, version: int | None = None) -> tuple[int, PipelineModel]:
    """The current champion, or a given earlier version."""
    row = store.read(MODEL_TABLE, version).first()
    return row.version, PipelineModel.load(row.path)


def boosted_scorer(spec: ModelSpec) -> Callable[[Network, DataFrame], DataFrame]:
    """Fit on every transformer of the feature winter, publish where there is a store, then score."""
    def score(net: Network, features: DataFrame) -> DataFrame:
        model = fit(settle(training_set(net), "training"), spec)
        if net.store is not None:
            net.model_version = publish(net.store, model)
        return with_score(features, model)

    return score


def last_winter_scorer(net: Network, features: DataFrame) -> DataFrame:
    """The naive baseline as a score: twice the limit counts as certain. A unit without a rating has no score."""
    share = F.col("max_overload_pct") / F.lit(2.0 * OVERLOAD_PCT)
    return features.withColumn("risk_score", F.when(share.isNotNull(), F.least(F.lit(1.0), share)))


def overload_tier(score: Column) -> Column:
    """Right-closed bins: exactly 0.3 is still low. Without a score there is no tier."""
    return F.when(score <= OVERLOAD_LOW, TIER_LOW).when(score <= OVERLOAD_MEDIUM, TIER_MEDIUM).when(
        score.isNotNull(), TIER_HIGH)


@product("gold.transformer_risk")
def transformer_risk(net: Network) -> DataFrame:
    features = winter_features(net, net.settings.label_winter)
    scored = (net.scorer or boosted_scorer(ModelSpec()))(net, features)
    return scored.select(
        "transformer_id", "line_id", "ced_code", F.lit(net.settings.target_winter).alias("target_winter"),
        "risk_score", overload_tier(F.col("risk_score")).alias("risk_tier"),
        F.col("max_overload_pct").alias("max_overload_pct_last_winter"),
        F.col("days_over_150").cast("long").alias("days_over_150_last_winter"),
        F.col("kva").cast("double").alias("kva"), F.col("n_customers").cast("long").alias("n_customers"),
        F.lit(net.model_version).alias("model_version"))


# ---------------------------------------------------------------- zones

def _zone_base(net: Network) -> DataFrame:
    tiers = net.table("gold.transformer_risk").select("transformer_id", "risk_tier")
    high = (transformer_profile(net).select("transformer_id", "zone_id").join(tiers, "transformer_id", "left")
            .groupBy("zone_id").agg(F.count_if(F.col("risk_tier") == TIER_HIGH).alias("high_risk_transformers")))
    now, was = (F.col(c).cast("decimal(18,1)") for c in ("chi_3m", "chi_prev_3m"))
    trend = F.when(F.col("chi_prev_3m") > 0, F.round(F.try_divide((now - was) * 100, was), 0).cast("double"))
    return (net.table("gold.zone_summary").join(high, "zone_id", "left")
            .withColumns({"high_risk_transformers": F.coalesce("high_risk_transformers", F.lit(0)),
                          "chi_trend_pct": trend}))


@product("gold.zone_risk")
def zone_risk(net: Network) -> DataFrame:
    """Weighted sum of four percentile ranks over all zones."""
    base = settle(_zone_base(net), "zones").withColumn("_trend", F.coalesce("chi_trend_pct", F.lit(0.0)))
    centres = net.table("gold.zone_shapes").select("zone_id", "centroid_lon", "centroid_lat")
    ranked = base.join(percent_ranks(base, "zone_id", list(SCORE_WEIGHTS)), "zone_id").join(centres, "zone_id")
    parts = [F.lit(w) * F.col(f"rank_{i}") for i, w in enumerate(SCORE_WEIGHTS.values())]
    score = F.round(parts[0] + parts[1] + parts[2] + parts[3], 3)
    tier = (F.when(F.col("risk_score") >= ZONE_HIGH, TIER_HIGH)
            .when(F.col("risk_score") >= ZONE_MEDIUM, TIER_MEDIUM).otherwise(TIER_LOW))
    return ranked.withColumn("risk_score", score).withColumn("risk_tier", tier).select(
        "zone_id", "device_type", "line_id", "substation_code", "ced_code", "region_name", "n_customers",
        "avg_pole_age_years", "interruptions_3m", "interruptions_6m", "chi_3m", "chi_prev_3m", "chi_6m",
        "high_risk_transformers", "chi_trend_pct", "risk_score", "risk_tier", "centroid_lon", "centroid_lat")


def prompts(net: Network, top: int = 15) -> DataFrame:
    """The text sent out for advice on the highest-scored zones."""
    zones = net.table("gold.zone_risk").orderBy(F.desc("risk_score"), "zone_id").limit(top)
    facts = F.concat_ws(
        "; ",
        F.concat(F.lit("Zone "), "zone_id", F.lit(" ("), "device_type", F.lit("), ligne "), "line_id",
                 F.lit(", région "), "region_name"),
        F.concat(F.lit("clients : "), F.coalesce(F.col("n_customers").cast("string"), F.lit("0"))),
        F.concat(F.lit("interruptions sur 6 mois : "), F.col("interruptions_6m").cast("string")),
        F.concat(F.lit("CHI sur 6 mois : "), F.col("chi_6m").cast("string")),
        F.concat(F.lit("tendance CHI : "), F.coalesce("chi_trend_pct", F.lit(0.0)).cast("string"), F.lit(" %")),
        F.concat(F.lit("âge moyen des poteaux : "), F.col("avg_pole_age_years").cast("string")),
        F.concat(F.lit("transformateurs à risque élevé : "), F.col("high_risk_transformers").cast("string")))
    ask = F.lit("Proposer une seule mesure pour l'exploitation, en 35 mots au plus, d'abord en français, puis en "
                "anglais après « || ».")
    return zones.select("zone_id", "risk_score", F.concat_ws(". ", facts, ask).alias("prompt"))


def split_reply(reply: Column) -> tuple[Column, Column]:
    """French and English half of a reply."""
    halves = F.split(reply, r"\|\|")
    return F.trim(F.try_element_at(halves, F.lit(1))), F.trim(F.try_element_at(halves, F.lit(2)))


@product("gold.zone_risk_recommendations")
def zone_risk_recommendations(net: Network) -> DataFrame:
    """Replies arrive as an input table; without one the table is empty."""
    schema = "zone_id string, recommendation string"
    if net.replies is None:
        return net.spark.createDataFrame([], schema)
    return net.replies.select(F.col("zone_id").cast("string").alias("zone_id"), "recommendation")
