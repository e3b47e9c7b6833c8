"""Traffic models: ordered clusters, accident risk, speed in two bands, and forecasts of scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TIME = ["interval_cos", "interval_sin"]


def assemble(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Adds a vector of the columns; rows with an unknown value are left out."""
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip").transform(df)


def clusters(rows: DataFrame, k: int = 3, seed: int = 1) -> DataFrame:
    """Adds km_features and cluster_num: KMeans clusters of speed and travel time, numbered by ascending mean speed."""
    data = assemble(rows, ["velocity", "travel_time"], "km_features")
    model = KMeans(featuresCol="km_features", predictionCol="_c", k=k, seed=seed).fit(data)
    found = model.transform(data)
    order = found.groupBy("_c").agg(F.avg("velocity").alias("v")).withColumn("cluster_num", F.row_number().over(Window.orderBy("v", "_c")) - 1)  # k rows
    return found.join(F.broadcast(order.select("_c", "cluster_num")), "_c").drop("_c")


def silhouette(clustered: DataFrame) -> float:
    return ClusteringEvaluator(featuresCol="km_features", predictionCol="cluster_num", metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(clustered.withColumn("cluster_num", F.col("cluster_num").cast("double")))


def split(rows: DataFrame, key: str = "id", test: int = 10, seed: int = 68) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, one in ``test`` for testing, by a hash of the key: alike for every layout of the data."""
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(test))
    return rows.where(part != 0), rows.where(part == 0)


def fit_accidents(train: DataFrame) -> LogisticRegressionModel:
    data = assemble(train, ["velocity", *TIME], "logreg_features")
    return LogisticRegression(featuresCol="logreg_features", labelCol="accident", predictionCol="predicted_accident", maxIter=10, regParam=0.01).fit(data)


def accident_metrics(model: LogisticRegressionModel, test: DataFrame, label: float = 0.0) -> dict[str, float]:
    scored = model.transform(assemble(test, ["velocity", *TIME], "logreg_features")).withColumn("accident", F.col("accident").cast("double"))
    return {m: MulticlassClassificationEvaluator(labelCol="accident", predictionCol="predicted_accident", metricName=m, metricLabel=label).evaluate(scored) for m in ("f1", "precisionByLabel", "recallByLabel")}


@dataclass
class SpeedModel:
    """Two linear models of the fourth root of speed, above and up to a travel time."""

    threshold: float
    above: LinearRegressionModel
    below: LinearRegressionModel

    def predict(self, rows: DataFrame) -> DataFrame:
        data = assemble(rows, _SPEED_FEATURES, "linreg_features")
        parts = [m.transform(data.where(c)) for m, c in ((self.above, F.col("travel_time") > self.threshold), (self.below, F.col("travel_time") <= self.threshold))]
        return parts[0].unionByName(parts[1]).withColumn("predicted_velocity", F.pow("predicted_root4", F.lit(4.0))).drop("linreg_features", "predicted_root4")


_SPEED_FEATURES = ["root4_travel_time", "volume", *TIME]


def fit_speed(train: DataFrame, threshold: float) -> SpeedModel:
    data = assemble(train.where("root4_velocity is not null"), _SPEED_FEATURES, "linreg_features")
    regression = LinearRegression(featuresCol="linreg_features", labelCol="root4_velocity", predictionCol="predicted_root4")
    above, below = (regression.fit(data.where(c)) for c in (F.col("travel_time") > threshold, F.col("travel_time") <= threshold))
    return SpeedModel(threshold, above, below)


def speed_metrics(model: SpeedModel, test: DataFrame) -> dict[str, float]:
    scored = model.predict(test.where("velocity is not null"))
    return {m: RegressionEvaluator(labelCol="velocity", predictionCol="predicted_velocity", metricName=m).evaluate(scored) for m in ("rmse", "mse", "mae", "r2")}


#: Scenarios: factor of travel time, first interval it holds from, clusters it holds for (fixed values).
SCENARIOS = [
    ("no_solution", 1.00, 0, [0, 1, 2]),
    ("increase_police_presence", 1.15, 79, [2]),
    ("plus_5_speed_limit", 0.91, 0, [1, 2]),
    ("minus_5_speed_limit", 1.09, 0, [1, 2]),
    ("extra_lane", 0.75, 0, [0, 1]),
]


#: Draws of a volume until one is not negative.
REDRAWS = 64


def scenario_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "scenario string, factor double, first_interval int, clusters array<int>")


def forecast(volumes: DataFrame, shares: DataFrame, log_time: DataFrame, speed: SpeedModel, accidents: LogisticRegressionModel, first_day: str = "2024-07-01", days: int = 31, seed: int = 11) -> DataFrame:
    """Vehicles (scenario, id, datetime, cluster_num, velocity, travel_time, accident) of every scenario and day, in one job.

    Volumes are normal by interval (negative ones are drawn again, ``REDRAWS`` times, of which a mean of 0 or more leaves none in 2**64), clusters follow their shares, travel times are normal by interval and cluster, in the
    slowest cluster the exponential of a log-normal draw. Every draw is a hash of the seed and the vehicle's place, so results repeat whatever the layout.
    """
    spark = volumes.sparkSession

    def uniform(salt: int, *columns):
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *columns), F.lit(1 << 52)) + 0.5) / (1 << 52)

    def normal(salt: int, *columns):
        return F.sqrt(-2 * F.log(uniform(salt, *columns))) * F.cos(2 * F.pi() * uniform(salt + 1, *columns))

    days_ = spark.range(days).select(F.date_add(F.lit(first_day).cast("date"), F.col("id").cast("int")).alias("day"))
    slots = days_.crossJoin(F.broadcast(scenario_table(spark))).crossJoin(F.broadcast(volumes.select("interval_index", "mean_volume", F.coalesce("stddev_volume", F.lit(0.0)).alias("stddev_volume"))))  # days x scenarios x 96, no vehicles yet
    place = ["scenario", "day", "interval_index"]
    draw = lambda again: F.col("mean_volume") + F.col("stddev_volume") * normal(100, again, *place)
    slots = slots.withColumn("volume", F.coalesce(F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(REDRAWS)), draw), lambda x: x >= 0), F.lit(0)), F.lit(0.0)).cast("int"))
    upto = Window.partitionBy("interval_index").orderBy("cluster_num").rowsBetween(Window.unboundedPreceding, 0)
    bands = shares.withColumn("high", F.sum("share").over(upto)).groupBy("interval_index").agg(F.sort_array(F.collect_list(F.struct("high", "cluster_num", "mean_cluster_time", F.coalesce("stddev_cluster_time", F.lit(0.0)).alias("stddev")))).alias("bands"))
    rows = slots.join(F.broadcast(bands), "interval_index").where("volume > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("volume"))))
    u = uniform(3, *place, "n")
    rows = rows.withColumn("_u", u).withColumn("_b", F.coalesce(F.get(F.filter("bands", lambda b: b["high"] >= F.col("_u")), F.lit(0)), F.element_at("bands", -1)))
    rows = rows.crossJoin(F.broadcast(log_time))  # one row
    cluster = F.col("_b.cluster_num")
    factor = F.when(F.array_contains("clusters", cluster) & (F.col("interval_index") >= F.col("first_interval")), F.col("factor")).otherwise(1.0)
    z = normal(5, *place, "n")
    mean_log = F.col("mean_log_time") * factor
    slow = F.exp(F.exp(F.log(mean_log - 0.032) + (F.col("stddev_log_time") / mean_log + 0.032) * z))
    time = F.when(cluster == 0, slow).otherwise(F.col("_b.mean_cluster_time") * factor + F.col("_b.stddev") * z)
    angle = F.radians(F.col("interval_index") * 360 / 96)
    rows = rows.select(
        "scenario", (F.col("interval_index") * 100_000 + F.col("n")).cast("long").alias("id"), (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("interval_index") * 15).cast("int"))).alias("datetime"),
        cluster.alias("cluster_num"), time.alias("travel_time"), "volume", F.cos(angle).alias("interval_cos"), F.sin(angle).alias("interval_sin"),
    ).where("travel_time > 0").withColumn("root4_travel_time", F.pow("travel_time", F.lit(0.25)))
    moved = speed.predict(rows).withColumnRenamed("predicted_velocity", "velocity")
    scored = accidents.transform(assemble(moved, ["velocity", *TIME], "logreg_features")).withColumn("_risk", vector_to_array("probability")[1])
    return scored.select("scenario", "id", "datetime", "cluster_num", "velocity", "travel_time", (uniform(7, "scenario", "datetime", "id") < F.col("_risk")).cast("int").alias("accident"))
