"""A link model: logistic regression over standardised features, trained where the candidates are."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.vectors import unit


def link_scores(candidates: DataFrame, features: list[str], label: str, train: str) -> DataFrame:
    """The candidates with link_score, from a model fitted on the rows where train holds.

    Both classes weigh the same. Rows with a null feature score null.
    """
    whole = candidates.dropna(subset=features)
    assembled = VectorAssembler(inputCols=features, outputCol="_raw").transform(whole)
    fitting = assembled.filter(F.col(train)).withColumn("_y", F.col(label).cast("double"))
    sizes = fitting.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p")).first()
    n, p = sizes["n"] or 0, sizes["p"] or 0.0
    if not 0 < p < n:
        return candidates.withColumn("link_score", F.lit(None).cast("double"))
    weighed = fitting.withColumn("_w", F.when(F.col("_y") > 0, n / (2 * p)).otherwise(n / (2 * (n - p))))
    scaler = StandardScaler(withMean=True, inputCol="_raw", outputCol="_x").fit(fitting)
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=50).fit(scaler.transform(weighed))
    scored = model.transform(scaler.transform(assembled)).withColumn("link_score", vector_to_array("probability")[1])
    return scored.select(*candidates.columns, "link_score")


def plane(rows: DataFrame, key: str, vector: str, k: int = 3, reach: float = 3.0) -> DataFrame:
    """(key, coordinates): vectors projected to k principal axes, scaled so that the farthest lies at reach.

    The signs of axes are not determined. Vectors of another length than the first are left out, as are nulls.
    """
    size = rows.filter(F.size(vector) > 0).agg(F.mode(F.size(vector))).first()[0]
    shaped = rows.filter(F.size(vector) == F.lit(size)).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(shaped)
    flat = model.transform(shaped).select(key, vector_to_array("_p").alias("p"))
    means = flat.agg(*[F.avg(F.col("p")[i]).alias(f"m{i}") for i in range(k)]).first()
    centred = flat.select(key, F.array(*[F.col("p")[i] - F.lit(means[i]) for i in range(k)]).alias("p"))
    far = centred.agg(F.max(F.array_max(F.transform("p", F.abs)))).first()[0] or 1.0
    return centred.select(key, F.transform("p", lambda x: F.round(x * F.lit(reach / far), 6)).alias("coordinates"))


def pooled_vectors(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, n, vector): the mean of each group's vectors at length one; dimensions are averaged apart, so a
    group of any size is combined before the shuffle."""
    flat = rows.select(by, F.posexplode(vector).alias("i", "x"))
    means = flat.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    whole = means.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return whole.select(by, "n", unit("mean").alias("vector"))
