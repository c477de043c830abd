"""Estimators that Spark ML already distributes: regression, forest, network, PCA, mixtures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

SEED = 17


def _reused(df: DataFrame) -> DataFrame:
    """Estimators pass over their rows many times: keep them, spilling to disk."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def lag_features(df: DataFrame, col: str, lags: Sequence[int], keys: Sequence[str] = ("series_id",)) -> tuple[DataFrame, list[str]]:
    from strandline.frames import ordered

    names = [f"{col}_lag{k}" for k in lags]
    out = df.select("*", *[F.lag(col, k).over(ordered(keys)).alias(n) for k, n in zip(lags, names)])
    return out, names


def elastic_net(df: DataFrame, label: str, features: Sequence[str], is_train: Column, reg: Sequence[float] = (0.0,), mix: Sequence[float] = (0.0,), folds: int = 3) -> DataFrame:
    """Linear model on training rows, penalty by cross-validation, predictions on the rest."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = _reused(df.dropna(subset=[label, *features]))
    stages = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows)
    lr = LinearRegression(featuresCol="_x", labelCol=label, predictionCol="forecast", standardization=True)
    train = stages.filter(is_train)
    if len(reg) * len(mix) == 1:
        model = lr.setParams(regParam=float(reg[0]), elasticNetParam=float(mix[0])).fit(train)
    else:
        grid = ParamGridBuilder().addGrid(lr.regParam, list(reg)).addGrid(lr.elasticNetParam, list(mix)).build()
        ev = RegressionEvaluator(labelCol=label, predictionCol="forecast", metricName="mae")
        model = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=ev, numFolds=folds, seed=SEED).fit(train).bestModel
    return model.transform(stages.filter(~is_train)).drop("_x")


def _class_pipeline(categorical: Sequence[str], numeric: Sequence[str], label: str):
    idx = [StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep") for c in categorical]
    enc = [OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_h_{c}" for c in categorical])] if categorical else []
    asm = VectorAssembler(inputCols=[*[f"_h_{c}" for c in categorical], *numeric], outputCol="_x", handleInvalid="skip")
    return [*idx, *enc, asm]


def forest_classifier(df: DataFrame, label: str, categorical: Sequence[str], numeric: Sequence[str], is_train: Column, trees: int = 50) -> DataFrame:
    """Random forest on coded states and numbers; class and chance of class one on test rows."""
    from pyspark.ml.classification import RandomForestClassifier

    rows = _reused(df.dropna(subset=[label, *categorical, *numeric]))
    rf = RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, seed=SEED, predictionCol="predicted", probabilityCol="_p", rawPredictionCol="_raw")
    model = Pipeline(stages=[*_class_pipeline(categorical, numeric, label), rf]).fit(rows.filter(is_train))
    out = model.transform(rows.filter(~is_train))
    return out.withColumn("probability", F.get(vector_to_array("_p"), F.lit(1))).drop(*[c for c in out.columns if c.startswith("_")])


def network_classifier(df: DataFrame, label: str, features: Sequence[str], is_train: Column, hidden: Sequence[int] = (8,), iterations: int = 60) -> DataFrame:
    """Multilayer perceptron on numeric features; class and chance of class one on test rows."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    rows = _reused(df.dropna(subset=[label, *features]))
    mlp = MultilayerPerceptronClassifier(
        featuresCol="_x", labelCol=label, layers=[len(features), *hidden, 2], maxIter=iterations, seed=SEED, predictionCol="predicted", probabilityCol="_p", rawPredictionCol="_raw"
    )
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), mlp]).fit(rows.filter(is_train))
    out = model.transform(rows.filter(~is_train))
    return out.withColumn("probability", F.get(vector_to_array("_p"), F.lit(1))).drop("_x", "_p", "_raw")


def principal_components(df: DataFrame, array_col: str, k: int) -> DataFrame:
    """Loadings per component with the share of variance it explains.  Signs are fixed so that the largest loading is positive."""
    from pyspark.ml.feature import PCA

    model = PCA(k=k, inputCol="_x", outputCol="_y").fit(_reused(df.select(array_to_vector(F.col(array_col)).alias("_x"))))
    pc, ev = model.pc.toArray(), model.explainedVariance.toArray()
    spark = df.sparkSession
    rows = []
    for j in range(k):  # k components of a fixed number of variables
        v = pc[:, j]
        v = v if abs(v.max()) >= abs(v.min()) else -v
        rows += [(j + 1, i, float(x), float(ev[j])) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "component int, variable int, loading double, explained double")


def correlation_matrix_ml(df: DataFrame, array_col: str) -> DataFrame:
    """Correlations (i, j) of a vector column by a distributed Gram matrix; for many columns."""
    from pyspark.ml.stat import Correlation

    m = Correlation.corr(df.select(array_to_vector(F.col(array_col)).alias("_x")), "_x")
    mat = m.collect()[0][0].toArray()  # variables x variables, not data
    rows = [(i, j, float(mat[i, j])) for i in range(mat.shape[0]) for j in range(i, mat.shape[1])]
    return df.sparkSession.createDataFrame(rows, "i int, j int, corr double")


def mixture_regimes(df: DataFrame, features: Sequence[str], k: int = 2) -> DataFrame:
    """Posterior probability of each component, ordered by the mean of the first feature."""
    from pyspark.ml.clustering import GaussianMixture

    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(_reused(df.dropna(subset=list(features))))
    model = GaussianMixture(featuresCol="_x", k=k, seed=SEED, predictionCol="_c", probabilityCol="_p", maxIter=50).fit(rows)
    order = sorted(range(k), key=lambda i: float(model.gaussians[i].mean[0]))
    out = model.transform(rows)
    p = vector_to_array("_p")
    return out.select(*df.columns, *[F.get(p, F.lit(i)).alias(f"p{j}") for j, i in enumerate(order)])


def two_means(df: DataFrame, features: Sequence[str], k: int = 2) -> DataFrame:
    from pyspark.ml.clustering import KMeans

    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(_reused(df.dropna(subset=list(features))))
    model = KMeans(featuresCol="_x", k=k, seed=SEED, predictionCol="_c").fit(rows)
    order = sorted(range(k), key=lambda i: float(model.clusterCenters()[i][0]))
    label = F.create_map(*[F.lit(x) for j, i in enumerate(order) for x in (i, j)])
    return model.transform(rows).withColumn("cluster", label[F.col("_c")]).select(*df.columns, "cluster")
