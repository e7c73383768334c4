"""Model training and evaluation (M1-M10), Spark ML throughout.

``prepare`` -> ``LabelVocabulary`` (M1/M2) -> [``PopulationScaler`` (M4)]
-> ``VectorAssembler`` -> ``GBTClassifier`` (M5) or
``MultilayerPerceptronClassifier`` (M6), or for M6 also the mini-batch
network of :mod:`cohorte.operators.network` (ReLU, dropout, Adam, a
validation part). The split (M3) is a hash, the
metrics (M7) are aggregates, the artefact goes through Spark ML
persistence plus a registry row (S8/M9).

The two model kinds play the reference's roles (gradient boosting /
neural network) with Spark's own algorithms; their numbers differ from the
reference by design.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorte.functions.numeric import above_threshold
from cohorte.operators.encode import LabelVocabulary
from cohorte.operators.graph import stored
from cohorte.operators.metrics import classification_metrics
from cohorte.operators.network import MiniBatchNetwork
from cohorte.operators.scale import PopulationScaler
from cohorte.operators.split import assign_split, train_test
from cohorte.schemas import CATEGORICAL_FEATURES, LABEL, MODEL_FEATURES, MODEL_TYPES, NUMERIC_FEATURES

MIN_ROWS = 10
KEY = "id_paciente"

# Rows that make a task of a fit worth its start, and rows that a task holds at most.
LEAST_ROWS, MOST_ROWS = 20_000, 500_000

# Hyper-parameters of the two model kinds.
GBT_PARAMS = dict(maxIter=100, maxDepth=6, stepSize=0.1, seed=42, minInstancesPerNode=20)
MLP_HIDDEN = [64, 32, 16]
MLP_PARAMS = dict(maxIter=50, seed=42, blockSize=32)


def prepare(features: DataFrame) -> DataFrame:
    """NULL/NaN in the nine numeric features -> 0; integer label."""
    cols = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in NUMERIC_FEATURES}
    out = features.withColumns(cols)
    return out.withColumn("label", F.col(LABEL).cast("double")) if LABEL in features.columns else out


#: How the network is trained: Spark ML's perceptron, or mini-batches in step.
LBFGS, MINIBATCH = "lbfgs", "minibatch"


def build_pipeline(model_type: str, loop: str = LBFGS) -> Pipeline:
    """The pipeline for a model type; unknown type -> error."""
    if model_type not in MODEL_TYPES:
        raise ValueError(f"tipo de modelo desconocido: {model_type}")
    enc = LabelVocabulary(inputCols=CATEGORICAL_FEATURES)
    if model_type == "xgboost":
        asm = VectorAssembler(inputCols=MODEL_FEATURES, outputCol="features")
        clf = GBTClassifier(featuresCol="features", labelCol="label", **GBT_PARAMS)
        return Pipeline(stages=[enc, asm, clf])
    scaled = [f"{c}_std" for c in MODEL_FEATURES]
    sc = PopulationScaler(inputCols=MODEL_FEATURES, suffix="_std")
    asm = VectorAssembler(inputCols=scaled, outputCol="features")
    if loop == MINIBATCH:
        return Pipeline(stages=[enc, sc, asm, MiniBatchNetwork(featuresCol="features", labelCol="label", idCol=KEY)])
    if loop != LBFGS:
        raise ValueError(f"entrenamiento desconocido: {loop}")
    clf = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="label", layers=[len(MODEL_FEATURES), *MLP_HIDDEN, 2], **MLP_PARAMS
    )
    return Pipeline(stages=[enc, sc, asm, clf])


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Probability of class 1 and the strict-threshold prediction (P10)."""
    out = model.transform(df)
    p = vector_to_array(F.col("probability"))[1]
    return out.withColumn("probabilidad", p).withColumn("prediccion", above_threshold(p, threshold))


@dataclass
class TrainingResult:
    model_type: str
    model: PipelineModel
    rows: int
    train_rows: int
    test_rows: int
    train_seconds: float
    metrics_train: dict
    metrics_test: dict
    architecture: dict = field(default_factory=dict)
    history: list = field(default_factory=list)

    def record(self, version: str) -> dict:
        """M9: the registry row."""
        from datetime import datetime, timezone

        metrics = {f"test_{k}": float(v) for k, v in self.metrics_test.items() if v is not None}
        metrics.update({f"train_{k}": float(v) for k, v in self.metrics_train.items() if v is not None})
        return {
            "model_type": self.model_type,
            "version": version,
            "trained_at": datetime.now(timezone.utc).replace(tzinfo=None),
            "rows": self.rows,
            "train_rows": self.train_rows,
            "test_rows": self.test_rows,
            "features": list(MODEL_FEATURES),
            "train_seconds": self.train_seconds,
            "metrics": metrics,
            "architecture": {k: str(v) for k, v in self.architecture.items()},
        }


def metrics_of(scored: DataFrame) -> DataFrame:
    return classification_metrics(scored, label="label", score="probabilidad", prediction="prediccion")


def evaluate(model: PipelineModel, df: DataFrame) -> DataFrame:
    return metrics_of(score(model, df))


def fit_tasks(rows: int, cores: int) -> int:
    """Tasks of one pass over the rows: one a core, fewer for few rows, more where a task would hold too many."""
    return max(1, min(cores, math.ceil(rows / LEAST_ROWS)), math.ceil(rows / MOST_ROWS))


def prepared(features: DataFrame) -> DataFrame:
    """The prepared rows, computed once and dealt evenly over the cores, in the shared checkpoint folder.

    Fitting makes hundreds of passes, each as long as its largest task: the parts that
    the feature table's joins leave are few and uneven. A lost executor re-reads its
    part instead of computing the joins again."""
    rows = stored(prepare(features), "preparado")
    tasks = fit_tasks(rows.count(), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, F.col(KEY)).sortWithinPartitions(KEY).checkpoint(eager=True)


def train(features: DataFrame, model_type: str, test_fraction: float = 0.2, seed: int = 42, loop: str = LBFGS) -> TrainingResult:
    """M5/M6/M7/M8: fit on the hash-split train part, evaluate both parts."""
    return train_prepared(prepared(features), model_type, test_fraction, seed, loop)


def train_prepared(data: DataFrame, model_type: str, test_fraction: float = 0.2, seed: int = 42, loop: str = LBFGS) -> TrainingResult:
    """:func:`train` on the rows of :func:`prepared`, which several models may share."""
    if data.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError(f"Dataset muy pequeño para entrenar (mínimo {MIN_ROWS} registros)")
    # the vocabulary is that of all rows (a category may be absent from the train part)
    start = time.time()
    enc, *rest = build_pipeline(model_type, loop).getStages()
    encoder = enc.fit(data)
    train_df, _ = train_test(data, KEY, test_fraction, seed)
    fitted = Pipeline(stages=rest).fit(encoder.transform(train_df))
    model = PipelineModel(stages=[encoder, *fitted.stages])
    seconds = time.time() - start
    # every row is scored once, for the counts and the AUC of both parts
    scored = score(model, assign_split(data, KEY, test_fraction, seed)).select("conjunto", "label", "probabilidad", "prediccion")
    scored = stored(scored, "evaluacion")
    m_train, m_test = (metrics_of(scored.where(F.col("conjunto") == part)).first().asDict() for part in ("train", "test"))
    arch = dict(GBT_PARAMS) if model_type == "xgboost" else {"layers": [len(MODEL_FEATURES), *MLP_HIDDEN, 2], **MLP_PARAMS}
    history = []
    if model_type != "xgboost" and loop == MINIBATCH:
        net = rest[-1]
        arch = {p.name: net.getOrDefault(p) for p in net.params if net.isDefined(p)}
        history = model.stages[-1].get_history()
    return TrainingResult(
        model_type, model, int(m_train["n"] + m_test["n"]), int(m_train["n"]), int(m_test["n"]), seconds, m_train, m_test, arch, history
    )
