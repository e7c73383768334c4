import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.ml import PipelineModel

from cohorte.operators.encode import LabelVocabulary
from cohorte.plans import jobs as J
from cohorte.plans import kpis as K
from cohorte.schemas import MODEL_REGISTRY
from cohorte.sources import registry as R


def record(version, f1, day, kind="xgboost"):
    return {"model_type": kind, "version": version, "trained_at": datetime(2024, 1, 1) + timedelta(days=day), "metrics": {"test_f1_score": f1}}


def registry(spark, rows):
    full = [tuple((dict(r, path="p")).get(f.name) for f in MODEL_REGISTRY.fields) for r in rows]
    return spark.createDataFrame(full, MODEL_REGISTRY)


def test_served_versions(spark):
    reg = registry(spark, [record("v1", 0.80, 1), record("v2", 0.70, 2), record("v3", 0.76, 3), record("v4", 0.73, 4), record("w1", 0.1, 1, "neural_network")])
    got = {(r.model_type, r.version): (r.revertida, r.version_servida, r.ultima) for r in K.served_versions(reg).collect()}
    # v3 is compared with v1, which is served, not with v2, which was turned back
    assert got == {
        ("xgboost", "v1"): (False, "v1", False),
        ("xgboost", "v2"): (True, "v1", False),
        ("xgboost", "v3"): (False, "v3", False),
        ("xgboost", "v4"): (False, "v4", True),
        ("neural_network", "w1"): (False, "w1", True),
    }


def test_a_large_vocabulary_travels_with_its_model(spark, scratch):
    df = spark.createDataFrame([(f"v{i:04d}", "a") for i in range(300)], "z string, y string")
    words = os.path.join(scratch, "scratch")
    model = PipelineModel(stages=[LabelVocabulary(inputCols=["z", "y"], maxVocabulary=100, folder=words).fit(df)])
    root = os.path.join(scratch, "models")
    for v, f1, day in (("v1", 0.9, 1), ("v2", 0.5, 2)):
        R.save_model(spark, root, model, record(v, f1, day))
    want = sorted(map(tuple, model.transform(df).select("z", "z_encoded", "y_encoded").collect()))
    shutil.move(words, words + "-gone")
    latest, entry = R.load_latest(spark, root, "xgboost")
    assert entry["version"] == "v2"
    assert sorted(map(tuple, latest.transform(df).select("z", "z_encoded", "y_encoded").collect())) == want
    # what is served is what the decision says
    served, entry = J.load_served(spark, root, "xgboost")
    assert entry["version"] == "v1" and sorted(map(tuple, served.transform(df).select("z", "z_encoded", "y_encoded").collect())) == want
    with pytest.raises(FileNotFoundError):
        J.load_served(spark, root, "neural_network")
