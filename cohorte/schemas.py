"""Declared schemas (S10). Nothing is inferred at run time.

The three clinical tables keep the reference's column names (Spanish):
``paciente`` (patient), ``consulta`` (visit), ``laboratorio`` (lab result).
Constraints become checks in :mod:`cohorte.operators.quality`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PACIENTE = T.StructType(
    [
        T.StructField("id_paciente", T.StringType(), False),
        T.StructField("sexo", T.StringType(), False),
        T.StructField("edad", T.IntegerType(), False),
        T.StructField("zona_residencia", T.StringType(), True),
        T.StructField("fecha_dx", T.DateType(), False),
        T.StructField("tipo_cancer", T.StringType(), False),
        T.StructField("estadio", T.StringType(), False),
        T.StructField("aseguradora", T.StringType(), False),
        T.StructField("adherencia_12m", T.BooleanType(), False),
    ]
)

CONSULTA = T.StructType(
    [
        T.StructField("id_consulta", T.StringType(), False),
        T.StructField("fecha_consulta", T.DateType(), False),
        T.StructField("motivo", T.StringType(), False),
        T.StructField("prioridad", T.StringType(), False),
        T.StructField("especialista", T.StringType(), False),
        T.StructField("id_paciente", T.StringType(), False),
    ]
)

LABORATORIO = T.StructType(
    [
        T.StructField("id_lab", T.StringType(), False),
        T.StructField("fecha_muestra", T.DateType(), False),
        T.StructField("tipo_prueba", T.StringType(), False),
        T.StructField("resultado", T.StringType(), True),
        T.StructField("resultado_numerico", T.DoubleType(), True),
        T.StructField("unidad", T.StringType(), True),
        T.StructField("id_paciente", T.StringType(), False),
    ]
)


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    key: str
    parent_key: str | None  # foreign key to paciente, None for the parent
    date_columns: tuple[str, ...]

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]


TABLES: dict[str, TableSpec] = {
    "paciente": TableSpec("paciente", PACIENTE, "id_paciente", None, ("fecha_dx",)),
    "consulta": TableSpec("consulta", CONSULTA, "id_consulta", "id_paciente", ("fecha_consulta",)),
    "laboratorio": TableSpec(
        "laboratorio", LABORATORIO, "id_lab", "id_paciente", ("fecha_muestra",)
    ),
}

# Raw sheets arrive as text: every cell is a string until parsed.
def raw_schema(spec: TableSpec) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in spec.schema.fields])


# Feature table (Q4), 16 columns in this order, plus id_paciente kept first.
FEATURE_COLUMNS: list[str] = [
    "sexo",
    "edad",
    "zona_residencia",
    "tipo_cancer",
    "estadio",
    "aseguradora",
    "count_consultas",
    "dias_desde_diagnostico",
    "count_laboratorios",
    "avg_resultado_numerico",
    "avg_biopsia",
    "avg_vph",
    "avg_marcador_ca125",
    "avg_psa",
    "avg_colonoscopia",
    "adherencia_12m",
]

FEATURES = T.StructType(
    [
        T.StructField("id_paciente", T.StringType(), False),
        T.StructField("sexo", T.StringType(), True),
        T.StructField("edad", T.IntegerType(), True),
        T.StructField("zona_residencia", T.StringType(), True),
        T.StructField("tipo_cancer", T.StringType(), True),
        T.StructField("estadio", T.StringType(), True),
        T.StructField("aseguradora", T.StringType(), True),
        T.StructField("count_consultas", T.LongType(), True),
        T.StructField("dias_desde_diagnostico", T.IntegerType(), True),
        T.StructField("count_laboratorios", T.LongType(), True),
        T.StructField("avg_resultado_numerico", T.DoubleType(), True),
        T.StructField("avg_biopsia", T.DoubleType(), True),
        T.StructField("avg_vph", T.DoubleType(), True),
        T.StructField("avg_marcador_ca125", T.DoubleType(), True),
        T.StructField("avg_psa", T.DoubleType(), True),
        T.StructField("avg_colonoscopia", T.DoubleType(), True),
        T.StructField("adherencia_12m", T.IntegerType(), True),
    ]
)

# Model inputs (P11): 9 numeric features then 2 encoded categories, fixed order.
NUMERIC_FEATURES: list[str] = [
    "edad",
    "count_consultas",
    "count_laboratorios",
    "avg_resultado_numerico",
    "avg_biopsia",
    "avg_vph",
    "avg_marcador_ca125",
    "avg_psa",
    "avg_colonoscopia",
]
CATEGORICAL_FEATURES: list[str] = ["zona_residencia", "tipo_cancer"]
ENCODED_FEATURES: list[str] = [f"{c}_encoded" for c in CATEGORICAL_FEATURES]
MODEL_FEATURES: list[str] = NUMERIC_FEATURES + ENCODED_FEATURES
LABEL = "adherencia_12m"

# Prediction log row.
PREDICTION_LOG = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("request_id", T.StringType(), True),
        T.StructField("model_version", T.StringType(), True),
        T.StructField("prediction", T.IntegerType(), True),
        T.StructField("probability", T.DoubleType(), True),
        T.StructField("inference_time_ms", T.DoubleType(), True),
        T.StructField("success", T.BooleanType(), True),
        T.StructField("error_message", T.StringType(), True),
        T.StructField(
            "input_features",
            T.StructType(
                [T.StructField(c, T.DoubleType(), True) for c in NUMERIC_FEATURES]
                + [T.StructField(c, T.StringType(), True) for c in CATEGORICAL_FEATURES]
                + [T.StructField("tipo_modelo", T.StringType(), True)]
            ),
            True,
        ),
    ]
)

# Model registry row.
MODEL_REGISTRY = T.StructType(
    [
        T.StructField("model_type", T.StringType(), False),
        T.StructField("version", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("trained_at", T.TimestampType(), False),
        T.StructField("rows", T.LongType(), True),
        T.StructField("train_rows", T.LongType(), True),
        T.StructField("test_rows", T.LongType(), True),
        T.StructField("features", T.ArrayType(T.StringType()), True),
        T.StructField("train_seconds", T.DoubleType(), True),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()), True),
        T.StructField("architecture", T.MapType(T.StringType(), T.StringType()), True),
    ]
)

MODEL_TYPES = ("xgboost", "neural_network")
