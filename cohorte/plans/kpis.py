"""Second-tier analytics described (not coded) by the reference.

Signature: ``(paciente, consulta, laboratorio, as_of, **params) -> DataFrame``
where a table is needed. All are plain aggregations and joins; children
are aggregated per patient before any join, as in the main queries.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorte.functions.labels import as_of_lit, days_between
from cohorte.functions.numeric import nan_to_null, round_to
from cohorte.functions.text import contains_any, harmonise_key, normalise_text
from cohorte.operators.asof import BACKWARD, FORWARD, asof_join
from cohorte.operators.graph import stored
from cohorte.operators.metrics import confusion, metric_columns
from cohorte.operators.rollup import KEY
from cohorte.operators.variants import unified, variant_map

# Early stages (X10), adherence goal (X9), treatment-delay
# goal in days (X11), abandonment horizon in months (X13), rollback ratio
# (X18), live-metric alert thresholds.
EARLY_STAGES = ("I", "Ii")
ADHERENCE_GOAL = 0.80
TREATMENT_GOAL_DAYS = 30
ABANDON_MONTHS = 6
ROLLBACK_RATIO = 0.95
ALERT_THRESHOLDS = {"accuracy": 0.70, "f1_score": 0.70}


def _adherent(c: str = "adherencia_12m") -> Column:
    return F.col(c).cast("int").cast("double")


def cancer_type_detail(paciente: DataFrame, consulta: DataFrame, laboratorio: DataFrame, tipo: str | None = None) -> DataFrame:
    """Per cancer type (or one type): patients, adherence rate, mean age,
    early-stage share, visits and labs per patient."""
    p = paciente if tipo is None else paciente.where(F.col("tipo_cancer") == tipo)
    v = consulta.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_consultas"))
    lab = laboratorio.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_laboratorios"))
    j = p.join(v, KEY, "left").join(lab, KEY, "left")
    return j.groupBy("tipo_cancer").agg(
        F.count(F.lit(1)).alias("pacientes"),
        round_to(F.avg(_adherent()), 4).alias("tasa_adherencia"),
        round_to(F.avg("edad"), 2).alias("edad_media"),
        round_to(F.avg(normalise_text("estadio").isin(*EARLY_STAGES).cast("double")), 4).alias("proporcion_etapa_temprana"),
        round_to(F.avg(F.coalesce("n_consultas", F.lit(0))), 4).alias("consultas_por_paciente"),
        round_to(F.avg(F.coalesce("n_laboratorios", F.lit(0))), 4).alias("laboratorios_por_paciente"),
    )


def split_by(paciente: DataFrame, by: str, dims: tuple[str, ...]) -> DataFrame:
    """Patients and adherence per (group, dimension, value): the
    dimensions are unpivoted so all splits share one aggregation."""
    stacked = paciente.select(
        F.col(by),
        _adherent().alias("_a"),
        F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("valor")) for d in dims])).alias("s"),
    )
    return stacked.groupBy(by, "s.dimension", "s.valor").agg(
        F.count(F.lit(1)).alias("pacientes"), round_to(F.avg("_a"), 4).alias("tasa_adherencia")
    )


def recently_active(paciente: DataFrame, consulta: DataFrame, laboratorio: DataFrame, as_of: date | str | None, days: int = 90) -> DataFrame:
    """Patients with a visit or a lab in the ``days`` before ``as_of``."""
    since = F.date_sub(as_of_lit(as_of), days)
    # distinct first: a hot patient's recent rows collapse map-side, so the
    # semi-join's build side holds each patient once (AQE cannot split a
    # skewed build side)
    touched = (
        consulta.where(F.col("fecha_consulta") >= since).select(KEY)
        .unionByName(laboratorio.where(F.col("fecha_muestra") >= since).select(KEY))
        .distinct()
    )
    return paciente.join(touched, KEY, "left_semi")


def patient_lab_analysis(laboratorio: DataFrame, patient: str | None = None) -> DataFrame:
    """Per patient (or one patient) and test type: count, numeric mean,
    first and last sample."""
    lab = laboratorio if patient is None else laboratorio.where(F.col(KEY) == patient)
    return lab.groupBy(KEY, "tipo_prueba").agg(
        F.count(F.lit(1)).alias("pruebas"),
        round_to(F.avg(F.nanvl("resultado_numerico", F.lit(None).cast("double"))), 4).alias("promedio_resultado"),
        F.min("fecha_muestra").alias("primera"),
        F.max("fecha_muestra").alias("ultima"),
    )


def patients_by_type(paciente: DataFrame) -> DataFrame:
    """X5a."""
    return paciente.groupBy("tipo_cancer").agg(F.count(F.lit(1)).alias("pacientes"))


def _distinct(c: str, approx: bool) -> Column:
    """A4: exact distinct count, or the HyperLogLog++ sketch (mergeable,
    bounded memory per group, ~2 % error) when ``approx``."""
    return F.approx_count_distinct(c) if approx else F.count_distinct(c)


def visits_by_month(consulta: DataFrame, approx: bool = False) -> DataFrame:
    """X5b."""
    m = F.trunc("fecha_consulta", "month").alias("mes")
    return consulta.groupBy(m).agg(F.count(F.lit(1)).alias("consultas"), _distinct(KEY, approx).alias("pacientes"))


def lab_means_by_month(laboratorio: DataFrame) -> DataFrame:
    """Mean numeric result per test type and month."""
    m = F.trunc("fecha_muestra", "month").alias("mes")
    return laboratorio.groupBy("tipo_prueba", m).agg(
        F.count(F.lit(1)).alias("pruebas"),
        round_to(F.avg(F.nanvl("resultado_numerico", F.lit(None).cast("double"))), 4).alias("promedio_resultado"),
    )


def adherence_goal(paciente: DataFrame, goal: float = ADHERENCE_GOAL) -> DataFrame:
    """Global adherence rate against the goal."""
    rate = F.avg(_adherent())
    return paciente.agg(
        F.count(F.lit(1)).alias("pacientes"),
        round_to(rate, 4).alias("tasa_adherencia"),
        F.lit(goal).alias("meta"),
        (rate >= F.lit(goal)).alias("cumple_meta"),
    )


def early_stage_share(paciente: DataFrame) -> DataFrame:
    """Share of patients in stage I-II (after text normalisation)."""
    early = normalise_text("estadio").isin(*EARLY_STAGES).cast("double")
    return paciente.agg(F.count(F.lit(1)).alias("pacientes"), round_to(F.avg(early), 4).alias("proporcion_etapa_temprana"))


def time_to_treatment(
    paciente: DataFrame, consulta: DataFrame, reasons: tuple[str, ...] | None = None, goal_days: int = TREATMENT_GOAL_DAYS
) -> DataFrame:
    """X11: days from diagnosis to the first visit on or after it (visits
    with a reason in ``reasons`` only, when given)."""
    v = consulta if reasons is None else consulta.where(F.col("motivo").isin(*reasons))
    dx = paciente.select(KEY, "fecha_dx")
    out = asof_join(dx, v.select(KEY, "fecha_consulta"), KEY, "fecha_dx", "fecha_consulta", {"fecha_consulta": "primera_consulta"}, FORWARD)
    days = days_between("primera_consulta", "fecha_dx")
    return out.select(
        KEY, "fecha_dx", "primera_consulta", days.alias("dias_a_tratamiento"),
        F.coalesce(days < goal_days, F.lit(False)).alias("dentro_meta"),
    )


def visits_with_last_lab(consulta: DataFrame, laboratorio: DataFrame, test: tuple[str, ...] = (), within_days: int | None = None) -> DataFrame:
    """Each visit with the patient's last numeric result on or before its day
    (of tests that name a word of ``test``, when given): what the specialist
    could know. Of several results of a day the least counts."""
    value = nan_to_null("resultado_numerico")
    labs = laboratorio.where(value.isNotNull())
    if test:
        labs = labs.where(contains_any("tipo_prueba", test))
    labs = labs.select(KEY, "fecha_muestra", value.alias("resultado_numerico"))
    out = asof_join(
        consulta.select("id_consulta", KEY, "fecha_consulta"), labs, KEY, "fecha_consulta", "fecha_muestra",
        {"resultado_numerico": "ultimo_resultado", "fecha_muestra": "fecha_resultado"}, BACKWARD, within_days,
    )
    return out.withColumn("dias_desde_resultado", days_between("fecha_consulta", "fecha_resultado"))


def visits_by_specialist(consulta: DataFrame, approx: bool = False) -> DataFrame:
    """X12."""
    return consulta.groupBy("especialista").agg(
        F.count(F.lit(1)).alias("consultas"), _distinct(KEY, approx).alias("pacientes")
    )


def abandonment(paciente: DataFrame, consulta: DataFrame, months: int = ABANDON_MONTHS) -> DataFrame:
    """No visit, or the last visit less than ``months`` after diagnosis."""
    last = consulta.groupBy(KEY).agg(F.max("fecha_consulta").alias("ultima_consulta"))
    j = paciente.select(KEY, "fecha_dx").join(last, KEY, "left")
    gone = F.col("ultima_consulta").isNull() | (F.col("ultima_consulta") < F.add_months("fecha_dx", months))
    return j.select(KEY, "fecha_dx", "ultima_consulta", gone.alias("abandono"))


def service_use(consulta: DataFrame, laboratorio: DataFrame) -> DataFrame:
    """Per patient, counts per visit reason and per test type (long
    format, so the categories need not be known in advance)."""
    v = consulta.select(KEY, F.lit("motivo").alias("fuente"), F.coalesce("motivo", F.lit("(sin dato)")).alias("categoria"))
    lab = laboratorio.select(KEY, F.lit("tipo_prueba").alias("fuente"), F.col("tipo_prueba").alias("categoria"))
    return v.unionByName(lab).groupBy(KEY, "fuente", "categoria").agg(F.count(F.lit(1)).alias("n"))


def usage_clusters(features: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """K-Means on standardised usage features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    from cohorte.operators.scale import PopulationScaler

    cols = ["count_consultas", "count_laboratorios", "avg_resultado_numerico"]
    data = features.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    pipe = Pipeline(stages=[
        PopulationScaler(inputCols=cols, suffix="_std"),
        VectorAssembler(inputCols=[f"{c}_std" for c in cols], outputCol="uso"),
        KMeans(featuresCol="uso", predictionCol="cluster", k=k, seed=seed),
    ])
    return pipe.fit(data).transform(data).select(KEY, *cols, "cluster")


def population_stability(expected: DataFrame, actual: DataFrame, columns: list[str], bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """PSI per feature between a reference sample and a new one:
    ``sum((a - e) * ln(a / e))`` over ``bins`` equal-width bins spanning the
    reference range (values outside fall in the end bins), shares floored
    at ``eps``."""
    rng = expected.agg(*[x for c in columns for x in (F.min(F.col(c).cast("double")).alias(f"lo_{c}"), F.max(F.col(c).cast("double")).alias(f"hi_{c}"))])

    r = rng.first()  # two numbers per column reach the driver

    def cells(df: DataFrame, side: str) -> DataFrame:
        """Every value's bin, all columns in one pass."""
        out = []
        for c in columns:
            x, lo, hi = F.col(c).cast("double"), r[f"lo_{c}"], r[f"hi_{c}"]
            bucket = F.lit(0)
            if hi is not None and hi > lo:
                bucket = F.least(F.greatest(F.floor((x - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1))
            out.append(F.when(x.isNotNull(), F.struct(F.lit(c).alias("campo"), bucket.cast("int").alias("bin"))))
        return df.select(F.explode(F.array_compact(F.array(*out))).alias("s")).select("s.campo", "s.bin", F.lit(side).alias("lado"))

    both = cells(expected, "e").union(cells(actual, "a"))
    counts = both.groupBy("campo", "bin").agg(*(F.count_if(F.col("lado") == k).alias(k) for k in ("e", "a")))
    per = Window.partitionBy("campo")  # at most ``bins`` rows a column
    share = lambda k: F.greatest(F.coalesce(F.col(k) / F.nullif(F.sum(k).over(per), F.lit(0)), F.lit(0.0)), F.lit(eps))
    shares = counts.select("campo", share("e").alias("e"), share("a").alias("a"))  # a bin empty on both sides adds 0
    psi = shares.groupBy("campo").agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))
    names = expected.sparkSession.createDataFrame([(c,) for c in columns], "campo string")
    return names.join(psi, "campo", "left").select("campo", round_to(F.coalesce("psi", F.lit(0.0)), 6).alias("psi"))


def drift_against_log(train_features: DataFrame, log: DataFrame, columns: list[str] | None = None, bins: int = 10) -> DataFrame:
    """X17 as described: PSI of each numeric model input between the
    training data and the requests recorded in the prediction log."""
    from cohorte.schemas import NUMERIC_FEATURES

    cols = columns or NUMERIC_FEATURES
    served = log.where(F.col("success")).select("input_features.*").select(*cols)
    return population_stability(train_features.select(*cols), served, cols, bins)


def rollback_decision(registry: DataFrame, metric: str = "test_f1_score", ratio: float = ROLLBACK_RATIO) -> DataFrame:
    """Per model type, compare the newest version with the previous
    one; roll back when new < ratio * previous."""
    w = Window.partitionBy("model_type").orderBy(F.col("trained_at").desc())
    ranked = registry.select("model_type", "version", "trained_at", F.col("metrics")[metric].alias("m")).withColumn(
        "r", F.row_number().over(w)
    ).where("r <= 2")
    g = ranked.groupBy("model_type").agg(
        F.max(F.when(F.col("r") == 1, F.col("version"))).alias("version_nueva"),
        F.max(F.when(F.col("r") == 1, F.col("m"))).alias("metrica_nueva"),
        F.max(F.when(F.col("r") == 2, F.col("version"))).alias("version_actual"),
        F.max(F.when(F.col("r") == 2, F.col("m"))).alias("metrica_actual"),
    )
    roll = F.col("metrica_actual").isNotNull() & (F.col("metrica_nueva") < F.lit(ratio) * F.col("metrica_actual"))
    return g.withColumn("revertir", F.coalesce(roll, F.lit(False))).withColumn(
        "version_servida", F.when(F.col("revertir"), F.col("version_actual")).otherwise(F.col("version_nueva"))
    )


def served_versions(registry: DataFrame, metric: str = "test_f1_score", ratio: float = ROLLBACK_RATIO) -> DataFrame:
    """X18 applied over a registry's whole history: a version is served from its
    training on unless its metric is below ``ratio`` times that of the version
    served then. Per type and version: the version served after it
    (``version_servida``), and whether it was turned back (``revertida``).

    One row per training, in order of time (ties by version); a version without
    the metric is turned back unless it is the first."""
    runs = registry.groupBy("model_type").agg(F.array_sort(F.collect_list(F.struct("trained_at", "version", F.col("metrics")[metric].alias("m")))).alias("v"))
    one = "named_struct('version', x.version, 'revertida', {back}, 'servida', {v}, 'm', {m})"
    good = f"x.m >= {float(ratio)}D * a[size(a) - 1].m OR (a[size(a) - 1].m IS NULL AND x.m IS NOT NULL)"
    step = (
        f"CASE WHEN size(a) = 0 THEN {one.format(back='false', v='x.version', m='x.m')} "
        f"WHEN coalesce({good}, false) THEN {one.format(back='false', v='x.version', m='x.m')} "
        f"ELSE {one.format(back='true', v='a[size(a) - 1].servida', m='a[size(a) - 1].m')} END"
    )
    empty = "CAST(array() AS ARRAY<STRUCT<version: STRING, revertida: BOOLEAN, servida: STRING, m: DOUBLE>>)"
    told = runs.select("model_type", F.explode(F.expr(f"aggregate(v, {empty}, (a, x) -> concat(a, array({step})))")).alias("s"), "v")
    return told.select("model_type", F.col("s.version").alias("version"), F.col("s.revertida").alias("revertida"), F.col("s.servida").alias("version_servida"), (F.element_at("v", -1)["version"] == F.col("s.version")).alias("ultima"))


def harmonisation_map(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spelling variants grouped by a stripped, accent-folded,
    lower-case key; the canonical spelling is the most frequent variant
    (ties -> lowest). One aggregation over all columns."""
    stacked = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).cast("string").alias("valor")) for c in columns])).alias("s")
    ).select("s.campo", "s.valor").where(F.col("valor").isNotNull())
    counts = stacked.groupBy("campo", "valor").agg(F.count(F.lit(1)).alias("n")).withColumn("clave", harmonise_key("valor"))
    w = Window.partitionBy("campo", "clave").orderBy(F.col("n").desc(), F.col("valor"))
    canon = counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        "campo", "clave", normalise_text("valor").alias("canonico")
    )
    return counts.join(canon, ["campo", "clave"]).select("campo", "valor", "clave", "canonico", "n")


def harmonised(df: DataFrame, columns: list[str], variants: bool = False) -> DataFrame:
    """X19 applied: every value of ``columns`` in the canonical spelling of its
    variants, with ``variants`` also typing errors and abbreviations
    (:mod:`cohorte.operators.variants`). The map is made once for all columns."""
    return unified(df, columns, variant_map(df, columns) if variants else stored(harmonisation_map(df, columns), "mapa"))


def live_quality(scored: DataFrame, labels: DataFrame, key: str = KEY, thresholds: dict | None = None) -> DataFrame:
    """Scored requests joined to the labels known later (by key) ->
    A16 metrics and an alert flag per threshold."""
    th = thresholds or ALERT_THRESHOLDS
    j = scored.select(key, F.col("prediccion").alias("prediction")).join(labels.select(key, F.col("adherencia_12m").alias("label")), key)
    c = confusion(j)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    m = c.select((tp + fp + tn + fn).alias("n"), *metric_columns(tp, fp, tn, fn))
    return m.withColumns({f"alerta_{k}": F.col(k) < F.lit(v) for k, v in th.items()})


def anonymise(df: DataFrame, salt: str, columns: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Salted SHA-256 of the identifier columns."""
    return df.withColumns({c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256) for c in columns})
