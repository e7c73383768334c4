"""Label encoding (M1, M2, J7) and the hashed fallback code.

The vocabulary of a category is its sorted distinct values, coded 0..n-1; an
unseen value gets 0. The numbering is made per range of values plus the counts
of the ranges before, so no task holds a whole vocabulary. A vocabulary of up to
``maxVocabulary`` values becomes a literal map inside codegen (no join); a
larger one stays a table that the transform joins.
"""

from __future__ import annotations

import json
import uuid

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorte.operators.order_stats import RANGE, below, range_offsets, written_ranges
from cohorte.session import scratch_path

# a vocabulary becomes a literal map inside generated code: keep it small;
# a larger one is joined
MAX_VOCABULARY = 10_000


def _distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = [
        df.select(F.lit(c).alias("campo"), F.col(c).cast("string").alias("valor")).where(F.col("valor").isNotNull())
        for c in columns
    ]
    vals = parts[0]
    for p in parts[1:]:
        vals = vals.unionByName(p)
    return vals.distinct()


def vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    """M1 as a DataFrame: (campo, valor, codigo) with codes in sorted order, at any size."""
    ranged = written_ranges(_distinct_values(df, columns).withColumn("uno", F.lit(1)), "campo", "valor")
    placed = ranged.withColumn("_bajo", below(ranged, ["campo"], "valor", "uno"))
    numbered = placed.join(range_offsets(ranged, ["campo"], "uno"), ["campo", RANGE])
    return numbered.select("campo", "valor", (F.col("_antes") + F.col("_bajo")).cast("int").alias("codigo"))


class LabelVocabulary(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    inputCols = Param(Params._dummy(), "inputCols", "category columns", TypeConverters.toListString)
    suffix = Param(Params._dummy(), "suffix", "output column suffix", TypeConverters.toString)
    maxVocabulary = Param(Params._dummy(), "maxVocabulary", "largest vocabulary kept in the plan", TypeConverters.toInt)
    folder = Param(Params._dummy(), "folder", "where larger vocabularies are written (default: the scratch folder)", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None, suffix: str = "_encoded", maxVocabulary: int = MAX_VOCABULARY, folder: str = ""):
        super().__init__()
        self._setDefault(inputCols=[], suffix="_encoded", maxVocabulary=MAX_VOCABULARY, folder="")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "LabelVocabularyModel":
        cols = self.getOrDefault(self.inputCols)
        limit = self.getOrDefault(self.maxVocabulary)
        folder = self.getOrDefault(self.folder) or scratch_path(df.sparkSession, f"vocabularios-{uuid.uuid4().hex[:12]}")
        vocabulary(df, cols).write.mode("overwrite").parquet(folder)
        words = df.sparkSession.read.parquet(folder)
        # size first (one number per column), values only where they are few
        sizes = {r["campo"]: r["n"] for r in words.groupBy("campo").agg(F.count(F.lit(1)).alias("n")).collect()}
        small = [c for c in cols if sizes.get(c, 0) <= limit]
        mapping: dict[str, list[str]] = {c: [] for c in small}
        for r in words.where(F.col("campo").isin(small)).orderBy("campo", "codigo").collect():
            mapping[r["campo"]].append(r["valor"])
        tables = {c: folder for c in cols if c not in mapping}
        return self._copyValues(LabelVocabularyModel(vocabularies=json.dumps(mapping), tables=json.dumps(tables)))


class LabelVocabularyModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    vocabularies = Param(Params._dummy(), "vocabularies", "JSON {column: [values in code order]}", TypeConverters.toString)
    inputCols = LabelVocabulary.inputCols
    suffix = LabelVocabulary.suffix
    tables = Param(Params._dummy(), "tables", "JSON {column: folder of its vocabulary}, for joined ones", TypeConverters.toString)
    maxVocabulary = LabelVocabulary.maxVocabulary
    folder = LabelVocabulary.folder

    @keyword_only
    def __init__(self, vocabularies: str = "{}", tables: str = "{}"):
        super().__init__()
        self._setDefault(vocabularies="{}", tables="{}", suffix="_encoded", inputCols=[], maxVocabulary=MAX_VOCABULARY, folder="")
        self._set(**self._input_kwargs)

    def get_vocabularies(self) -> dict[str, list[str]]:
        return json.loads(self.getOrDefault(self.vocabularies))

    def code(self, column: str) -> Column:
        """The column's code; F14's hash code if the model has no vocabulary for it."""
        values = self.get_vocabularies().get(column)
        if values is None:
            return hash_bucket(column)
        if not values:
            return F.lit(0)
        lookup = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
        # M2: unseen (or NULL) value -> 0, the code of the first class
        return F.coalesce(F.try_element_at(lookup, F.col(column).cast("string")), F.lit(0)).cast("int")

    def _transform(self, df: DataFrame) -> DataFrame:
        sfx = self.getOrDefault(self.suffix)
        joined_later = json.loads(self.getOrDefault(self.tables))
        plain = [c for c in dict.fromkeys([*self.get_vocabularies(), *self.getOrDefault(self.inputCols)]) if c not in joined_later]
        out = df.withColumns({f"{c}{sfx}": self.code(c) for c in plain})
        for c, folder in joined_later.items():
            words = df.sparkSession.read.schema("campo string, valor string, codigo int").parquet(folder).where(F.col("campo") == c)
            words = words.select(F.col("valor").alias("_valor"), F.col("codigo").alias("_codigo"))
            joined = out.join(words, F.col(c).cast("string") == F.col("_valor"), "left")
            out = joined.withColumn(f"{c}{sfx}", F.coalesce("_codigo", F.lit(0))).drop("_valor", "_codigo")
        return out


def hash_bucket(c: Column | str, buckets: int = 100) -> Column:
    """stable hash code of a category, used when no vocabulary exists."""
    c = F.col(c) if isinstance(c, str) else c
    return F.pmod(F.xxhash64(c.cast("string")), F.lit(buckets)).cast("int")
