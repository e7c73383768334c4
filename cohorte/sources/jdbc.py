"""Reading the clinical tables from a relational database (S2, optional).

The three tables are keyed by text ids, so Spark's numeric range
partitioning (``partitionColumn``/``lowerBound``/``upperBound``) does not
apply. Instead the table is split into ``num_partitions`` disjoint hash
buckets of the key, one JDBC query (one task) per bucket, so a large table
is read in parallel and no single task reads it all. The hash function is
the database's own (PostgreSQL ``hashtext`` by default). Results are cast
to the declared schema.

Not exercised in this repository's tests (no database is started here);
``bucket_predicates`` is unit-tested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorte.schemas import TABLES


def bucket_predicates(key: str, num_partitions: int, hash_sql: str = "hashtext({key})") -> list[str]:
    """Disjoint WHERE clauses covering every row: ``mod(abs(h), n) = i``.
    ``abs`` of the most negative integer overflows in PostgreSQL, so the
    sign is folded with a modulo on the raw hash first."""
    h = hash_sql.format(key=key)
    return [f"mod(mod({h}, {num_partitions}) + {num_partitions}, {num_partitions}) = {i}" for i in range(num_partitions)]


def read_table_jdbc(
    spark: SparkSession,
    url: str,
    name: str,
    properties: dict[str, str],
    num_partitions: int = 64,
    hash_sql: str = "hashtext({key})",
) -> DataFrame:
    spec = TABLES[name]
    df = spark.read.jdbc(url, name, predicates=bucket_predicates(spec.key, num_partitions, hash_sql), properties=properties)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema.fields])
