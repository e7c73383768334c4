"""Variants of a category beyond case and accents, as a graph over its distinct values.

Values that differ in case, accents or outer space have one *spelling* (a key). Two
kinds of links join spellings of a column:

*typing errors*
    one letter more, less or other, in spellings of at least LEAST_LETTERS letters,
    where the rarer is at most TYPO_SHARE as frequent as the other. Digits are never
    typing errors (``tipo 1``, ``tipo 2``).
*abbreviations*
    a spelling of at most SHORT letters that begins exactly one group of spellings
    with at least LEAST_LONG (``m``, ``masc.``: Masculino). One that begins several (``i``: ii, iii, iv; ``m``:
    masculino, mujer) says nothing and stays alone.

Linked spellings are one category; its name is the most frequent value that isn't an
abbreviation, in the normal form of texts.

Candidates for typing errors meet by what is left when one letter is deleted: two
spellings at distance one share such a remainder, so nothing is compared with
everything. Columns are reduced to counts per value first, all of them in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorte.functions.text import harmonise_key, normalise_text
from cohorte.operators.graph import components, stored

LEAST_LETTERS = 5
TYPO_SHARE = 0.1
SHORT, LEAST_LONG = 4, 5


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``campo, valor, n``: how often each value stands in each column."""
    cells = F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).cast("string").alias("valor")) for c in columns])
    return df.select(F.explode(cells).alias("s")).select("s.campo", "s.valor").where("valor IS NOT NULL").groupBy("campo", "valor").agg(F.count(F.lit(1)).alias("n"))


def _remainders(key: Column) -> Column:
    """The text itself and what is left without each of its letters."""
    at = F.sequence(F.lit(1), F.length(key))
    return F.array_distinct(F.concat(F.array(key), F.transform(at, lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key))))))


def typo_links(spellings: DataFrame, share: float = TYPO_SHARE, least: int = LEAST_LETTERS) -> DataFrame:
    """``campo, rara, comun`` for spellings (``campo, clave, n``) one letter apart."""
    long = spellings.where((F.length("clave") >= least) & ~F.col("clave").rlike(r"\d"))
    parts = long.select("campo", "clave", "n", F.explode(_remainders(F.col("clave"))).alias("resto"))
    a = parts.select("campo", "resto", F.col("clave").alias("rara"), F.col("n").alias("na"))
    b = parts.select("campo", "resto", F.col("clave").alias("comun"), F.col("n").alias("nb"))
    near = a.join(b, ["campo", "resto"]).where(F.col("na") <= F.col("nb") * share)
    return near.where(F.levenshtein("rara", "comun", 1) == 1).select("campo", "rara", "comun").distinct()


def abbreviation_links(spellings: DataFrame, short: int = SHORT, least_long: int = LEAST_LONG) -> DataFrame:
    """``campo, breve, larga`` where a short spelling begins the spellings of one group (``campo, clave, grupo``) only.

    Spellings that are begun in turn (``masc`` between ``m`` and ``masculino``) don't count as groups of their own."""
    text = F.regexp_replace("clave", r"\.$", "")
    rows = spellings.select("campo", "clave", "grupo", text.alias("texto"))
    brief = rows.where((F.length("texto") <= short) & F.col("texto").rlike(r"^\p{L}+$")).select("campo", F.col("clave").alias("breve"), F.col("texto").alias("inicio"))
    starts = F.transform(F.sequence(F.lit(1), F.lit(short)), lambda i: F.substring(F.col("texto"), F.lit(1), i))
    begun = rows.select("campo", F.col("clave").alias("larga"), "grupo", "texto", F.explode(F.array_distinct(starts)).alias("inicio"))
    pairs = stored(brief.join(begun, ["campo", "inicio"]).where(F.length("texto") > F.length("inicio")).select("campo", "breve", "larga", "grupo", "texto"), "inicios")
    between = pairs.select("campo", F.col("breve").alias("larga")).distinct()
    whole = pairs.join(between, ["campo", "larga"], "left_anti").groupBy("campo", "breve").agg(
        F.count_distinct("grupo").alias("grupos"), F.min(F.when(F.length("texto") >= least_long, F.col("larga"))).alias("larga")
    )
    return whole.where("grupos = 1 AND larga IS NOT NULL").select("campo", "breve", "larga")


def variant_map(df: DataFrame, columns: list[str], share: float = TYPO_SHARE) -> DataFrame:
    """``campo, valor, n, clave, canonico``: every value of ``columns`` and the name of its category."""
    counts = stored(value_counts(df, columns).withColumn("clave", harmonise_key("valor")), "valores")
    spellings = stored(counts.groupBy("campo", "clave").agg(F.sum("n").alias("n")), "formas")
    node = lambda c: F.struct(F.col("campo"), F.col(c).alias("clave"))
    typos = stored(typo_links(spellings, share).select("campo", node("rara").alias("a"), node("comun").alias("b")), "erratas")
    groups = components(typos).select("node.campo", "node.clave", F.col("component.clave").alias("grupo"))
    named = spellings.join(groups, ["campo", "clave"], "left").withColumn("grupo", F.coalesce("grupo", "clave"))
    named = stored(named, "grupos")
    brief = stored(abbreviation_links(named), "abreviaturas")
    final = named.join(brief, (named["campo"] == brief["campo"]) & (named["clave"] == brief["breve"]), "left").select(named["campo"], named["clave"], named["grupo"], "larga")
    of_long = named.select("campo", F.col("clave").alias("larga"), F.col("grupo").alias("de_larga"))
    final = final.join(of_long, ["campo", "larga"], "left").select("campo", "clave", F.coalesce("de_larga", "grupo").alias("grupo"), F.col("larga").isNotNull().alias("breve"))
    full = stored(counts.join(final, ["campo", "clave"]), "variantes")
    w = Window.partitionBy("campo", "grupo").orderBy("breve", F.col("n").desc(), "valor")
    best = full.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("campo", "grupo", normalise_text("valor").alias("canonico"))
    return stored(full.join(best, ["campo", "grupo"]).select("campo", "valor", "n", "clave", "canonico"), "mapa")


def unified(df: DataFrame, columns: list[str], words: DataFrame | None = None) -> DataFrame:
    """``df`` with every value of ``columns`` as the name of its category. The map is
    made once for all columns; it has a row per value and is joined, not collected."""
    words = words if words is not None else variant_map(df, columns)
    out = df
    for c in columns:
        own = words.where(F.col("campo") == c).select(F.col("valor").alias("_valor"), F.col("canonico").alias("_canonico"))
        out = out.join(own, F.col(c).cast("string") == F.col("_valor"), "left").withColumn(c, F.col("_canonico")).drop("_valor", "_canonico")
    return out
