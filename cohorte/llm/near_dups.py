"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

1. One pass over the texts makes each document's set of five-word shingles,
   a 128-bit digest of the set and the band keys of its SuperMinHash
   signature. Only digests and keys are written, about 250 bytes a document.
2. Documents with equal sets form a class; from here on a class is one
   member, however many copies it has.
3. In each band key shared by several classes all of them are compared with
   the least one (a star, not all pairs). Links are confirmed on full sets,
   read again for the classes that need them.
4. A band key whose classes are not all connected yet may hide further links
   between components. Those classes are joined on shingles instead: read in
   one order, rare shingles first, two sets of the wanted similarity share one
   of their first shingles (prefix and position filter), and only pairs of
   different components are made. Heavily edited copies of one text have
   shingles of their own, so a large group of them makes few pairs.
5. Connected components of all links.

With 24 bands of 6 places a pair at a similarity of exactly 0.85 shares no
band with a probability of 1e-5; at 0.9 it is 1e-8.

Null, empty and blank texts have no shingles: they are linked with nothing,
and each is its own component. Rows without ``doc_id`` can't be named by a
link: ``component_id`` is null and ``kept`` false. Repeated rows of a document
are alike, so each of them has the same result. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohorte.llm.common import bounded_broadcast, dropped, written
from cohorte.llm.components import LINKS, components
from cohorte.llm.shingles import mix, shingle_sets, stream
from cohorte.llm.superminhash import band_keys, signatures

K = 5
BANDS, ROWS = 24, 6
#: Links need PERCENT * |union| <= 100 * |intersection|.
PERCENT = 85
#: Columns of 64 parity bits that a set is compared by before it is read in full.
PARITY = 8
#: Ids broadcast at most (16 MB); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000

_SECOND = stream(21, 1)[0]


def _digest(s: np.ndarray) -> tuple[int, int]:
    a, b = mix(s).sum(dtype=np.uint64), mix(s ^ _SECOND).sum(dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = list(shingle_sets(_bytes(part.column("text")), K))
            keys = band_keys(signatures(sets, BANDS * ROWS), BANDS, ROWS).view(np.int64)
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), BANDS).cast(pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "h1", "h2", "bands"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes asked for (h1) with a text to their sorted shingle hashes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            asked = part.column("h1").to_pylist()
            sets = list(shingle_sets(_bytes(part.column("text")), K))
            found = [(h, s.view(np.int64)) for h, s in zip(asked, sets, strict=True) if len(s) and _digest(s)[0] == h]
            ends = np.cumsum([0, *(len(s) for _, s in found)], dtype=np.int32)
            values = pa.array(np.concatenate([np.empty(0, np.int64), *(s for _, s in found)]))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["h1", "shingles"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, sorted as unsigned numbers, are to be linked."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < PERCENT * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    at, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    return (values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
        x, y = (_lists(batch.column(c)) for c in ("x", "y"))
        good = [i for i in range(len(a)) if similar(next(x), next(y))]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of classes whose full sets are similar enough."""
    x = sets.select(F.col("h1").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("h1").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirmed, LINKS)


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The full sets (``h1, shingles``) of the classes ``h1`` in ``wanted``."""
    asked = written(classes.join(wanted, "h1", "left_semi").groupBy("h1").agg(F.min("rep").alias("rep")), "asked")
    small = bounded_broadcast(asked.withColumnRenamed("rep", "doc_id"), asked.count(), BROADCAST_IDS)
    # a repeated document gives its set more than once; links are made distinct later
    out = written(docs.select("doc_id", "text").join(small, "doc_id").select("h1", "text").mapInArrow(_full_sets, "h1 long, shingles array<long>"), "sets")
    dropped(asked)
    return out


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set, which slots hold an odd number of its shingles (64 slots a column)."""
    slots = 64 * PARITY
    for batch in batches:
        bits = np.zeros((batch.num_rows, slots), np.uint8)
        for row, s in zip(bits, _lists(batch.column("shingles")), strict=True):
            row[:] = np.bincount((mix(s) % np.uint64(slots)).astype(np.int64), minlength=slots) & 1
        words = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("h1"), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(PARITY))], names=["h1", *(f"odd{i}" for i in range(PARITY))])


def _rare_links(active: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of classes of different components that share a rare shingle.

    All sets are read in one order of shingles: first those that can't join two
    components, then by how many sets hold one. Let o be the overlap of a linked
    pair and i, j the places of its first common shingle; then at most n - i and
    m - j shingles are common, and (100 + PERCENT) * o >= PERCENT * (n + m).
    Shingles fall into slots by their hash; a slot that one set fills an odd and
    the other an even number of times holds a shingle that isn't common.
    """
    odd = [f"odd{i}" for i in range(PARITY)]
    held = sets.join(active, "h1").select("h1", "component", F.size("shingles").cast("long").alias("size"), F.explode("shingles").alias("shingle"))
    count = held.groupBy("shingle").agg(F.count("*").alias("k"), F.min("component").alias("p"), F.max("component").alias("q")).filter("p < q").select("shingle", "k")
    own = Window.partitionBy("h1")
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("k", "shingle")) - 1
    posted = held.join(count, "shingle").withColumn("place", place).filter(F.lit(100) * (F.col("size") - F.col("place")) >= F.lit(PERCENT) * F.col("size")).drop("k")
    parities = sets.join(active, "h1", "left_semi").mapInArrow(_parities, "h1 long, " + ", ".join(f"{c} long" for c in odd))
    posted = written(posted.join(parities, "h1"), "posted")  # the few rows that are left carry the parities
    per = posted.groupBy("shingle", "component").agg(F.count("*").alias("k"))
    top = per.groupBy("shingle").agg(F.max_by("component", F.struct("k", "component")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    # outside the largest component of a shingle: its members meet all others'
    few = posted.join(top, "shingle").filter("component <> top").select("shingle", *(F.col(c).alias(f"{c}_") for c in ("h1", "component", "size", "place", *odd)))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_"))) for c in odd), F.lit(0))
    common = F.least(F.col("size") - F.col("place"), F.col("size_") - F.col("place_"))
    need = F.lit(PERCENT) * (F.col("size") + F.col("size_"))
    near = (F.col("component") != F.col("component_")) & (F.lit(100 + PERCENT) * common >= need) & (F.lit(100 + PERCENT) * (F.col("size") + F.col("size_") - apart) >= need * 2)
    pairs = few.join(posted, (few.shingle == posted.shingle) & near)
    return written(pairs.select(F.least("h1", "h1_").alias("a"), F.greatest("h1", "h1_").alias("b")).distinct(), "pairs")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``, others are ignored):
    ``doc_id, n_shingles, component_id, kept``."""
    base = written(docs.select("doc_id", "text").mapInArrow(_signed, "doc_id long, n long, h1 long, h2 long, bands array<long>"), "signed")
    named = base.filter("doc_id IS NOT NULL AND n > 0")
    classes = written(named.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "classes")

    keys = named.select("h1", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo < hi").select("band", "lo")
    members = written(keys.join(shared, "band").select("band", "h1", "lo").distinct(), "members")
    stars = written(members.filter("h1 <> lo").select(F.col("lo").alias("a"), F.col("h1").alias("b")).distinct(), "stars")
    sets = _sets_of(docs, classes, members.select("h1").distinct())
    links = written(_links(stars, sets).distinct(), "confirmed")
    first = components(links)

    labelled = members.join(first.withColumnRenamed("node", "h1"), "h1", "left").select("band", "h1", F.coalesce("component", "h1").alias("component"))
    apart = labelled.groupBy("band").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p < q").select("band")
    active = written(labelled.join(apart, "band", "left_semi").select("h1", "component").distinct(), "active")
    rare = _rare_links(active, sets)
    pairs = rare.join(stars, ["a", "b"], "left_anti")
    more = written(_links(pairs, sets).distinct(), "confirmed")
    parts = components(links.union(more))

    placed = classes.join(parts.withColumnRenamed("node", "h1"), "h1", "left").select("h1", "h2", "n", "rep", F.coalesce("component", "h1").alias("part"))
    least = placed.groupBy("part").agg(F.min("rep").alias("component_id"))
    of_class = written(placed.join(least, "part").select("h1", "h2", "n", "component_id"), "of_class")
    found = base.select("doc_id", "n", "h1", "h2").join(of_class, ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )
    dropped(classes, members, stars, sets, links, active, more)
    out._reads = (base, of_class)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one of the least id.

    Rows without ``doc_id`` stay; a document that the table repeats stays once.
    """
    found = near_duplicates(docs)
    kept = written(found.filter("kept").groupBy("doc_id").agg(F.count("*").alias("copies")), "kept")
    dropped(*found._reads)
    count = kept.count()
    once, often = (bounded_broadcast(kept.filter(c).select("doc_id"), count, BROADCAST_IDS) for c in ("copies = 1", "copies > 1"))
    single = docs.join(once, "doc_id", "left_semi")
    repeated = docs.join(often, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.union(repeated).union(docs.filter("doc_id IS NULL"))


#: The same groups in DuckDB SQL, by comparing all documents that share a shingle.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN size p ON p.doc_id = a.doc_id JOIN size q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach AS (
  SELECT DISTINCT doc_id AS x, doc_id AS y FROM words UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(d.doc_id = component_id, false) AS kept
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN least ON least.x = d.doc_id"""
