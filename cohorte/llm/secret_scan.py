"""Secret scans: candidates by pattern, false positives removed by a random forest.

1. One pass over all documents finds candidates (known formats, values assigned
   to telling names, long tokens with digits).
2. A second pass counts character transitions inside words and, for each word
   that stands in a candidate, the distinct texts that hold it outside of
   candidates (the dictionary, a table that grows with these words). Copies of a
   text count once, so a copied secret is no dictionary word.
3. Each candidate is described by its length, character classes and transitions,
   dictionary coverage, whether it is part of a path or address, and the words
   around it. A random forest, trained by Spark on about SAMPLE labelled findings
   at most, scores every candidate.

Labelled findings may be given (``doc_id, start, end, is_secret``). Without
them, clear cases stand in: a known format or an assigned value that is no
placeholder and no word is a secret; a placeholder, a dictionary word, or a long
token with no telling word near it is none; the rest is only scored. With
findings of one class only, clear secrets score 1 and all else 0.

Null and empty texts have no candidates; repeated rows repeat their findings;
findings of rows without ``doc_id`` carry a null id. Spans are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorte.llm.common import dropped, sliced, written
from cohorte.llm.shingles import chunks, hash_between, prefix_sums, word_spans

#: Findings trained on, about, at most.
SAMPLE = 20_000
#: Places by which words that stand in no candidate are left out before the shuffle; more words cost shuffle, not exactness.
PLACES = 1 << 23
#: Texts that a task remembers to skip their copies; the shuffle finds the others.
SEEN = 1 << 18
#: A word is in the dictionary if this share of the distinct texts holds it, and two.
COMMON = 2e-4
THRESHOLD = 0.5
SYMBOLS = 40  # letters, digits, four kinds of others
#: Stands for the word whose count is that of the distinct texts.
DOCUMENTS = SYMBOLS * SYMBOLS

# What follows the BEGIN line of a private key: header lines, base64 lines (quoted,
# indented or escaped ones as well), a short last line, and the END line.
_KEY_GAP = r"""(?:\s|\\[nrt]|["'+,;>|#*()\\])*+"""
_KEY_END = r"-----END (?:[A-Z]{2,10} ){0,3}PRIVATE KEY-----"
_KEY_BODY = (
    rf"(?:{_KEY_GAP}[A-Z][A-Za-z-]{{2,30}}: [^\n\\\"']*+)*+"
    rf"(?:{_KEY_GAP}[A-Za-z0-9+/=]{{16,}}+)*+"
    rf"(?:{_KEY_GAP}[A-Za-z0-9+/]{{0,15}}+(?:={{1,2}}+|(?={_KEY_GAP}{_KEY_END})))?+"
    rf"(?:{_KEY_GAP}{_KEY_END})?+"
)

# Published token formats, telling names, usual placeholders.
FORMATS = (
    ("aws_key_id", r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("github_token", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+)"),
    ("slack_token", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+"),
    ("google_key", r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}"),
    ("stripe_key", r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[0-9A-Za-z]{16,}+"),
    ("jwt", r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    ("private_key", rf"-----BEGIN (?:[A-Z]{{2,10}} ){{0,3}}PRIVATE KEY-----{_KEY_BODY}"),
)
TELLING = "password passwd passphrase pwd secret token apikey api_key api-key access_key access-key auth_key credential credentials bearer".split()
_PLACEHOLDER = re.compile(r"example|changeme|change_me|placeholder|your[_-]|dummy|sample|test(?:ing)?$|x{4,}|\*{3,}|^[<${%]|^(.)\1+$|^(?:0123456789|1234567890|123456|abcdef)", re.I)
_NAME = "|".join(map(re.escape, TELLING))
_FORMAT = re.compile("|".join(f"(?P<{name}>{rx})" for name, rx in FORMATS))
_ASSIGNED = re.compile(rf"(?:{_NAME})[\"']?\s{{0,3}}(?:=|:|=>)\s{{0,3}}[\"']?([^\s\"',;]{{6,}}+)", re.I)
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}+")
_KEY_LINE = re.compile(r"[A-Za-z0-9+/=]{16,}+")
_DIGIT = re.compile(r"[0-9]")
#: Without one of these a text has no token of a known format.
_PREFIXES = "AKIA ASIA AGPA AIDA AROA ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ xox AIza k_live_ k_test_ eyJ -----BEGIN".split()
_TELLS = re.compile(rf"(?:{_NAME}|key|secret)", re.I)
_WORDS = re.compile(r"[A-Za-z]{3,}")

_SYMBOL = np.full(256, 39, np.int64)
_SYMBOL[list(b"abcdefghijklmnopqrstuvwxyz")] = np.arange(26)
_SYMBOL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = np.arange(26)
_SYMBOL[list(b"0123456789")] = np.arange(26, 36)
_SYMBOL[list(b"_-+/=.")] = [36, 36, 37, 37, 38, 38]

FEATURES = (
    "length", "distinct", "entropy", "digits", "upper", "lower", "other", "class_changes", "transitions", "dictionary",
    "path", "address", "known_format", "assigned", "quoted", "telling_before", "telling_near", "words_before",
)

_SPLIT = np.ones(256, bool)
_SPLIT[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter runs of the texts, and where each text's begin."""
    buf, starts, ends, offsets = word_spans([t.lower() for t in texts], _SPLIT)
    return hash_between(prefix_sums(buf), starts, ends), np.searchsorted(starts, offsets)


def _value_words(value: str) -> tuple[list[str], np.ndarray]:
    """Letter runs of a value and their hashes."""
    words = _WORDS.findall(value)
    return words, _words(["\n".join(words).encode()])[0]


def _place(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(PLACES - 1)).astype(np.int64)


def _wanted(found: DataFrame) -> np.ndarray:
    """Whether a place has a word that stands in a candidate."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [_place(_value_words(v)[1]) for v in batch.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)) if out else np.empty(0, np.int64))], names=["place"])

    out = np.zeros(PLACES, bool)
    for batch in found.select("value").mapInArrow(places, "place long").distinct().toArrow().to_batches():  # PLACES rows at most
        out[batch.column(0).to_numpy()] = True
    return out


def _outside(text: str) -> str:
    """The text without its candidates."""
    spans = candidates(text)
    if not spans:
        return text
    ends = [0, *(b for _, b, _ in spans)]
    return "\n".join(text[a:b] for a, b in zip(ends, [*(a for a, _, _ in spans), len(text)], strict=True))


def _counted(shared):
    """``word, text, n``: a wanted word in a text; under DOCUMENTS the text itself; under a pair of symbols its number in the task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = np.unpackbits(shared.value).view(bool), set()
        pairs = np.zeros(SYMBOLS * SYMBOLS, np.int64)

        def batch_of(words: np.ndarray, texts: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (words, texts, n)], names=["word", "text", "n"])

        for batch in sliced(batches):
            texts, digests = [], []
            for t in batch.column("text").to_pylist():
                raw = (t or "").encode("utf-8", "replace")
                digest = int.from_bytes(blake2b(raw, digest_size=8).digest())
                if len(seen) >= SEEN:
                    seen.clear()
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    texts.append(_outside(t or "").encode("utf-8", "replace"))
                code = _SYMBOL[np.frombuffer(raw, np.uint8)]
                inside = (code[:-1] < 36) & (code[1:] < 36)
                pairs += np.bincount((code[:-1] * SYMBOLS + code[1:])[inside], minlength=SYMBOLS * SYMBOLS)
            for a, b in chunks(texts):
                words, at = _words(texts[a:b])
                keep = wanted[_place(words)]
                of = np.repeat(np.arange(b - a), np.diff(at))[keep]
                hashes = words[keep]
                order = np.lexsort((hashes, of))
                hashes, of = hashes[order], of[order]
                first = np.ones(len(of), bool)
                first[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
                digest = np.array(digests[a:b], np.uint64)
                words = np.concatenate([hashes[first], np.full(b - a, DOCUMENTS, np.uint64)])
                yield batch_of(words, np.concatenate([digest[of[first]], digest]), np.ones(len(words), np.int64))
        at = np.flatnonzero(pairs)
        yield batch_of(at, np.full(len(at), TaskContext.get().partitionId()), pairs[at])

    return rows


class Corpus:
    """Transition log-probabilities and the dictionary."""

    def __init__(self, pairs: np.ndarray, known: np.ndarray) -> None:
        pairs = pairs.reshape(SYMBOLS, SYMBOLS) + 0.5
        self.transitions = np.log(pairs / pairs.sum(axis=1, keepdims=True))
        self.known = np.sort(known)

    @classmethod
    def of(cls, docs: DataFrame, found: DataFrame) -> Corpus:
        wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(_wanted(found)))
        each = docs.select("text").mapInArrow(_counted(wanted), "word long, text long, n long").groupBy("word", "text").agg(F.max("n").alias("n"))
        counts = written(each.groupBy("word").agg(F.sum("n").alias("n")), "dictionary")
        fixed = np.zeros(DOCUMENTS + 1, np.int64)
        for r in counts.filter(F.col("word").between(0, DOCUMENTS)).collect():  # a fixed number of rows at most
            fixed[r.word] = r.n
        # at most 1 / COMMON times the words of a text on average
        known = counts.filter((F.col("n") >= max(2, COMMON * int(fixed[-1]))) & ~F.col("word").between(0, DOCUMENTS)).select("word").toArrow()
        dropped(counts)
        return cls(fixed[:-1], known.column(0).to_numpy().view(np.uint64))

    def coverage(self, value: str) -> float:
        """Share of the value's characters in dictionary words."""
        words, hashes = _value_words(value)
        if not words or not len(self.known):
            return 0.0
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return sum(len(w) for w, k in zip(words, self.known[at] == hashes, strict=True) if k) / len(value)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Disjoint spans with their rule: known formats first, then assigned values, then long tokens."""
    # substring tests first: a search for a literal is far cheaper than a regex
    found: list[tuple[int, int, str]] = []
    if any(p in text for p in _PREFIXES):
        found += [(*m.span(), m.lastgroup) for m in _FORMAT.finditer(text)]
    low = text.lower()
    if any(name in low for name in TELLING):
        found += [(*m.span(1), "assigned") for m in _ASSIGNED.finditer(text)]
    if _DIGIT.search(text):
        found += [(*m.span(), "long_token") for m in _LONG.finditer(text) if _DIGIT.search(m[0])]
    rank = {"assigned": 1, "long_token": 2}
    out: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))
    for a, b, rule in sorted(found, key=lambda s: (rank.get(s[2], 0), s[0])):
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append((a, b, rule))
    return sorted(out)


def describe(value: str, before: str, after: str, rule: str, corpus: Corpus) -> list[float]:
    raw = np.frombuffer(value.encode("utf-8", "replace"), np.uint8)
    code = _SYMBOL[raw]
    share = np.unique(raw, return_counts=True)[1] / len(raw)
    kind = np.select([(raw >= 48) & (raw < 58), (raw >= 65) & (raw < 91), (raw >= 97) & (raw < 123)], [0, 1, 2], 3)
    words = before.split()
    return [
        float(np.log2(len(value))),
        len(share) / len(raw),
        float(-(share * np.log2(share)).sum()),
        *(float((kind == k).mean()) for k in range(4)),
        float((kind[1:] != kind[:-1]).mean()) if len(raw) > 1 else 0.0,
        float(corpus.transitions[code[:-1], code[1:]].mean()) if len(raw) > 1 else 0.0,
        corpus.coverage(value),
        float(before.endswith(("/", "\\")) or value.count("/") > 1),
        float("://" in before[-20:] or "@" in before[-1:] + after[:1]),
        float(rule not in ("assigned", "long_token")),
        float(rule == "assigned"),
        float(before[-1:] in "\"'`" and before != ""),
        float(bool(words) and bool(_TELLS.search(" ".join(words[-3:])))),
        float(bool(_TELLS.search(before + " " + after))),
        sum(w.isalpha() for w in words[-4:]) / 4,
    ]


def clear_label(value: str, rule: str, f: list[float]) -> int | None:
    """1 or 0 for a finding that is clear by itself."""
    # base64 lines hold any short word by chance
    if _PLACEHOLDER.search(_KEY_LINE.sub("", value) if rule == "private_key" else value):
        return 0
    if rule not in ("assigned", "long_token"):
        return 1
    if f[FEATURES.index("dictionary")] > 0.6:
        return 0
    if rule == "assigned":
        return 1 if f[FEATURES.index("entropy")] >= 2.5 and f[FEATURES.index("digits")] > 0 else None
    return None if f[FEATURES.index("telling_near")] else 0


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates with the characters before and after."""
    for batch in sliced(batches):
        out = []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            out += [(i, a, b, rule, text[a:b], text[max(0, a - 80) : a], text[b : b + 40]) for a, b, rule in candidates(text or "")]
        kinds = (*[pa.int64()] * 3, *[pa.string()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "start", "end", "rule", "value", "before", "after"])


def _described(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = shared.value
        for batch in sliced(batches):
            value, before, after, rule = (batch.column(c).to_pylist() for c in ("value", "before", "after", "rule"))
            f = [describe(v, x, y, r, corpus) for v, x, y, r in zip(value, before, after, rule, strict=True)]
            clear = [clear_label(v, r, x) for v, r, x in zip(value, rule, f, strict=True)]
            columns = [*(batch.column(c) for c in ("doc_id", "start", "end", "rule")), pa.array(clear, pa.int32()), pa.array(f, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end", "rule", "clear", "features"])

    return rows


def secrets(docs: DataFrame, findings: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row a candidate: ``doc_id, start, end, rule, score`` (0 to 1) and ``is_secret``."""
    spans = written(docs.select("doc_id", "text").mapInArrow(_found, "doc_id long, start long, end long, rule string, value string, before string, after string"), "spans")
    corpus = docs.sparkSession.sparkContext.broadcast(Corpus.of(docs, spans))
    found = written(spans.mapInArrow(_described(corpus), "doc_id long, start long, end long, rule string, clear int, features array<double>"), "findings")
    dropped(spans)
    if findings is None:
        labelled = found.filter("clear IS NOT NULL").withColumn("label", F.col("clear").cast("double"))
    else:
        known = findings.select("doc_id", "start", "end", F.col("is_secret").cast("double").alias("label")).dropDuplicates(["doc_id", "start", "end"])
        labelled = found.join(known, ["doc_id", "start", "end"])
    rows = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    if len(rows) < 2:
        scored = found.withColumn("score", F.when(F.col("clear") == 1, 1.0).otherwise(0.0))
    else:
        share = {y: min(1.0, sample / 2 / n) for y, n in rows.items()}  # each class to half the sample
        drawn = F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 << 30)) / float(1 << 30)
        train = labelled.filter(drawn < F.when(F.col("label") > 0, share[1.0]).otherwise(share[0.0]))
        forest = RandomForestClassifier(numTrees=40, maxDepth=8, seed=7, featureSubsetStrategy="sqrt", featuresCol="x")
        vector = array_to_vector(F.col("features"))
        model = forest.fit(train.select("label", vector.alias("x")))
        scored = model.transform(found.withColumn("x", vector)).withColumn("score", F.get(vector_to_array("probability"), 1))
    return scored.select("doc_id", "start", "end", "rule", "score", (F.col("score") >= THRESHOLD).alias("is_secret"))
