"""Licence scans with ordered signature rules.

A few hundred regexes (names with versions, statements, SPDX tags, addresses,
sentences of the licence texts) are made from the tables below. Each rule has a
core, the name or phrase that its every match holds; the cores are looked for
where a keyword of their rules occurs, and a rule runs only where its core and
its own keyword do. A detection is an interval of the text; it is suppressed by one
of higher priority that holds it or lies in it, and by a longer one of its own
priority that holds it.

Everything happens in the row of the document with built-in functions: there is
no shuffle, and a very long text costs its own length a rule.

Null and empty texts have no words and no labels; repeated rows are alike; rows
without ``doc_id`` are scanned as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that part words, and words, in texts that aren't lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


def phrase(words: str) -> str:
    """The words in a row, whatever stands between them, as whole words."""
    return f"(?<!{IN_WORD})" + f"{GAP}+".join(words.split()) + f"(?!{IN_WORD})"


BASE = {label: "(?i)" + phrase(words) for words, label in PHRASES.items()}
ANY_BASE = "(?i)(?:" + "|".join(phrase(words) for words in PHRASES) + ")"

# Licence families. Label, words that name it (alternatives),
# keyword of the prefilter, versions.
FAMILIES = (
    ("gpl", ("gnu general public licen[cs]e", "gnu gpl", "gpl"), "gnu|gpl", ("1", "2", "3")),
    ("lgpl", ("gnu lesser general public licen[cs]e", "gnu library general public licen[cs]e", "lgpl"), "gnu|lgpl", ("2", "2.1", "3")),
    ("agpl", ("gnu affero general public licen[cs]e", "agpl"), "affero|agpl", ("1", "3")),
    ("gfdl", ("gnu free documentation licen[cs]e", "gfdl"), "gnu|gfdl", ("1.1", "1.2", "1.3")),
    ("apache", ("apache licen[cs]e", "apache software licen[cs]e", "asl"), "apache|asl", ("1.0", "1.1", "2.0")),
    ("mpl", ("mozilla public licen[cs]e", "mpl"), "mozilla|mpl", ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse public licen[cs]e", "epl"), "eclipse|epl", ("1.0", "2.0")),
    ("cddl", ("common development and distribution licen[cs]e", "cddl"), "distribution|cddl", ("1.0", "1.1")),
    ("eupl", ("european union public licen[cs]e", "eupl"), "european|eupl", ("1.0", "1.1", "1.2")),
    ("afl", ("academic free licen[cs]e",), "academic", ("2.0", "2.1", "3.0")),
    ("osl", ("open software licen[cs]e",), "software", ("1.0", "2.0", "3.0")),
    ("artistic", ("artistic licen[cs]e",), "artistic", ("1.0", "2.0")),
    ("bsl", ("boost software licen[cs]e",), "boost", ("1.0",)),
    ("lppl", ("latex project public licen[cs]e", "lppl"), "latex|lppl", ("1.0", "1.2", "1.3")),
    ("ofl", ("sil open font licen[cs]e", "open font licen[cs]e"), "font", ("1.0", "1.1")),
    ("psf", ("python software foundation licen[cs]e",), "python", ("2",)),
    ("php", ("php licen[cs]e",), "php", ("3.0", "3.01")),
    ("odbl", ("open database licen[cs]e", "odbl"), "database|odbl", ("1.0",)),
    ("cecill", ("cecill",), "cecill", ("1.0", "2.0", "2.1")),
    ("mit", ("mit licen[cs]e", "expat licen[cs]e"), "mit|expat", ()),
    ("isc", ("isc licen[cs]e",), "isc", ()),
    ("zlib", ("zlib licen[cs]e",), "zlib", ()),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public licen[cs]e"), "wtfpl|fuck", ()),
    ("unlicense", ("the unlicense",), "unlicense", ()),
    ("bsd", ("bsd licen[cs]e", "berkeley software distribution licen[cs]e"), "bsd|berkeley", ()),
    ("bsd-2-clause", ("bsd 2 clause", "simplified bsd", "freebsd licen[cs]e"), "bsd", ()),
    ("bsd-3-clause", ("bsd 3 clause", "new bsd", "modified bsd", "revised bsd"), "bsd", ()),
    ("bsd-4-clause", ("bsd 4 clause", "original bsd"), "bsd", ()),
    ("0bsd", ("bsd zero clause", "zero clause bsd", "0bsd"), "bsd", ()),
)
CC_PARTS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
STATEMENTS = ("licen[cs]ed under(?: the)?(?: terms of the)?", "(?:released|distributed|available|published) under(?: the)?(?: terms of the)?")
SENTENCES = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "noninfringement", "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither", "neither the name of .{1,80} may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "agreed", "unless required by applicable law or agreed to in writing"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify"),
    ("gpl", "warranty", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("zlib", "origin", "the origin of this software must not be misrepresented"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("bsl-1.0", "boost", "distributed under the boost software licen[cs]e"),
    ("ofl", "font", "this font software is licen[cs]ed under the sil open font licen[cs]e"),
    ("public-domain", "domain", "(?:dedicated|released|placed) (?:in|into|to) the public domain"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?"),
    ("cc0-1.0", "creative", "creative commons zero"),
    ("proprietary", "rights", "all rights reserved"),
    ("proprietary", "proprietary", "proprietary and confidential"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[str, ...]
    regex: str
    #: Part of every match, from a word's beginning on; other rules may share it.
    core: str


def _words(text: str) -> str:
    """A regex of words whose spaces may be any gap; groups may hold spaces."""
    return text.replace(" ?", f"{GAP}*").replace(" ", f"{GAP}+")


def _rule(label: str, priority: int, keywords: str, text: str, core: str | None = None) -> Rule:
    return Rule(label, priority, tuple(keywords.split("|")), f"(?i)(?<!{IN_WORD})(?:{text})(?!{IN_WORD})", core or text)


def _version(v: str) -> str:
    major, _, minor = v.partition(".")
    tail = rf"\.{minor}" if minor.strip("0") else r"(?:\.0)?"
    return rf"{GAP}*(?:(?:version|ver|v){GAP}*)?{major}{tail}(?!\.?[0-9])"


def rules() -> list[Rule]:
    """All rules, made from the tables: a tag outranks a statement, that a versioned name, that a bare name."""
    out: list[Rule] = []
    spdx, opensource, creative = "spdx-license-identifier:", r"opensource\.org/licenses/", r"creativecommons\.org/licenses/"
    owner = r"(?:gnu|apache|mozilla|eclipse)\.org/"
    for label, names, keys, versions in FAMILIES:
        name = "(?:" + "|".join(_words(n) for n in names) + ")"
        out.append(_rule(label, 30, keys, name))
        out += [_rule(label, 50, keys, f"{_words(s)}{GAP}+{name}", name) for s in STATEMENTS]
        out.append(_rule(label, 90, "spdx", rf"{spdx}{GAP}*{label}", spdx))
        for v in versions:
            own, full = f"{label}-{v if '.' in v else v + '.0'}", name + _version(v)
            out.append(_rule(own, 60, keys, full, name))
            later = rf"{GAP}+or{GAP}+(?:\(?at{GAP}+your{GAP}+option\)?{GAP}+)?(?:any{GAP}+)?later(?:{GAP}+version)?"
            out.append(_rule(own + "-or-later", 70, keys, full + later, name))
            for s in STATEMENTS:
                out += [_rule(own, 65, keys, f"{_words(s)}{GAP}+{full}", name), _rule(own + "-or-later", 72, keys, f"{_words(s)}{GAP}+{full}{later}", name)]
            out.append(_rule(own, 95, "spdx", rf"{spdx}{GAP}*{label}-{v.replace('.', '[.]')}(?:\.0)?(?:-only|\+)?", spdx))
            out.append(_rule(own, 80, "opensource", rf"{opensource}{label}-{v.replace('.', '[.]')}(?:\.0)?", opensource))
            out.append(_rule(own, 80, label, rf"{owner}[a-z/-]*licenses?/(?:old-licenses/)?(?:license-)?(?:{label}-)?{v.replace('.', '[.]')}(?:\.0)?", owner))
    for parts in CC_PARTS:
        short = f"cc{GAP}+" + f"{GAP}*".join(parts.split("-"))
        long = f"creative{GAP}+commons{GAP}+" + f"{GAP}+".join(_words(CC_WORDS[p]) for p in parts.split("-"))
        label = f"cc-{parts}"
        out.append(_rule(label, 40 + len(parts), "cc|creative", f"(?:{short}|{long})"))
        for v in CC_VERSIONS:
            number = v.replace(".", "[.]")
            out.append(_rule(f"{label}-{v}", 60 + len(parts), "cc|creative", f"(?:{short}|{long})(?:{GAP}+international|{GAP}+unported|{GAP}+licen[cs]e)*{GAP}*{number}", f"(?:{short}|{long})"))
            out.append(_rule(f"{label}-{v}", 80 + len(parts), "creativecommons", rf"{creative}{parts}/{number}", creative))
            out.append(_rule(f"{label}-{v}", 95, "spdx", rf"{spdx}{GAP}*cc-{parts}-{number}", spdx))
    out += [_rule(label, 75, key, _words(text)) for label, key, text in SENTENCES]
    return out


#: What the rules' matches begin with or hold, and the keywords of its rules: without one of them, lower-cased, it is not looked for.
CORES = {c: tuple(dict.fromkeys(k for r in rules() if r.core == c for k in r.keywords)) for c in dict.fromkeys(r.core for r in rules())}


def _cores(text: Column, low: Column) -> Column:
    """Numbers of the cores in the text; only their rules can match."""

    def one(i: int, core: str, keywords: tuple[str, ...]) -> Column:
        may = F.lit(False)
        for k in keywords:
            may = may | F.contains(low, F.lit(k))
        return F.when(may & F.rlike(text, F.lit(f"(?i)(?<!{IN_WORD})(?:{core})")), F.lit(i))

    return F.array_compact(F.array(*(one(i, c, ks) for i, (c, ks) in enumerate(CORES.items()))))


def _detections(text: Column, low: Column, cores: Column) -> Column:
    """Intervals that the rules find: label, priority, first character, end."""
    number = {c: i for i, c in enumerate(CORES)}
    table = F.array(*(F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.array(*map(F.lit, r.keywords)).alias("keywords"), F.lit(r.regex).alias("regex"), F.lit(number[r.core]).alias("core")) for r in rules()))
    run = F.filter(table, lambda r: F.array_contains(cores, r["core"]) & F.exists(r["keywords"], lambda k: F.contains(low, k)) & F.rlike(text, r["regex"]))

    def places(r: Column) -> Column:
        hits, between = F.regexp_extract_all(text, r["regex"], F.lit(0)), F.split(text, r["regex"], -1)
        empty = F.array().cast("array<struct<label:string,priority:int,start:int,end:int>>")
        start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

        def step(acc: Column, x: Column) -> Column:
            first = acc["at"] + F.length(x["between"])
            end = first + F.length(x["hits"])
            one = F.struct(r["label"].alias("label"), r["priority"].alias("priority"), first.alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

        pairs = F.zip_with(hits, F.slice(between, F.lit(1), F.size(hits)), lambda h, b: F.struct(h.alias("hits"), b.alias("between")))
        return F.aggregate(pairs, start, step, lambda acc: acc["found"])

    return F.flatten(F.transform(run, places))


def _kept(found: Column) -> Column:
    """Detections that no other one suppresses."""

    def beaten(d: Column) -> Column:
        def by(e: Column) -> Column:
            holds = (e["start"] <= d["start"]) & (e["end"] >= d["end"])
            inside = (d["start"] <= e["start"]) & (d["end"] >= e["end"])
            longer = (e["end"] - e["start"]) > (d["end"] - d["start"])
            return ((e["priority"] > d["priority"]) & (holds | inside)) | ((e["priority"] == d["priority"]) & holds & longer)

        return F.exists(found, by)

    return F.filter(found, lambda d: ~beaten(d))


def licences(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` and
    ``detections`` (label, priority, start, end in code points)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("low", F.lower("text"))
    text, low = F.col("text"), F.col("low")
    word = F.lit(f"{IN_WORD}+")
    may = F.contains(low, F.lit("license")) | (F.contains(low, F.lit("cc")) & F.contains(low, F.lit("by")))
    counted = {f"k_{label}": F.when(may, F.regexp_count(text, F.lit(rx))).otherwise(0) for label, rx in BASE.items()}
    empty = F.array().cast("array<struct<label:string,priority:int,start:int,end:int>>")
    rows = rows.select("doc_id", "text", "low", F.regexp_count(text, word).cast("long").alias("n_words"), *(c.alias(n) for n, c in counted.items()), _cores(text, low).alias("cores"))
    n_base = sum((F.col(n) for n in counted), F.lit(0)).cast("long")
    before_first = F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(ANY_BASE)) - 1)
    before_last = F.regexp_extract(text, "(?s)^(.*)" + ANY_BASE, 1)
    rows = rows.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.when(n_base > 0, F.regexp_count(before_first, word)).cast("long").alias("first_word"),
        F.when(n_base > 0, F.regexp_count(before_last, word)).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"k_{label}") > 0, F.lit(label)) for label in BASE)))).alias("base"),
        F.when(F.size("cores") > 0, _detections(text, low, F.col("cores"))).otherwise(empty).alias("found"),
    )
    rows = rows.withColumn("detections", F.when(F.size("found") > 0, _kept(F.col("found"))).otherwise(empty))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"]))))
    top = F.aggregate("detections", F.lit(0), lambda a, d: F.greatest(a, d["priority"]))
    score = F.greatest(top / F.lit(100.0), F.when(F.col("n_base") > 0, 0.3).otherwise(0.0))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "detections"
    )
