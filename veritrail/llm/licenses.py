"""License scans by ordered signature rules.

A text becomes its words (A-Z lower-cased, everything that is neither letter, digit nor beyond ASCII separates), joined
by single spaces. Hundreds of regular expressions are tried, each only on texts that hold its keyword; all their
matches are intervals. An interval inside a longer one, or equal to one of a rule that comes earlier, is dropped; the
labels of what stays are the document's.

Everything is row-local DataFrame functions: no shuffle, no key that could be hot, and texts without any keyword pay
for one pass over their characters.

Defined cases: a null or empty text has no words, no labels and score 0; of equal intervals the rule that comes first
stays; texts of any length and any number of matches are scanned whole, in n log n steps of the n matches; repeated rows
give equal results; an empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: SPDX identifier without version as words, label, names as written (words only), versions.
FAMILIES = (
    ("mit", "mit", ("mit license", "mit licence", "mit open source license", "expat license"), ()),
    ("x11", "x11", ("x11 license",), ()),
    ("apache", "apache", ("apache license", "apache licence", "apache software license"), ("1.0", "1.1", "2")),
    ("lgpl", "lgpl", ("gnu lesser general public license", "lesser general public license"), ("2.1", "3")),
    ("lgpl", "lgpl", ("gnu library general public license",), ("2",)),
    ("agpl", "agpl", ("gnu affero general public license", "affero general public license"), ("1", "3")),
    ("gpl", "gpl", ("gnu general public license", "gnu general public licence"), ("1", "2", "3")),
    ("", "gpl", ("gnu gpl", "gpl"), ("2", "3")),
    ("", "lgpl", ("gnu lgpl", "lgpl"), ("2.1", "3")),
    ("gfdl", "gfdl", ("gnu free documentation license",), ("1.1", "1.2", "1.3")),
    ("mpl", "mpl", ("mozilla public license",), ("1.0", "1.1", "2.0")),
    ("epl", "epl", ("eclipse public license",), ("1.0", "2.0")),
    ("cddl", "cddl", ("common development and distribution license", "cddl"), ("1.0", "1.1")),
    ("bsd 2 clause", "bsd-2-clause", ("bsd 2 clause license", "simplified bsd license"), ()),
    ("bsd 3 clause", "bsd-3-clause", ("bsd 3 clause license", "new bsd license", "modified bsd license"), ()),
    ("bsd 4 clause", "bsd-4-clause", ("bsd 4 clause license", "original bsd license"), ()),
    ("", "bsd", ("bsd license",), ()),
    ("isc", "isc", ("isc license",), ()),
    ("zlib", "zlib", ("zlib license", "zlib libpng license"), ()),
    ("bsl", "bsl", ("boost software license",), ("1.0",)),
    ("artistic", "artistic", ("artistic license",), ("1.0", "2.0")),
    ("eupl", "eupl", ("european union public licence",), ("1.0", "1.1", "1.2")),
    ("ofl", "ofl", ("sil open font license",), ("1.0", "1.1")),
    ("afl", "afl", ("academic free license",), ("1.2", "2.0", "2.1", "3.0")),
    ("osl", "osl", ("open software license osl", "osl"), ("1.0", "2.0", "2.1", "3.0")),
    ("unlicense", "unlicense", ("unlicense",), ()),
    ("wtfpl", "wtfpl", ("wtfpl",), ("1", "2")),
    ("cecill", "cecill", ("cecill",), ("1.0", "2.0", "2.1")),
    ("psf", "psf", ("python software foundation license",), ("2",)),
    ("php", "php", ("php license",), ("3.0", "3.01")),
    ("postgresql", "postgresql", ("postgresql license",), ()),
    ("ms pl", "ms-pl", ("microsoft public license",), ()),
    ("ms rl", "ms-rl", ("microsoft reciprocal license",), ()),
    ("odbl", "odbl", ("open database license",), ("1.0",)),
    ("", "public-domain", ("public domain",), ()),
    ("cc0", "cc0", ("cc0",), ("1.0",)),
)
#: Creative Commons parts as words, and the versions.
COMMONS = {"by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Short identifiers that name a license also outside a tag, where a version follows.
ACRONYMS = ("agpl", "gfdl", "mpl", "epl", "bsl", "eupl", "afl", "odbl")
#: Sentences of license notices: label, the words every match begins with, the rest as a pattern.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ""),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", ""),
    ("isc", "permission to use copy modify and", "(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ""),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", ""),
    ("wtfpl", "do what the fuck you want to public license", ""),
    ("apache-2", "apache", r"(?: version| v)? ?v?2(?: 0)? licen[cs]e"),
)
#: Every match of a rule has one of these in it, so a text without them needs no further look.
HINTS = ("licen", " gpl", " lgpl", " cddl", " osl", " cecill", " wtfpl", " public domain", " cc ", " commons ", " cc0", " hereby granted", " redistribution and use ", " this software is provided as is ", *(f" {x}" for x in ACRONYMS))
LICENSED = r"licensed(?: to you)? under (?:the )?(?:terms of )?(?:the )?"
GRANT = r"(?:licensed|released|distributed|available|published|provided|covered)(?: to you)? under (?:the )?(?:terms of )?(?:the )?"
TAG = "spdx license identifier "


def rules() -> list[dict]:
    """The ordered rules: grants, tags, notices, then bare names; versions before none. A keyword is in every match."""
    names = [(f" {n}", label, n, v) for _, label, own, versions in FAMILIES for n in own for v in (*versions, "")]
    tags = [(f" {n}", label, n, v) for n, label, _, versions in FAMILIES if n for v in (*versions, "")]
    for short, long in COMMONS.items():
        label = "cc-" + short.replace(" ", "-")
        names += [(k, label, n, v) for k, n in ((" cc ", f"cc {short}"), (" commons ", f"creative commons {long}")) for v in (*COMMONS_VERSIONS, "")]
        tags += [(" cc ", label, f"cc {short}", v) for v in (*COMMONS_VERSIONS, "")]
    acronyms = [x for x in tags if x[2] in ACRONYMS and x[3]]
    published = [(k, label, f"{n} as published by the free software foundation(?: either)?", v) for k, label, n, v in names if label in ("gpl", "lgpl", "agpl") and n.startswith("gnu") and v]
    out = []
    for start, own, sure in ((GRANT, names + acronyms, 1.0), (LICENSED, tags, 1.0), (TAG, tags, 1.0), ("", published, 1.0), (None, NOTICES, 1.0), ("", names + acronyms, 0.6)):
        if start is None:
            out += [{"priority": len(out) + i, "label": label, "keyword": f" {first}", "score": sure, "pattern": f" {first}{rest}(?= )"} for i, (label, first, rest) in enumerate(own)]
            continue
        for keyword, label, name, version in own:
            digits = version.replace(".", " ").removesuffix(" 0")
            number = rf"(?: license| licence| international)?(?: version| v)? ?v?{digits}(?: 0)?(?! \d)" if version else ""
            full = f"{label}-{version.removesuffix('.0') if label == 'apache' else version}" if version else label
            out.append({"priority": len(out), "label": full, "keyword": keyword, "score": sure, "pattern": f" {start}{name}{number}(?= )"})
    return out


def words(text: Column) -> Column:
    """The words joined by single spaces, with one space before and after; a single space if there are none."""
    # lower() also folds letters beyond ASCII; none of them folds to a word of a phrase or rule
    lowered = F.lower(F.coalesce(text, F.lit("")))
    joined = F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(joined == "", " ").otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def places(text: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places of a phrase among the words, and the first and last word it starts at."""
    padded = f" {phrase} "
    has = F.contains(text, F.lit(padded))
    last = F.length(text) - F.instr(F.reverse(text), padded[::-1]) + 2 - len(padded)
    return (
        F.when(has, F.regexp_count(text, F.lit(f" (?={phrase} )"))).otherwise(0).cast("long"),
        F.when(has, spaces(F.substring(text, F.lit(1), F.instr(text, padded) - 1))),
        F.when(has, spaces(F.substring(text, F.lit(1), last - 1))),
    )


def detections(text: Column, table: list[dict] | None = None) -> Column:
    """Array of (start, stop, priority, label, score) in characters of ``words``: all matches that no other one covers."""
    table = rules() if table is None else table
    # each keyword is looked for once, however many rules it has
    keyed: dict[str, list[dict]] = {}
    for r in table:
        keyed.setdefault(r["keyword"], []).append(r)
    groups = F.from_json(F.lit(json.dumps([{"keyword": k, "rules": own} for k, own in keyed.items()])), "array<struct<keyword:string,rules:array<struct<priority:int,label:string,score:double,pattern:string>>>>")
    near = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(text, g["keyword"])), lambda g: g["rules"]))
    tried = F.filter(near, lambda r: F.regexp_like(text, r["pattern"]))

    def matches(r: Column) -> Column:
        def placed(both: Column) -> Column:
            pieces, found = both["pieces"], both["found"]
            gone = F.concat(F.array(F.lit(0)), F.transform(found, F.length))
            starts = scanned(F.zip_with(F.slice(F.transform(pieces, F.length), F.lit(1), F.size(found)), F.slice(gone, F.lit(1), F.size(found)), lambda a, b: a + b), lambda a, b: a + b)
            sized = F.zip_with(starts, found, lambda start, m: F.struct(start.alias("start"), (start + F.length(m)).alias("stop")))
            return F.transform(sized, lambda z: F.struct(z["start"].alias("start"), (-z["stop"]).alias("before"), r["priority"].alias("priority"), z["stop"].alias("stop"), r["label"].alias("label"), r["score"].alias("score")))

        return let(F.struct(F.split(text, r["pattern"]).alias("pieces"), F.regexp_extract_all(text, r["pattern"], F.lit(0)).alias("found")), placed)

    def uncovered(every: Column) -> Column:
        # in this order, whatever covers an interval comes before it and ends no earlier
        reached = F.concat(F.array(F.lit(-1)), scanned(F.transform(every, lambda x: x["stop"]), F.greatest))
        marked = F.zip_with(every, F.slice(reached, F.lit(1), F.size(every)), lambda x, most: F.struct(x.alias("x"), (x["stop"] > most).alias("kept")))
        return F.transform(F.filter(marked, lambda m: m["kept"]), lambda m: F.struct(*[m["x"][c].alias(c) for c in ("start", "stop", "priority", "label", "score")]))

    return let(F.array_sort(F.flatten(F.transform(tried, matches))), uncovered)


def let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def scanned(numbers: Column, join) -> Column:
    """Running sums (or what else ``join`` says) of an array, by shifts of 1, 2, 4, ... places: n log n steps."""
    n = F.size(numbers)
    shifts = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda k: k < n)

    def step(own: Column, k: Column) -> Column:
        return F.zip_with(own, F.concat(F.array_repeat(F.lit(None).cast("int"), k), F.slice(own, F.lit(1), F.size(own) - k)), lambda a, b: F.when(b.isNull(), a).otherwise(join(a, b)))

    return F.aggregate(shifts, numbers, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for each row."""
    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    text = F.col("words")
    found = [places(text, phrase) for phrase, _ in BASE]
    base = F.filter(F.array(*[F.when(n > 0, label) for (n, _, _), (_, label) in zip(found, BASE, strict=True)]), lambda x: x.isNotNull())
    looked = F.struct(
        reduce(lambda a, b: a + b, (n for n, _, _ in found)).alias("n"), F.least(*[a for _, a, _ in found]).alias("first"), F.greatest(*[b for _, _, b in found]).alias("last"),
        F.array_sort(F.array_distinct(base)).alias("base"), detections(text).alias("detections"),
    )
    hint = reduce(lambda a, b: a | b, (F.contains(text, F.lit(k)) for k in HINTS))
    rows = rows.select("id", (spaces(text) - 1).alias("n_words"), F.when(hint, looked).alias("f"))
    rows = rows.select(
        "id", "n_words", F.coalesce("f.n", F.lit(0)).cast("long").alias("n_base"), F.col("f.first").alias("first_word"), F.col("f.last").alias("last_word"),
        F.coalesce("f.base", F.array().cast("array<string>")).alias("base"), F.coalesce("f.detections", F.from_json(F.lit("[]"), "array<struct<start:int,stop:int,priority:int,label:string,score:double>>")).alias("detections"),
    )
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda x: x["label"]))))
    score = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("detections", lambda x: x["score"])), F.lit(0.0)))
    return rows.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "detections")
