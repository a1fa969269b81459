"""Licence scan by ordered signature rules, with DataFrame functions only.

A text becomes its words (A-Z lower-cased, runs of ASCII other than letters and digits cut
them) joined by single spaces. Signatures are regular expressions over that line. A text is looked
at only if a cheap expression finds a gate word, and a signature only if its own keyword begins
one of the words. Detections are word intervals; one that lies inside another is dropped, and
of two that overlap in part the one whose rule comes first stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between words, after lower-casing.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text that is not lower-cased yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose every place is counted, and their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: label, keyword, expression for the name, SPDX-like words. Whatever an expression matches holds a word that begins with
#: its keyword, so alternatives without one are names of their own.
NAMES = (
    ("mit", "mit", "mit", "mit"),
    ("mit", "expat", "expat", "mit"),
    ("mit-0", "mit", "mit (?:0|no attribution)", "mit 0"),
    ("apache-2.0", "apache", "apache(?: software)?(?: licen[cs]e)?(?: version)?(?: v)? ?2(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache", "apache(?: software)?(?: licen[cs]e)?(?: version)? 1 1", "apache 1 1"),
    ("apache", "apache", "apache(?: software)?", "apache"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)", "bsd 4 clause"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause)", "0bsd"),
    ("bsd", "bsd", "bsd", "bsd"),
    ("isc", "isc", "isc", "isc"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public", "agpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public licen[cs]e(?: version)?(?: v)? ?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public licen[cs]e(?: version)?(?: v)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public", "lgpl"),
    ("lgpl-2.0", "library", "(?:gnu )?library general public", "lgpl 2 0(?: only| or later)?"),
    ("gpl-2.0", "gnu", "gnu general public licen[cs]e(?: version)?(?: v)? ?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gnu", "gnu general public licen[cs]e(?: version)?(?: v)? ?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "gnu", "gnu general public", "gpl"),
    ("gfdl", "documentation", "(?:gnu )?free documentation", "gfdl 1 [123](?: only| or later)?"),
    ("mpl-2.0", "mozilla", "mozilla public licen[cs]e(?: version)?(?: v)? ?2(?: 0)?", "mpl 2 0"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e(?: version)?(?: v)? ?1 1", "mpl 1 1"),
    ("mpl", "mozilla", "mozilla public", "mpl"),
    ("epl-2.0", "eclipse", "eclipse public licen[cs]e(?: version)?(?: v)? ?2(?: 0)?", "epl 2 0"),
    ("epl", "eclipse", "eclipse public", "epl 1 0"),
    ("cddl", "distribution", "common development and distribution", "cddl 1 [01]"),
    ("cpl-1.0", "common", "common public", "cpl 1 0"),
    ("eupl", "union", "european union public", "eupl 1 [012]"),
    ("artistic-2.0", "artistic", "artistic licen[cs]e(?: version)? 2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", "artistic", "artistic 1 0"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("bsl-1.0", "boost", "boost software", "bsl 1 0"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("wtfpl", "fuck", "do what the fuck you want to public", "wtfpl"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("odbl", "database", "open (?:data commons )?database", "odbl 1 0"),
    ("ofl-1.1", "font", "(?:sil )?open font", "ofl 1 1"),
    ("osl-3.0", "open", "open software", "osl 3 0"),
    ("psf-2.0", "python", "python(?: software foundation)?", "psf 2 0"),
    ("php-3.0", "php", "php", "php 3 0"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("ms-pl", "microsoft", "microsoft public", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal", "ms rl"),
    ("busl-1.1", "business", "business source", "busl 1 1"),
    ("sspl-1.0", "side", "server side public", "sspl 1 0"),
    ("elastic-2.0", "elastic", "elastic", "elastic 2 0"),
)
#: How a name is put, from the surest to the weakest form, and how sure it is.
FORMS = (
    ("licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?", 0.95),
    ("(?:released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?{name} licen[cs]e", 0.95),
    ("(?:the )?{name} licen[cs]e(?: agreement)?", 0.85),
    ("licen[cs]e (?:is )?(?:the )?{name}", 0.7),
)
#: Creative Commons: elements in words, label
ELEMENTS = (
    ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?", "cc-by-nc-nd"),
    ("by nc sa", "attribution non ?commercial share ?alike", "cc-by-nc-sa"),
    ("by nc", "attribution non ?commercial", "cc-by-nc"),
    ("by nd", "attribution no ?deriv(?:ative)?s?", "cc-by-nd"),
    ("by sa", "attribution share ?alike", "cc-by-sa"),
    ("by", "attribution", "cc-by"),
)
#: label, keyword, expression, how sure
TEXTS = (
    ("mit", "granted", "permission is hereby granted free of charge to any person", 0.95),
    ("isc", "permission", "permission to use copy modify and or distribute this software", 0.9),
    ("bsd", "redistribution", "redistribution and use in source and binary forms", 0.9),
    ("bsd-3-clause", "redistribution", "redistributions? (?:of source code )?must retain the above copyright", 0.7),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms", 0.8),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?(?: public domain)?", 0.9),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0", 1.0),
    ("apache-2.0", "apache", "apache org licenses license 2 0", 1.0),
    ("mit", "opensource", "opensource org licenses? mit", 1.0),
    ("gpl", "gnu", "gnu org (?:copyleft|licenses) gpl(?: [123] 0)?", 1.0),
    ("public-domain", "domain", "(?:released |dedicated )?(?:in|into|to) the public domain", 0.8),
    ("public-domain", "domain", "public domain", 0.4),
    ("proprietary", "proprietary", "proprietary and confidential", 0.6),
    ("proprietary", "permission", "without (?:the )?(?:prior |express )?(?:written )?permission", 0.5),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", 0.5),
    ("no-warranty", "warranty", "without warranty of any kind", 0.4),
)
#: A text without any of these holds no signature; each is a part of every signature it stands for.
GATE = (
    r"(?i)licen[cs]|reserved|copyright|spdx|gpl|cc0|permission|redistribution|warranty|domain|proprietary"
    r"|(?:^|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    r"|commons|redistribut"
)
#: Words of the longest text that a signature can match.
LONGEST = 24


def rules() -> list[tuple[str, str, str, float]]:
    """(label, keyword, expression, how sure), first rule first."""
    out: list[tuple[str, str, str, float]] = []
    for label, keyword, name, spdx in NAMES:
        out.append((label, spdx.split(" ")[0], f"spdx licen[cs]e identifier {spdx}", 1.0))
        out += [(label, keyword, form.format(name=name), sure) for form, sure in FORMS]
    for short, long, label in ELEMENTS:
        out.append((label, "creativecommons", f"creativecommons org licenses {short}(?: [1-4] 0)?", 1.0))
        out.append((label, "commons", f"creative commons {long}(?: [1-4] 0)?(?: international| unported)?(?: public)?(?: licen[cs]e)?", 0.95))
        out.append((label, "cc", f"cc {short}(?: [1-4] [05])?(?: licen[cs]e)?", 0.9))
    for short in ("gpl", "lgpl", "agpl"):
        for version in ("1", "2", "2 1", "3"):
            exact = f"{short}(?: v)? ?{version}(?: 0)?(?: only| or later)?"
            out.append((f"{short}-{version.replace(' ', '.')}", short, f"(?:gnu )?{exact}(?: licen[cs]e)?", 0.8))
        out.append((short, short, f"(?:gnu )?{short}(?: licen[cs]e)?", 0.6))
        out += [(short, f"{short}v{n}", f"(?:gnu )?{short}v{n}", 0.9) for n in (2, 3)]
    out += TEXTS
    out += [(label, phrase.split(" ")[-1], phrase, 0.6) for phrase, label in BASE]
    return list(dict.fromkeys(out))


def line_of(text: Column) -> Column:
    """The words of a text, one space before, between and after them."""
    lowered = F.translate(text, UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, BREAKS, " ")), F.lit(" "))


def _places(line: Column, expression: Column) -> Column:
    """Word numbers at which the expression matches; overlapping places count.

    A mark is put where a match begins, before its leading space; it ends the word before it.
    """
    marked = F.regexp_replace(line, F.concat(F.lit("(?= "), expression, F.lit(" )")), F.lit("\x01"))
    begins = F.transform(F.split(marked, " "), lambda w, i: F.when(F.endswith(w, F.lit("\x01")), i))
    return F.filter(begins, lambda i: i.isNotNull())


def _length(words: Column, start: Column, expression: Column) -> Column:
    """Words of the longest match at a place."""
    near = F.concat(F.lit(" "), F.array_join(F.slice(words, start + 1, F.lit(LONGEST)), " "), F.lit(" "))
    found = F.call_function("regexp_extract", near, F.concat(F.lit("^ (?:"), expression, F.lit(") ")), F.lit(0))
    return F.length(found) - F.length(F.replace(found, F.lit(" "), F.lit(""))) - 1


def _settle(found: Column) -> Column:
    """Detections left after containment and priority, in order of start.

    In order of (start, longest first, rule), whatever contains a detection stands before it, so
    comparing with the last one kept is enough: it reaches farthest.
    """
    none = F.slice(found, 1, 0)

    def step(kept: Column, d: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return (
            F.when(last.isNull() | (d["start"] >= last["stop"]), F.concat(kept, F.array(d)))
            .when((d["stop"] > last["stop"]) & (d["rule"] < last["rule"]), F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(d)))
            .otherwise(kept)
        )

    ordered = F.array_sort(
        F.transform(
            found,
            lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("back"), d["rule"].alias("rule"), d["stop"].alias("stop"), d["label"].alias("label"), d["sure"].alias("sure")),
        )
    )
    plain = F.transform(ordered, lambda d: F.struct(*[d[c].alias(c) for c in ("start", "stop", "rule", "label", "sure")]))
    return F.aggregate(plain, none, step)


def scan(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the identifier, ``n_words``, ``places`` and ``detections``.

    ``places``: (start, label) of every place of a base phrase, by rule and start. ``detections``:
    (start, stop, rule, label, sure) of the signatures that stand after suppression; words count from
    0, ``stop`` is the word after the last. A null or empty text has no words, places or detections.
    Identifiers are passed on as they are, null or repeated; other columns are left out, so that no
    name can clash. No shuffle takes place; each row is worked on alone.
    """
    table = F.array(
        *[
            F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(f" {keyword}").alias("keyword"), F.lit(expression).alias("expression"), F.lit(sure).alias("sure"))
            for i, (label, keyword, expression, sure) in enumerate(rules())
        ]
    )
    base = F.array(*[F.struct(F.lit(phrase).alias("phrase"), F.lit(label).alias("label")) for phrase, label in BASE])
    body = F.coalesce(F.col(text), F.lit(""))
    gated = docs.select(
        F.col(identifier).alias(identifier),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_words"),
        F.when(body.rlike(GATE), line_of(body)).alias("_line"),
    )
    line = F.col("_line")
    ruled = gated.withColumn("_rules", F.when(line.isNotNull(), F.filter(table, lambda r: F.contains(line, r["keyword"]))))
    split = ruled.withColumn("_words", F.when(F.size("_rules") > 0, F.split(F.trim(line), " ")))
    words = F.col("_words")
    found = F.flatten(
        F.transform(
            F.col("_rules"),
            lambda r: F.transform(
                _places(line, F.concat(F.lit("(?:"), r["expression"], F.lit(")"))),
                lambda s: F.struct(s.alias("start"), (s + _length(words, s, r["expression"])).alias("stop"), r["rule"].alias("rule"), r["label"].alias("label"), r["sure"].alias("sure")),
            ),
        )
    )
    places = F.flatten(
        F.transform(
            F.filter(base, lambda b: F.contains(line, b["phrase"])),
            lambda b: F.transform(_places(line, b["phrase"]), lambda s: F.struct(s.alias("start"), b["label"].alias("label"))),
        )
    )
    detected = split.select(identifier, "n_words", F.when(line.isNotNull(), places).alias("places"), F.when(F.size("_rules") > 0, found).alias("_found"))
    return detected.select(identifier, "n_words", "places", F.when(F.size("_found") > 0, _settle(F.col("_found"))).alias("detections"))


def digest(scanned: DataFrame, identifier: str = "doc_id") -> DataFrame:
    """Counts, bounds and labels per row of ``scan``; ``score`` is that of the surest detection."""
    places = F.col("places")
    empty = F.array().cast("array<string>")

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base = F.coalesce(F.transform(places, lambda p: p["label"]), empty)
    own = F.coalesce(F.transform("detections", lambda d: d["label"]), empty)
    starts = F.transform(places, lambda p: p["start"])
    return scanned.select(
        identifier,
        "n_words",
        F.greatest(F.coalesce(F.size(places), F.lit(0)), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["sure"])), F.lit(0.0)).cast("double").alias("score"),
    )
