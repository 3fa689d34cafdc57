"""License scan: ordered signature rules over the words of a text, in DataFrame expressions only.

A rule is a regex over words in lower case with one blank between them; it begins with a fixed word. Texts
without any gate keyword are not looked at again. In the others every word that begins some rule opens a
window, and only the rules of that word are tried on it. All of this happens inside the row, so nothing is
shuffled. Of overlapping matches one is dropped where another of at least its priority contains it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases that are always reported, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Labels and the names a license goes by, as regexes over words. A name begins with a fixed word.
NAMES: dict[str, tuple[str, ...]] = {
    "mit": ("mit", "expat", "x11"),
    "mit-0": ("mit no attribution", "mit 0"),
    "apache": ("apache software", "apache"),
    "apache-2.0": ("apache licen[cs]e v(ersion )?2( 0)?", "apache v?2( 0)?", "apache software licen[cs]e (version )?2 0", "asl 2( 0)?"),
    "apache-1.1": ("apache (software )?licen[cs]e (version )?1 1", "apache 1 1"),
    "bsd": ("bsd", "berkeley software distribution"),
    "bsd-2-clause": ("bsd 2 clause", "simplified bsd", "freebsd"),
    "bsd-3-clause": ("bsd 3 clause", "new bsd", "revised bsd", "modified bsd"),
    "bsd-4-clause": ("bsd 4 clause", "original bsd"),
    "isc": ("isc", "internet systems consortium"),
    "gpl": ("gpl", "gnu gpl", "gnu general public", "gnu public"),
    "gpl-2.0": ("gpl v?2( 0)?", "gplv2", "gnu gpl v?(ersion )?2", "gnu general public licen[cs]e v?(ersion )?2( 0)?"),
    "gpl-3.0": ("gpl v?3( 0)?", "gplv3", "gnu gpl v?(ersion )?3", "gnu general public licen[cs]e v?(ersion )?3( 0)?"),
    "lgpl": ("lgpl", "gnu lgpl", "gnu lesser general public", "gnu library general public", "lesser general public"),
    "lgpl-2.1": ("lgpl v?2( 1)?", "lgplv2", "gnu lesser general public licen[cs]e v?(ersion )?2( 1)?"),
    "lgpl-3.0": ("lgpl v?3( 0)?", "lgplv3", "gnu lesser general public licen[cs]e v?(ersion )?3( 0)?"),
    "agpl": ("agpl", "gnu agpl", "gnu affero general public", "affero general public"),
    "agpl-3.0": ("agpl v?3( 0)?", "agplv3", "gnu affero general public licen[cs]e v?(ersion )?3( 0)?"),
    "gfdl": ("gfdl", "gnu free documentation", "free documentation"),
    "mpl": ("mpl", "mozilla public", "mozilla"),
    "mpl-2.0": ("mpl 2( 0)?", "mozilla public licen[cs]e v?(ersion )?2( 0)?"),
    "epl": ("epl", "eclipse public"),
    "edl": ("edl", "eclipse distribution"),
    "cpl": ("cpl", "common public"),
    "ipl": ("ibm public",),
    "cddl": ("cddl", "common development and distribution"),
    "eupl": ("eupl", "european union public"),
    "cecill": ("cecill", "cecill [abc]"),
    "artistic": ("artistic", "perl artistic"),
    "artistic-2.0": ("artistic 2 0", "artistic licen[cs]e 2 0"),
    "zlib": ("zlib", "zlib libpng"),
    "libpng": ("libpng", "png reference library"),
    "boost": ("boost", "boost software", "bsl 1 0"),
    "wtfpl": ("wtfpl", "do what the fuck you want to public"),
    "unlicense": ("unlicense",),
    "python": ("psf", "python software foundation", "python"),
    "php": ("php",),
    "ruby": ("ruby",),
    "postgresql": ("postgresql",),
    "openssl": ("openssl", "ssleay"),
    "ofl": ("ofl", "sil open font", "open font"),
    "ms-pl": ("ms pl", "microsoft public"),
    "ms-rl": ("ms rl", "microsoft reciprocal"),
    "ncsa": ("ncsa", "university of illinois ncsa open source"),
    "afl": ("afl", "academic free"),
    "osl": ("osl", "open software"),
    "apsl": ("apsl", "apple public source"),
    "qpl": ("qpl", "q public"),
    "w3c": ("w3c", "w3c software"),
    "odbl": ("odbl", "open database", "open data commons open database"),
    "pddl": ("pddl", "open data commons public domain dedication and"),
    "odc-by": ("odc by", "open data commons attribution"),
    "cc0": ("cc0", "cc zero", "creative commons zero", "creative commons cc0"),
    "cc": ("creative commons",),
    "cc-by": ("cc by", "creative commons attribution"),
    "cc-by-sa": ("cc by sa", "creative commons attribution share ?alike"),
    "cc-by-nc": ("cc by nc", "creative commons attribution non ?commercial"),
    "cc-by-nd": ("cc by nd", "creative commons attribution no ?deriv(ative)?s?( works)?"),
    "cc-by-nc-sa": ("cc by nc sa", "creative commons attribution non ?commercial share ?alike"),
    "cc-by-nc-nd": ("cc by nc nd", "creative commons attribution non ?commercial no ?deriv(ative)?s?( works)?"),
    "openrail": ("openrail( m)?", "bigscience rail", "creativeml open ?rail( m)?"),
    "llama": ("llama [234]( community)?", "meta llama [234]"),
}

# Sentences that give a license, as rules of their own. They begin with a word that is not in every text.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy",),
    "isc": ("permission to use copy modify and or distribute this software for any purpose",),
    "bsd": ("redistribution and use in source and binary forms with or without modification",),
    "bsd-3-clause": ("neither the name of [a-z0-9 ]{1,60} nor the names of its contributors",),
    "apache-2.0": ("file except in compliance with the licen[cs]e",),
    "gpl": ("program is free software you can redistribute it and or modify", "software foundation either version [23]"),
    "mpl-2.0": ("source code form is subject to the terms of the mozilla public licen[cs]e",),
    "boost": ("permission is hereby granted free of charge to any person or organization obtaining",),
    "zlib": ("software is provided as is without any express or implied warranty in no event will the authors",),
    "public-domain": ("public domain", "dedicated to the public domain", "released into the public domain"),
    "reserved": ("all rights reserved", "rechte vorbehalten", "droits réservés", "derechos reservados"),
    "proprietary": ("proprietary and confidential", "unauthorized copying of this file", "licen[cs]ed not sold", "publication may be reproduced"),
    "copyright": ("copyright c? ?[12][0-9]{3}", "copyright by"),
    "non-commercial": ("non commercial use only", "noncommercial use only", "research purposes only"),
}

# How a text grants a license, before its name; the number is the priority of such a match.
GRANTS = (
    "licen[cs]ed under( the)?( terms of)?( the)?", "released under( the)?( terms of)?( the)?",
    "distributed under( the)?( terms of)?( the)?", "available under( the)?( terms of)?( the)?",
    "published under( the)?", "provided under( the)?", "subject to( the)?( terms of)?( the)?", "spdx licen[cs]e identifier",
)
GRANT, SENTENCE, NAMED, BARE = 4, 3, 2, 1
CONFIDENCE = {GRANT: 0.98, SENTENCE: 0.9, NAMED: 0.8, BARE: 0.4}
#: Names that say enough alone. The others count only with a grant before them or "license" after them.
ALONE = re.compile(r"(gnu (lesser |affero )?(gpl|general public)|[la]?gpl|gfdl|cc0|cc by|cc zero|creative commons|wtfpl|cddl|eupl|odbl|pddl|cecill|openrail)")

#: Words of a window. The longest rule spans fewer.
WINDOW = 24
# Texts that hold none of these in lower case can't match a rule; a test holds all rules against them.
GATES = (
    "licen", "copyright", "reserv", "gpl", "gfdl", "gnu", "spdx", "under", "subject", "permission", "redistribut", "contributors",
    "foundation", "provided", "domain", "vorbehalten", "droits", "proprietary", "unauthorized", "reproduced", "commercial",
    "purposes", "commons", "wtfpl", "cddl", "eupl", "odbl", "pddl", "cecill", "openrail", "general",
)
#: The same for names that begin with the word "cc", which is part of many words.
GATE_CC = r"(?:^|[\x00-\x2F\x3A-\x60\x7B-\x7F])cc(?:0|[\x00-\x2F\x3A-\x60\x7B-\x7F]+(?:by|zero))"

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def rules() -> list[tuple[str, str, str, int]]:
    """``(first word, regex, label, priority)`` of every rule, made from names, sentences and grants."""
    made = []

    def add(pattern: str, label: str, priority: int) -> None:
        first = pattern.split(" ")[0]
        for word in ([first.replace("[cs]", "c"), first.replace("[cs]", "s")] if "[cs]" in first else [first]):
            if word.isalnum():
                made.append((word, pattern, label, priority))
                continue
            for spelt in _spellings(word):
                made.append((spelt, pattern, label, priority))

    for label, names in NAMES.items():
        for name in names:
            for grant in GRANTS:
                add(f"{grant} {name}", label, GRANT)
            add(f"{name} (public |software )?licen[cs]e", label, NAMED)
            if ALONE.match(name):
                add(name, label, BARE)
    for label, sentences in SENTENCES.items():
        for sentence in sentences:
            add(sentence, label, SENTENCE)
    return sorted(set(made))


def _spellings(word: str) -> list[str]:
    """All words that a first word with optional parts ``x?`` or ``( x)?`` cut off at its blank can be."""
    plain = word.split("(")[0]
    at = plain.find("?")
    if at < 0:
        return [plain]
    return [s for kept in (plain[: at - 1], plain[:at]) for s in _spellings(kept + plain[at + 1 :])]


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan_licenses(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, ``n_words``, ``base_at`` (starts of base phrases), ``base_labels`` and ``found``.

    ``found`` lists the matches that remain as ``start, words, label, priority``, by place; starts count words
    from 0. Words are as in the contract of the query: A-Z in lower case, any other letter as it is.
    Null and empty texts have no words and no matches; null ids and repeated rows keep their rows;
    other columns are ignored. Texts are processed whole.
    """
    table = rules()
    by_word: dict[str, list[str]] = {}
    for word, pattern, label, priority in table:
        by_word.setdefault(word, []).append(
            f"named_struct('p', {_text(f'^({pattern})(?: |$)')}, 'label', {_text(label)}, 'priority', {priority})"
        )
    for phrase in BASE:
        by_word.setdefault(phrase.split(" ")[0], [])
    anchors = ", ".join(_text(w) for w in sorted(by_word))
    keyed = ", ".join(_text(w) for w, rs in sorted(by_word.items()) if rs)
    listed = ", ".join(f"array({', '.join(rs)})" for _, rs in sorted(by_word.items()) if rs)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    some_gate = F.col("_low").contains("cc") & F.col("_low").rlike(GATE_CC)
    for gate in GATES:
        some_gate = some_gate | F.col("_low").contains(gate)
    read = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    counted = read.select("doc_id", "_text", F.regexp_count("_text", F.lit(ANY_CASE_WORD)).cast("bigint").alias("n_words"), F.lower("_text").alias("_low"))
    worded = counted.withColumn("_words", F.when(some_gate, F.regexp_extract_all(F.translate("_text", upper, lower), F.lit(f"({WORD})"))))
    opened = worded.select(
        "doc_id", "n_words",
        F.expr(
            f"transform(filter(sequence(0, size(_words) - 1), i -> size(_words) > 0 AND _words[i] IN ({anchors})), i -> "
            f"named_struct('at', CAST(i AS BIGINT), 'word', _words[i], 'text', array_join(slice(_words, i + 1, {WINDOW}), ' ')))"
        ).alias("_windows"),
    )
    opened = opened.withColumn("_windows", F.expr("coalesce(_windows, array())"))
    base = " ".join(
        f"WHEN w.text = {_text(p)} OR startswith(w.text, {_text(p + ' ')}) THEN {_text(label)}" for p, label in BASE.items()
    )
    tried = opened.select(
        "doc_id", "n_words",
        F.expr(f"filter(transform(_windows, w -> named_struct('at', w.at, 'label', CASE {base} END)), b -> b.label IS NOT NULL)").alias("_base"),
        F.expr(
            "filter(transform(_windows, w -> array_distinct(transform(filter(transform("
            f"coalesce(element_at(map_from_arrays(array({keyed}), array({listed})), w.word), array()), r -> named_struct("
            "'label', r.label, 'priority', r.priority, 'hit', regexp_extract(w.text, r.p, 1))), t -> t.hit != ''), t -> named_struct("
            "'start', w.at, 'words', CAST(size(split(t.hit, ' ')) AS BIGINT), 'label', t.label, 'priority', t.priority)))), h -> size(h) > 0)"
        ).alias("_hits"),
    )
    # What contains a match starts at most a window before it: only the places just before are looked at.
    before = f"slice(_hits, greatest(j + 2 - {WINDOW}, 1), least(j + 1, {WINDOW}))"
    stronger = "c.priority >= m.priority AND c.start + c.words >= m.start + m.words"
    first = "(c.start < m.start OR c.words > m.words OR c.priority > m.priority OR c.label < m.label)"
    return tried.select(
        "doc_id", "n_words",
        F.expr("transform(_base, b -> b.at)").alias("base_at"),
        F.expr("array_sort(array_distinct(transform(_base, b -> b.label)))").alias("base_labels"),
        F.expr(
            f"flatten(transform(_hits, (h, j) -> array_sort(filter(h, m -> NOT exists({before}, e -> exists(e, c -> "
            f"{stronger} AND {first}))), (a, b) -> CASE WHEN a.words != b.words THEN IF(a.words > b.words, -1, 1) "
            "WHEN a.priority != b.priority THEN IF(a.priority > b.priority, -1, 1) "
            "WHEN a.label != b.label THEN IF(a.label < b.label, -1, 1) ELSE 0 END)))"
        ).alias("found"),
    )


def license_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``; see ``scan_licenses``.

    The score is that of the surest match: a grant before a license, a sentence of one, its name, a bare mention.
    """
    score = " ".join(f"WHEN m.priority = {p} THEN {c}D" for p, c in CONFIDENCE.items())
    return scan_licenses(docs).select(
        "doc_id", "n_words",
        F.size("base_at").cast("bigint").alias("n_base"),
        F.array_min("base_at").alias("first_word"),
        F.array_max("base_at").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.expr("array_join(array_sort(array_union(base_labels, transform(found, m -> m.label))), ',')").alias("labels"),
        F.expr(f"coalesce(array_max(transform(found, m -> CASE {score} END)), IF(size(base_at) > 0, 0.9D, 0D))").alias("score"),
    )
