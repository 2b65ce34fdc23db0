"""License scans by ordered signature rules.

A rule is a regular expression over the lower-cased words of a text, a label, a
weight, and keywords of which all must occur as words before the expression
runs. Rules are ordered: where a detection's interval lies inside that of a
detection by an earlier rule, it is suppressed, so 'gnu lesser general public
license version 3' is not also reported as the shorter notices inside it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlab.llm.common import ROW
from campaignlab.llm.license_notices import NOTICES
from campaignlab.llm.wu_manber import item_words

# Phrases and labels reported whatever the rules find.
BASE = ((b"under the mit license", "mit"), (b"apache license version 2", "apache-2"), (b"cc by nc", "cc-by-nc"))

# Licence families: label, name as an expression over words, keywords, versions.
# {v} stands for the version; without versions the label stands alone.
FAMILIES = (
    ("agpl", "(?:gnu )?affero general public licen[sc]e", "affero public", "1 3"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[sc]e", "general public", "2 2.1 3"),
    ("gpl", "(?:gnu )?general public licen[sc]e", "general public", "1 2 3"),
    ("gfdl", "(?:gnu )?free documentation licen[sc]e", "documentation free", "1.1 1.2 1.3"),
    ("apache", "apache (?:software )?licen[sc]e", "apache", "1 1.1 2"),
    ("mpl", "mozilla public licen[sc]e", "mozilla", "1 1.1 2"),
    ("epl", "eclipse public licen[sc]e", "eclipse", "1 2"),
    ("edl", "eclipse distribution licen[sc]e", "eclipse", "1"),
    ("eupl", "european union public licen[sc]e", "european union", "1 1.1 1.2"),
    ("cddl", "common development and distribution licen[sc]e", "development distribution", "1 1.1"),
    ("cpl", "common public licen[sc]e", "common public", "1"),
    ("cpal", "common public attribution licen[sc]e", "attribution", "1"),
    ("artistic", "artistic licen[sc]e", "artistic", "1 2"),
    ("bsl", "boost software licen[sc]e", "boost", "1"),
    ("busl", "business source licen[sc]e", "business", "1.1"),
    ("osl", "open software licen[sc]e", "open software", "1 1.1 2 2.1 3"),
    ("afl", "academic free licen[sc]e", "academic", "1.1 1.2 2 2.1 3"),
    ("ecl", "educational community licen[sc]e", "educational", "1 2"),
    ("apsl", "apple public source licen[sc]e", "apple", "1 1.1 1.2 2"),
    ("lppl", "latex project public licen[sc]e", "latex", "1 1.1 1.2 1.3"),
    ("ofl", "(?:sil )?open font licen[sc]e", "font", "1 1.1"),
    ("odbl", "(?:odc )?open database licen[sc]e", "database", "1"),
    ("odc-by", "(?:odc|open data commons) attribution licen[sc]e", "attribution", "1"),
    ("pddl", "public domain dedication and licen[sc]e", "dedication domain", "1"),
    ("psf", "python software foundation licen[sc]e", "python", "2"),
    ("php", "php licen[sc]e", "php", "3 3.01"),
    ("zpl", "zope public licen[sc]e", "zope", "1.1 2 2.1"),
    ("qpl", "q public licen[sc]e", "q", "1"),
    ("spl", "sun public licen[sc]e", "sun", "1"),
    ("npl", "netscape public licen[sc]e", "netscape", "1 1.1"),
    ("ipl", "ibm public licen[sc]e", "ibm", "1"),
    ("upl", "universal permissive licen[sc]e", "universal", "1"),
    ("ms-pl", "microsoft public licen[sc]e", "microsoft", ""),
    ("ms-rl", "microsoft reciprocal licen[sc]e", "microsoft", ""),
    ("vim", "vim licen[sc]e", "vim", ""),
    ("w3c", "w3c software (?:notice and )?licen[sc]e", "w3c", ""),
    ("wtfpl", "do what the fuck you want to public licen[sc]e", "fuck", "2"),
    ("isc", "isc licen[sc]e", "isc", ""),
    ("zlib", "zlib(?: libpng)? licen[sc]e", "zlib", ""),
    ("unlicense", "unlicen[sc]e", "", ""),
    ("mit", "(?:mit|expat|x11) licen[sc]e", "", ""),
    ("bsd-2", "(?:2|two) clause bsd(?: licen[sc]e)?", "bsd", ""),
    ("bsd-2", "(?:simplified|freebsd) bsd licen[sc]e", "bsd", ""),
    ("bsd-3", "(?:3|three) clause bsd(?: licen[sc]e)?", "bsd", ""),
    ("bsd-3", "(?:new|revised|modified) bsd licen[sc]e", "bsd", ""),
    ("bsd-4", "(?:4|four) clause bsd(?: licen[sc]e)?", "bsd", ""),
    ("bsd", "bsd licen[sc]e", "bsd", ""),
    ("postgresql", "postgresql licen[sc]e", "postgresql", ""),
    ("openssl", "openssl licen[sc]e", "openssl", ""),
    ("ruby", "ruby licen[sc]e", "ruby", ""),
    ("ntp", "ntp licen[sc]e", "ntp", ""),
    ("sspl", "server side public licen[sc]e", "server side", "1"),
    ("elastic", "elastic licen[sc]e", "elastic", "1 2"),
    ("polyform", "polyform (?:noncommercial|small business|shield) licen[sc]e", "polyform", "1"),
    ("json", "json licen[sc]e", "json", ""),
    ("beerware", "beer ?ware licen[sc]e", "", ""),
    ("ncsa", "(?:university of illinois )?ncsa (?:open source )?licen[sc]e", "ncsa", ""),
    ("mulan", "mulan (?:permissive software|psl)(?: licen[sc]e)?", "mulan", "1 2"),
    ("cecill", "cecill(?: [bc])?(?: free software)? licen[sc]e", "cecill", "1 2 2.1"),
    ("hippocratic", "hippocratic licen[sc]e", "hippocratic", "2.1 3"),
)

# Creative Commons: label part, words of the long name, short code.
COMMONS = (("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?", "by nc nd"),
           ("by-nc-sa", "attribution non ?commercial share ?alike", "by nc sa"),
           ("by-nc", "attribution non ?commercial", "by nc"), ("by-nd", "attribution no ?deriv(?:ative)?s?", "by nd"),
           ("by-sa", "attribution share ?alike", "by sa"), ("by", "attribution", "by"))
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Notices and texts without a family.
SINGLE = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", 0.95),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 0.95),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission", 0.95),
    ("zlib", "this software is provided as is without any express or implied warranty", "warranty", 0.7),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 0.95),
    ("cc0", "cc0 1 0(?: universal)?", "cc0", 0.95),
    ("cc0", "creative commons zero", "zero", 0.9),
    ("cc0", "cc0", "cc0", 0.7),
    ("public-domain", "(?:released|dedicated|placed) (?:in ?to|to|in) the public domain", "domain", 0.8),
    ("public-domain", "public domain", "domain", 0.4),
    ("proprietary", "all rights reserved", "reserved", 0.5),
    ("proprietary", "proprietary and confidential", "proprietary", 0.7),
    ("proprietary", "confidential and proprietary", "proprietary", 0.7),
    ("proprietary", "no part of this (?:publication|document|work) may be reproduced", "reproduced", 0.7),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", "copyright", 0.3),
)


GRANT = "(?:licensed|released|distributed|available) under (?:the terms of )?(?:the |an? )?"


def version_pattern(version: str) -> str:
    """'2' also stands for '2 0', as words."""
    words = version.split(".")
    return " ".join(words) + ("(?: 0)?" if len(words) == 1 else "")


def needed_words(pattern: str, most: int = 3) -> list[str]:
    """Up to ``most`` of the longest words that every match of an expression holds: plain
    words outside groups that nothing optional touches."""
    before = None
    while pattern != before:
        before, pattern = pattern, re.sub(r"\(\?:[^()]*\)[?*+]?(?:\{[0-9,]+\})?", "\0", pattern)
    words = pattern.split(" ")
    plain = {w for w, after in zip(words, [*words[1:], ""]) if re.fullmatch("[a-z0-9]+", w) and not after.startswith("?")}
    return sorted(plain, key=lambda w: (-len(w), w))[:most]


def rules() -> list[tuple[str, re.Pattern, frozenset, float]]:
    """All rules in order of priority: tags, versioned names, names, short codes."""
    out: list[tuple[str, str, str, float]] = []
    named = [f for f in FAMILIES if f[3]]
    for label, _, _, versions in named:  # machine-readable tags
        for v in reversed(versions.split()):
            out.append((f"{label}-{v}", f"spdx licen[sc]e identifier {label.replace('-', ' ')} {version_pattern(v)}(?: (?:only|or later))?", "spdx", 1.0))
    for code, _, short in COMMONS:
        for v in COMMONS_VERSIONS:
            out.append((f"cc-{code}", f"spdx licen[sc]e identifier cc {short} {v.replace('.', ' ')}", "spdx", 1.0))
    for label, *_ in FAMILIES:
        out.append((label, f"spdx licen[sc]e identifier {label.replace('-', ' ')}", "spdx", 0.95))
    for label, name, keys, versions in named:
        for v in reversed(versions.split()):
            out.append((f"{label}-{v}", f"(?:{GRANT})?{name} (?:(?:version|v|ver) ?)?v?{version_pattern(v)}", keys, 0.9))
            out.append((f"{label}-{v}", f"version {version_pattern(v)} of the {name}", keys, 0.9))
            if label in ("gpl", "lgpl", "agpl", "mpl", "epl", "eupl", "cddl"):
                out.append((f"{label}-{v}", f"{label} ?v?{version_pattern(v)}", "", 0.7))
    for code, long, short in COMMONS:
        for v in COMMONS_VERSIONS:
            w = v.replace(".", " ")
            out.append((f"cc-{code}", f"creative commons {long} {w}(?: (?:international|unported|generic))?(?: licen[sc]e)?", "creative", 0.95))
            out.append((f"cc-{code}", f"cc {short} {w}", "cc", 0.9))
    for label, name, keys, _ in FAMILIES:
        out.append((label, f"{GRANT}{name}", keys, 0.85))
        out.append((label, name, keys, 0.6))
    for code, long, short in COMMONS:
        out.append((f"cc-{code}", f"creative commons {long}(?: licen[sc]e)?", "creative", 0.8))
        out.append((f"cc-{code}", f"cc {short}", "cc", 0.6))
    out += SINGLE
    out += [(label, p, " ".join(needed_words(p)), w) for label, w, lines in NOTICES for p in lines]
    return [(label, re.compile(rb"(?<![^ ])" + p.encode() + rb"(?![^ ])"), frozenset(k.encode() for k in keys.split()), w)
            for label, p, keys, w in out]


# A text without any of these holds no match of a rule without keywords.
GATE = (b"licens", b"licenc", b"spdx", b"gpl", b"mpl", b"epl", b"eupl", b"cddl", b"bsd", b"mulan", b"rail", b"commons", b" cc ",
        b"cc0", b"permission", b"redistribution", b"warranty", b"domain", b"reserved", b"proprietary", b"reproduced",
        b"copyright", b"unencumbered")


def detect(joined: bytes, words: set[bytes], ordered: list) -> list[tuple[int, int, str, float]]:
    """(start, end, label, weight) after suppression, in bytes of ``joined``, by rule and place.

    Kept intervals are sorted by start with the largest end up to each, so one lookup
    tells whether an earlier rule's interval contains a match; matches of one
    rule never overlap."""
    kept: list[tuple[int, int, str, float]] = []
    starts: list[int] = []
    reach: list[int] = []
    gate = any(g in joined for g in GATE)
    for label, pattern, keys, weight in ordered:
        if keys <= words if keys else gate:
            new = []
            for m in pattern.finditer(joined):
                s, e = m.span()
                at = bisect_right(starts, s) - 1
                if at < 0 or reach[at] < e:
                    new.append((s, e, label, weight))
            if new:
                kept += new
                spans = sorted((s, e) for s, e, *_ in kept)
                starts, reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
    return kept


def scan_text(text: str, ordered: list) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = item_words(text)
    joined = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in BASE:
        at = joined.find(b" " + phrase + b" ")
        while at >= 0:
            places.append(at)
            base.add(label)
            at = joined.find(b" " + phrase + b" ", at + 1)
    found = detect(joined, set(words), ordered)
    miss = 1.0
    for *_, weight in found:
        miss *= 1 - weight
    labels = base | {label for _, _, label, _ in found}
    ends = [joined.count(b" ", 0, f(places)) for f in (min, max)] if places else [None, None]
    return (len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)),
            max(1 - miss, 0.6 if base else 0.0))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Struct ``__row`` of each row of ``docs`` with struct ``found``: n_words,
    n_base, first_word, last_word (null without a base phrase), base_labels,
    labels, score (chance that any detection holds, from the rules' weights).

    Null and empty texts have no words, no labels and score 0. Repeated rows are
    scanned alike; an empty table gives an empty result; extra columns stay in
    the struct."""
    rows = docs.select(F.struct("*").alias(ROW))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ordered = rules()
        for part in parts:
            got = list(zip(*(scan_text(t, ordered) for t in part))) or [()] * len(names)
            kinds = ["int64", "int64", "Int64", "Int64", object, object, "float64"]
            yield pd.DataFrame({n: pd.Series(list(c), dtype=k) for n, c, k in zip(names, got, kinds)})

    return rows.withColumn("found", scan(F.coalesce(F.col(f"{ROW}.text").cast("string"), F.lit(""))))
