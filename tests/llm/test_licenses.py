import random
import re

import pytest

from campaignlab.llm.license_notices import NOTICES
from campaignlab.llm.licenses import GATE, detect, rules, scan_licenses, scan_text
from campaignlab.llm.queries import op10_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_on_test_data(spark, sf01):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    got = op10_licenses(spark, sf01).collect()
    assert len(got) == len(text)
    for r in got:
        assert tuple(r)[1:6] == brute(text[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
    assert any(r["n_base"] for r in got)


@pytest.mark.parametrize("text, labels", [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("GNU Lesser General Public License version 2.1", "lgpl-2.1"),
    ("under the GNU Affero General Public License v3.0", "agpl-3"),
    ("Licensed under the Apache License, Version 2.0", "apache-2"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2"),
    ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "cc-by-nc-sa"),
    ("released under the MIT License", "mit"), ("mit", ""), ("emit licensee", ""), ("", ""),
    ("cc by nc sa 4.0", "cc-by-nc,cc-by-nc-sa")])
def test_labels(text, labels):
    assert scan_text(text, rules())[5] == labels


def test_rules_are_many_and_gated():
    ordered = rules()
    assert len(ordered) > 300
    assert sum(len(x) for *_, x in NOTICES) >= 200  # written out, not made from versions
    for label, pattern, keys, weight in ordered:
        assert 0 < weight <= 1
    joined = b" the 3 clause bsd license "
    got = detect(joined, set(joined.split()), ordered)
    assert [x[2] for x in got] == ["bsd-3"]  # 'bsd license' lies inside


def sample(tree, rng):
    """A random text that a parsed expression matches."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            kinds = [(k, v) for k, v in ((str(k), v) for k, v in arg) if k in ("LITERAL", "RANGE")]
            negated = str(arg[0][0]) == "NEGATE"
            k, v = rng.choice(kinds)
            out += "q" if negated else chr(v) if k == "LITERAL" else chr(rng.randint(*v))
        elif op == "NOT_LITERAL":
            out += "q"
        elif op == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif op == "SUBPATTERN":
            out += sample(arg[-1], rng)
        elif op == "MAX_REPEAT":
            low, high, inner = arg
            out += "".join(sample(inner, rng) for _ in range(rng.randint(low, min(int(high), low + 3))))
        else:
            assert op == "ASSERT_NOT", op
    return out


def test_gate_and_keywords_hide_no_rule():
    """Texts made from the rules themselves, gated against ungated."""
    from re import _parser

    rng, ordered = random.Random(3), rules()
    for label, pattern, keys, _ in ordered:
        tree = _parser.parse(pattern.pattern.decode())
        for _ in range(6):
            joined = (" " + " ".join(sample(tree, rng).split()) + " ").encode()
            assert pattern.search(joined), (label, joined)
            words = set(joined.split())
            assert keys <= words if keys else any(g in joined for g in GATE), (label, joined)


def every_pair(matches):
    """Suppression by comparing each match with all kept before it."""
    kept = []
    for s, e, label, weight in matches:
        if not any(a <= s and e <= b for a, b, *_ in kept):
            kept.append((s, e, label, weight))
    return kept


def test_suppression_equals_comparing_all():
    rng = random.Random(9)
    words = ["cc0", "bsd", "license", "gnu", "general", "public", "2", "version", "the", "x", "all", "rights", "reserved", "3", "clause", "new"]
    ordered = rules()
    hits = 0
    for _ in range(250):
        joined = (" " + " ".join(rng.choices(words, k=rng.randrange(1, 60))) + " ").encode()
        held, gate = set(joined.split()), any(g in joined for g in GATE)
        every = [(*m.span(), label, w) for label, p, keys, w in ordered if (keys <= held if keys else gate) for m in p.finditer(joined)]
        assert detect(joined, held, ordered) == every_pair(every)
        hits += len(every)
    assert hits > 300


def test_long_texts_take_linear_time():
    import time

    ordered = rules()
    for unit in ("cc0 word ", "all rights reserved word ", "gpl 2 under the mit license "):
        took = []
        for size in (50_000, 200_000):
            text = unit * (size // len(unit))
            start = time.process_time()
            scan_text(text, ordered)
            took.append(time.process_time() - start)
        assert took[1] < 8 * took[0] + 0.2, unit


def test_odd_rows(make, odd):
    rows = odd + [(30, "Under THE MIT license under the mit license"), (31, "cc by nc by nc cc by nc")]
    got = scan_licenses(make(rows)).select("__row.doc_id", "__row.text", "found.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:7] == brute(r["text"])
    assert scan_licenses(make([])).count() == 0


def test_the_british_name_alone():
    assert "unlicense" in scan_text("released under the unlicence", rules())[5]
