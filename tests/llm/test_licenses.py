"""The license scan against a brute force without gate or keywords."""

from __future__ import annotations

import random
import re

import pytest

from threadmill.llm import licenses, signatures

CASES = [
    (None, "", 0.0), ("", "", 0.0), ("...!", "", 0.0), ("plain prose about a mitigation, mit anderen Worten", "", 0.0),
    ("Distributed under the GPLv3 or later.", "gpl", 0.95), ("distributed under the terms of the GPL v2", "gpl", 0.95), ("governed by the Apache 2.0", "apache", 0.95), ("released under the MPL 2.0", "mpl", 0.95),
    ("released under the MIT", "mit", 0.95), ("available under the Mozilla Public 2.0", "mpl", 0.95), ("PROPRIETARY and confidential", "proprietary", 0.6), ("placed in the public\ndomain", "public-domain", 0.6),
    ("dedicated to the public\r\n   domain", "public-domain", 0.6), ("all rights\nreserved", "copyright", 0.6), ("licensed under cc by-nc 4.0", "cc-by-nc", 0.95), ("SPDX-License-Identifier: Apache-2.0", "apache", 1.0),
    ("This is the GNU Lesser General Public License, version 2.1", "gpl,lgpl", 0.8), ("the MIT licence", "mit", 0.8), ("licenced under the Apache Licence, Version 2.0", "apache", 0.95), ("mit license apache license mit license", "apache,mit", 0.95),
    ("\U0001f600 \U0001f600 \U0001f600 \U0001f600 MIT License and then some", "mit", 0.8), ("a\u0085b c d mit license", "mit", 0.8), ("a\u2028mit license\u2029b c\u2028d apache license", "apache", 0.8), ("\u2028 mit license \u2029 b apache license", "apache,mit", 0.8),
    ("Été: \U0001f4c4general public license mit license", "mit", 0.95), ("© 2020 somebody", "copyright", 0.6), ("x" * 500_000 + " mit license", "mit", 0.8), ("word " * 40_000 + "apache license", "apache", 0.8), ("general general public license", "gpl", 0.8),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(text):
    """Base columns by looking at every place; labels by every rule on the whole text, compared in pairs."""
    w = words(text)
    places = [(i, label) for i in range(len(w)) for p, label in licenses.BASE_PHRASES if w[i : i + len(p.split())] == p.split()]
    tagged = "".join(f"<{x}>" for x in w).replace("licence", "license")
    found = []
    for r in signatures.rules():
        for m in re.finditer(r.regex, tagged):
            start = tagged[: m.start()].count("<")
            found.append((start, start + m[0].count("<"), r.tier, r.order, r.label))
    rank = lambda x: (x[0], -x[1], x[2], x[3])
    kept = [x for x in found if not any(rank(y) < rank(x) and y[1] >= x[1] and y[2] <= x[2] for y in found)]
    base = {label for _, label in places}
    score = max([licenses.TIERS[x[2]] for x in kept] + [0.8 if places else 0.0])
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[4] for x in kept})), score


def mixed(n):
    """Runs of words of the rules themselves, in all orders, with signs and other scripts between them."""
    rng = random.Random(4)
    pool = sorted({w for r in signatures.rules() for w in re.findall("[a-z0-9]{2,}", r.regex)}) + ["MIT", "License", "licence", "Été", "\U0001f600", "\u0085", "the", "under"]
    phrases = ["mit license", "Apache License", "general public license", "licensed under the", "SPDX-License-Identifier: MIT", "released under", "GPLv2 or later", "cc by sa 4.0", "all rights reserved"]
    return ["".join(rng.choice([*pool, *phrases * 9]) + rng.choice([" ", "\n", " - ", ", "]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_license_scan_equals_brute_force(spark):
    texts = [c[0] for c in CASES] + mixed(120)
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "MIT License", 7), (5, texts[5], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int")
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for r in got:
        text = "MIT License" if r["doc_id"] is None else texts[r["doc_id"]]
        assert tuple(r[c] for c in columns) == brute(text), (text or "")[:200]
        assert all(0 <= d["start_word"] < d["end_word"] <= r["n_words"] for d in r["detections"])
    by = {r["doc_id"]: r for r in got}
    assert [(by[i]["labels"], by[i]["score"]) for i in range(len(CASES))] == [c[1:] for c in CASES]


def test_license_scan_of_nothing(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures():
    found = signatures.rules()
    assert len(signatures.SIGNATURES) > 250 and len(found) == len(signatures.SIGNATURES) + len(signatures.SPDX)
    assert [r.order for r in found] == list(range(len(found))) and [r.tier for r in found] == sorted(r.tier for r in found)
    assert len({(r.label, r.regex) for r in found}) == len(found)
    for r in found:
        assert r.needs and all(f"<{w}>" in r.regex for w in r.needs)


@pytest.mark.parametrize("pattern", ["the of", "{ mit } { license }", "mit { license"])
def test_a_signature_needs_a_keyword(pattern):
    with pytest.raises(ValueError, match="no plain word"):
        signatures.compile_pattern(pattern)
