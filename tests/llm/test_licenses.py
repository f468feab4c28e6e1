"""License rules: plain forms and context, and suppression against a plain version of it."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import licenses


def words(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).encode().split()


def labels(text):
    return sorted({f.label for f in licenses.detect(words(text))})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Apache-2.0", "apache-2"), ("Apache 2.0", "apache-2"), ("licensed under MIT", "mit"), ("dual licensed under MIT or Apache-2.0", "apache-2 mit"), ("EUPL-1.2", "eupl-1.2"), ("BSL-1.0", "bsl-1.0"), ("MulanPSL-2.0", "mulan-psl-2.0"),
        ("apache 2 helicopters", ""), ("artistic 2 years", ""), ("his curl license plate", ""), ("not licensed under the GPL v3", ""), ("It is no longer released under the MIT license.", ""), ("licensed not only under the MIT license", "mit"),
        ("This isn't licensed under the MIT license, but under the BSD license", "bsd"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2-only"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1-or-later"), ("SPDX-License-Identifier: AGPL-3.0-only", "agpl-3-only"),
        ("CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"), ("GPL-2.0 and MPL-2.0", "gpl-2 mpl-2.0"), ("a mention of MIT, and of the Apache tribe", ""), ("the license of MIT's hall", ""),
    ],
)
def test_plain_forms(text, want):
    assert " ".join(labels(text)) == want


def test_rules_by_hand():
    lines = [x for part in (licenses.SIGNATURES, licenses.PLAIN_FORMS, licenses.SENTENCES) for x in part.strip().splitlines()]
    assert len(lines) == len(set(lines)) >= 300


def plain_resolution(hits):
    ordered = licenses.rules()
    taken = []
    for h in sorted(hits):
        if not any(t.lo <= h.lo and h.hi <= t.hi for t in taken):
            taken.append(h)
    out = []
    for n, h in enumerate(taken):
        gone = False
        for k, o in enumerate(taken):
            if k != n and o.lo < h.hi and h.lo < o.hi:
                mine, its = ordered[h.rule].label, ordered[o.rule].label
                gone = gone or (k < n if mine == its else its.startswith((f"{mine}-", f"{mine}.")))
        if not gone:
            out.append(h)
    return out


def test_suppression():
    """Texts of words that make many rules overlap, resolved by comparing all pairs."""
    rng = np.random.default_rng(3)
    phrases = ["licensed under the", "under the terms of the", "gnu", "gpl", "lgpl", "gpl 2 0", "v2", "2 0 only", "3 0 or later", "version 2", "or later", "general public license", "gnu lesser general public license", "mit", "license", "bsd", "3 clause bsd", "style license", "apache", "apache 2 0", "cc by", "nc sa 4 0", "creative commons attribution", "non commercial", "spdx license identifier", "x11", "not", "and"]
    most = gone = 0
    for _ in range(400):
        text = " ".join(rng.choice(phrases, int(rng.integers(1, 25))))
        hits = licenses.matches(text)
        want = plain_resolution(hits)
        most, gone = max(most, len(hits)), gone + len(hits) - len(want)
        assert licenses.resolved(hits) == want
        found = {(f.label, " ".join(text.split()[f.first : f.last + 1])) for f in licenses.detect(text.encode().split())}
        assert found == {(licenses.rules()[h.rule].label, text[h.lo : h.hi]) for h in want}
    assert most > 10 and gone > 400


def test_scores_and_long_texts(spark):
    many = " ".join(["GPL-2.0-only, the MIT license, CC BY-NC 4.0 and under the MIT license; Apache-2.0 or later."] * 6000)
    rows = [(1, "GPLv3"), (2, many), (3, None), (3, ""), (None, "under the MIT license")]
    docs = spark.createDataFrame([(*r, "l", 0.5, 7) for r in rows], "doc_id long, text string, labels string, score double, n_base long")
    got = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(docs).collect()}
    assert len(got) == 4  # the two without words are alike
    assert got[3, 0].labels == "" and got[3, 0].score == 0
    for r in got.values():
        weights = [d.weight for d in r.detections] + [0.9] * r.n_base
        assert r.score == pytest.approx(1 - math.prod(1 - min(w, 0.999) for w in weights), abs=1e-6)
    assert got[2, 6000 * 22].labels == "apache-2,cc-by-nc,cc-by-nc-4.0,gpl-2-only,mit" and got[2, 6000 * 22].n_base == 12_000  # base labels stay
    assert licenses.scan_licenses(docs.filter(F.lit(False))).count() == 0
