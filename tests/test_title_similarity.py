"""Title similarity over whole tables, against brute force."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.ml.feature import HashingTF

from threadmill.functions.text import PUNCTUATION
from threadmill.operators import similarity
from threadmill.plans.matching_queries import title_similarity_ngram

TEXTS = [(0, "First line.\nThe passage lies in the second line"), (1, "Été — à la PLAGE"), (2, " \n"), (3, None), (None, "x"), (1, "something else " * 300)]
ITEMS = [(10, "other words"), (11, "a first line\nthe passage lies in the second line"), (12, ""), (13, "été à la plage")]


def vector(text):
    normal = "".join(c for c in text or "" if c not in PUNCTUATION).lower()
    if not normal.strip(" "):
        return None
    letters, tf = list(f" {normal} "), HashingTF(numFeatures=1024)
    return Counter(tf.indexOf(" ".join(letters[i : i + 3])) for i in range(len(letters) - 2))


def brute(texts, items):
    out = []
    for i, t in texts:
        for j, r in items:
            a, b = vector(t), vector(r)
            if a is None or b is None:
                out.append((i, j, None))
                continue
            size = (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
            out.append((i, j, sum(a[k] * b[k] for k in a) / size))
    return out


@pytest.mark.parametrize("block", [4096, 2])
def test_every_text_with_every_item(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(similarity, "REFERENCES_AT_ONCE", block)
    monkeypatch.setattr(similarity, "PAIRS_AT_ONCE", 5)
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    got = sorted(map(tuple, title_similarity_ngram(spark, str(tmp_path)).collect()), key=key)
    wanted = sorted(brute(TEXTS, ITEMS), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in wanted]
    assert [r[2] for r in got] == [r[2] if r[2] is None else pytest.approx(r[2], abs=2e-6) for r in wanted]
