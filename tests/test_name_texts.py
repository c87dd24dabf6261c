"""Name normalisation over whole documents, against the plain function."""

from __future__ import annotations

from collections import Counter

from threadmill.functions.names import normalize_name
from threadmill.plans.cleaning_queries import name_normalize_full

TEXTS = ["one two three , four – Müller..", "one two", None, "", "one two"]


def test_whole_documents_are_normalised(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("red ring",), ("red ring",)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    wanted = Counter((t, normalize_name(t)) for t in [*TEXTS, "red ring"])
    assert Counter(map(tuple, name_normalize_full(spark, str(tmp_path)).collect())) == wanted
