"""Counts of forms and coverage: results against brute force, and what is stored."""

import re
from collections import Counter

from lexspark.operators import index
from lexspark.plans import derived as T
from lexspark.plans.catalogue import QUERIES


def test_forms_are_counted_alike_in_documents_and_segments(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 700)
    texts = ["", None, " \t", "ab " * 333, "x" * 90 + "é,漢 𝒳", " \n".join(f"w{i}é" for i in range(500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(Counter(m[1] for x in texts for m in re.finditer(r"[ \t\n\x0b\f\r]*([^\W_]+|[^ \t\n\x0b\f\r])", x or "")).items())
    assert sorted(map(tuple, index.form_counts(docs).collect())) == want
    assert sorted(map(tuple, index.form_counts(docs, index.segments(docs)).collect())) == want


def test_coverage_counts_documents_and_makes_no_segments(spark, tmp_path):
    rows = [(i, " ".join(["Lexicon", "the", "of", "§"][(i * k) % 4] for k in range(400)), f"s{i % 3}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    first = set(T._STORED)
    got = {r.bucket: (r.covered, r.uncovered) for r in QUERIES["coverage_buckets"](spark, str(tmp_path)).collect()}
    assert {k[0] for k in set(T._STORED) - first} == {"counts", "vocab"}
    n = Counter(w.lower() for _, x, _ in rows for w in x.split() if w != "§")
    assert got == {b: (c, 0) for b, (_, c) in enumerate(n.most_common())}
