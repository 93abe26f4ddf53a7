"""The pipeline's stages on tables whose other columns have the names that operators use, and what they leave behind."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lexspark.operators import store

NAMES = ["_gone", "_spans", "gone", "id", "doc", "tie", "spans", "row", "host", "w", "n_words", "base_failed", "kept", "h", "key"]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stage_keeps_other_columns(spark, stage):
    rnd = random.Random(4)
    words = [f"{a}{b}" for a in ("the", "of", "and", "in", "to", "lo", "na") for b in ("", "re", "mi", "sol", "tu", "ka")]
    text = lambda: " ".join(rnd.choice(words) for _ in range(90))
    base = [text() for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate([*base, base[0], base[1] + " tail", None, "", base[2]])] + [(None, base[3], None, None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = plain.withColumns({c: F.lit(c) for c in NAMES})
    got, want = (stage[1](spark, t, "") for t in (more, plain))
    assert got.columns == more.columns
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(*plain.columns).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert got.count() and got.where(F.col("_gone") != "_gone").count() == 0
    assert stage[1](spark, more.limit(0), "").count() == 0


def test_run_leaves_one_table(spark, tmp_path):
    rnd = random.Random(5)
    words = ["the", "of", "and", "in", "to", "was", "that", "his", "with", "as", "for", "it"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(80)), "en", "s", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    before = set(store._MADE)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() >= 40 and len(set(store._MADE) - before) == 1
