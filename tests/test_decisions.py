"""Decisions on many forms write the labels anew: the same rows, and nothing to look up at reading."""

from lexspark.operators import dictionary as D


def test_labels_written_anew_or_dropped_by_key(spark, tmp_path, monkeypatch):
    senses = spark.createDataFrame([(f"{f}#{p}", f, p, f"sense {p}", None, None, None, "weak") for f in ("a", "b", "c", "D") for p in (1, 2)], "id string, form string, position int, definition string, pos string, morph_base string, morph_relation string, model string")
    labels = [(f, i, 7, f"{f}#{1 + i % 2}", 1, None) for f in ("a", "b", "c", "D") for i in range(6)] + [(None, 1, 7, "x", 1, None), ("c", 9, 7, None, 1, None)]
    decisions = spark.createDataFrame([("a", "delete_entry", None, "long"), ("b", "prune", 2, None), ("D", "normalize_case", None, "d")], "form string, op string, position int, arg string").selectExpr("*", "string(null) base", "string(null) relation", "false promote")
    want = sorted((str(x[0]), x[1], str(x[3])) for x in labels if x[0] not in ("a", "D") and x[3] != "b#2")
    for most in (1000, 0):
        monkeypatch.setattr(D, "MOST_NAMED", most)
        store = D.opened(spark, f"{tmp_path}/{most}")
        D.write_entries(store, spark.createDataFrame([(f, None) for f in ("a", "b", "c", "D")], "form string, variant_of string"), senses, "2024-01-01")
        D.upsert_labels(store, spark.createDataFrame(labels, "form string, doc_id long, byte_offset long, sense_key string, rating int, updated_at timestamp"), distinct=True)
        D.apply_decisions(store, decisions, "strong", "2024-03-03")
        x = store.table("labels")
        assert sorted((str(r.form), r.doc_id, str(r.sense_key)) for r in x.collect()) == want
        if not most:
            assert len(store.snapshot().commit.parts["labels"]) == 1 and "Join" not in x._jdf.queryExecution().executedPlan().toString()
