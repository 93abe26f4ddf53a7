"""Tokens by chunks against one pass over the text, and the stored index."""

import random
import re

from pyspark.sql import functions as F

from lexspark.operators import index, postings, store


def brute(doc_id, text):
    out, at = [], 0
    for n, m in enumerate(re.finditer(r"[ \t\n\x0b\f\r]*([^\W_]+|[^ \t\n\x0b\f\r])", text or "")):
        at = len(text[: m.start(1)].encode())
        out.append((doc_id, n, m[1], at))
    return out


def test_tokens_by_chunks(spark, monkeypatch):
    rnd = random.Random(9)
    words = ["a", "Bé", "über", "ñandú", "x1", "—", "'s", "...", "\n", "\t ", "  ", "_", "w" * 90, "1,5", "漢字", "𝒳", "end."]
    texts = ["", None, " ", "w" * 500, "." * 200, "a" * 70 + "é" * 70 + " b"] + ["".join(rnd.choice(words) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 200))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [t for i, x in enumerate(texts) for t in brute(i, x)]
    for block, chunk in ((20_000, 60), (50, 7)):
        monkeypatch.setattr(index, "BLOCK", block)
        monkeypatch.setattr(index, "CHUNK", chunk)
        t = index.tokenize(docs)
        assert sorted(map(tuple, t.collect())) == want
    assert "Exchange" not in t._jdf.queryExecution().executedPlan().toString()


def test_index_is_merged_by_document(spark, tmp_path):
    s = postings.opened(spark, str(tmp_path / "i"))
    docs = spark.createDataFrame([(i, f"The cat {i} the Dog") for i in range(40)], "doc_id long, text string")
    first = postings.merge(s, docs.where("doc_id < 30"))
    assert postings.merge(s, docs.where("doc_id < 30")) == first == s.version()
    postings.merge(s, docs)
    changed = docs.where("doc_id < 5").withColumn("text", F.lit("no such word, The end"))
    postings.merge(s, changed)
    postings.remove(s, spark.createDataFrame([(39,)], "doc_id long"))
    want = sorted([("The", i, 0) for i in range(5, 39)] + [("the", i, len(f"The cat {i} ")) for i in range(5, 39)] + [("The", i, 14) for i in range(5)])
    got = lambda: sorted(map(tuple, postings.lookup(s.snapshot(), "THE").select("form", "doc_id", "byte_offset").collect()))
    assert got() == want and postings.lookup(s.snapshot(), "dog").count() == 34
    total = postings.live(s.snapshot()).count()
    postings.compact(s)
    assert got() == want and s.table("postings").count() == total
    assert {r.form for r in postings.lookup(s.snapshot(), ",").collect()} == {","}


def test_a_lookup_opens_few_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table would be one file
    try:
        _few_files(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _few_files(spark, tmp_path):
    s = postings.opened(spark, str(tmp_path / "i"))
    text = F.concat_ws(" ", F.array_repeat(F.lit("common"), 20), F.concat(F.lit("co"), (F.col("id") % 50).cast("string")), F.lit("zebra"))
    postings.merge(s, spark.range(2000).select(F.col("id").alias("doc_id"), text.alias("text")))
    holding = lambda x: {r[0] for r in x.select(F.input_file_name()).distinct().collect()}
    every, hot = holding(s.table("postings")), holding(s.table("postings").where("form_lower = 'common'"))
    assert 1 < len(hot) < len(every)  # a frequent form is several files
    x = s.table("postings").where("prefix = 'z' and form_lower = 'zebra'")
    assert x.count() == 2000 and "PartitionFilters: [isnotnull(prefix" in x._jdf.queryExecution().toString() and "EqualTo(form_lower,zebra)" in x._jdf.queryExecution().toString()
    assert holding(x) < every and all("prefix=z" in f for f in holding(x))


def test_stored_tokens_go_with_the_session(spark):
    assert all(p.startswith(store.shared_root(spark)) for p in store._MADE if "tokens-" in p)
