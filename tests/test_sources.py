"""Readers on small files."""

import bz2

import pytest
from pyspark.sql import functions as F

from lexspark.sources import readers as R

DUMP = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">
<page><title>A b</title><ns>0</ns><revision><timestamp>2011-05-01T00:00:00Z</timestamp><contributor><username>Al</username></contributor><text xml:space="preserve">'''Bold''' [[x|y]] {{t|{{u}}}} %s</text></revision></page>
<page><title>C</title><ns>0</ns><revision><timestamp>2012-05-01T00:00:00Z</timestamp><text>{{header | year = 1850}} %s</text></revision></page>
<page><title>D</title><ns>0</ns><redirect title="A b"/><revision><timestamp>2012-05-01T00:00:00Z</timestamp><text>gone</text></revision></page>
<page><title>Talk:E</title><ns>1</ns><revision><timestamp>2012-05-01T00:00:00Z</timestamp><text>gone</text></revision></page>
</mediawiki>""" % ("word " * 60, "verse " * 60)


def test_dump_to_corpus(spark, tmp_path):
    p = tmp_path / "dump.xml.bz2"
    p.write_bytes(bz2.compress(DUMP.encode()))
    pages = R.read(spark, R.Source("w", "wiki", str(p)))
    assert {(r.title, r.year, r.author) for r in pages.collect()} == {("A b", 2011, "Al"), ("C", 1850, None)}
    docs = R.to_docs(pages, "https://example.org/wiki/", digits=8)
    got = {r.title: r for r in docs.collect()}
    assert got["A b"].source_url == "https://example.org/wiki/A_b" and got["A b"].text.startswith("Bold y") and len(got["C"].doc_id) == 8
    corpus = str(tmp_path / "corpus")
    assert (R.append(docs, corpus), R.append(docs, corpus)) == (2, 0)
    R.write_jsonl(pages, str(tmp_path / "pages"))
    assert R.read(spark, R.Source("w", "jsonl", str(tmp_path / "pages"))).count() == 2
    with pytest.raises(ValueError):
        R.read(spark, R.Source("w", "other", ""))


def test_hub_and_books(spark, tmp_path):
    rows = [("t", "text", "1999-01-01", "u"), ("t", " ", "1999", "u"), ("t", "x", "soon", None)]
    spark.createDataFrame(rows, "title string, text string, date string, url string").write.parquet(str(tmp_path / "h"))
    assert [r.year for r in R.read(spark, R.Source("h", "hub", str(tmp_path / "h"))).orderBy("text").collect()] == [1999, None]
    b = spark.createDataFrame([("licence\n*** START OF x ***\nBody\ntext\n*** END OF x ***\nmore",), ("plain",)], "t string")
    assert [r[0] for r in b.select(R.strip_book(F.col("t"), "*** START OF", "*** END OF")).collect()] == ["Body\ntext", "plain"]
