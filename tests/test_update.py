"""The update cycle, parts of speech, books, the cache and the backup."""

from __future__ import annotations

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from lexspark.operators import update
from lexspark.sources import books, readers, sinks


def _model(prompts):
    out = []
    for p in prompts:
        word = p.split("Word: ")[1].split("\n")[0]
        if p.startswith("Define"):
            out.append(json.dumps({"senses": [{"definition": f" new {word} "}, {"definition": "ONE"}, {"definition": ""}, {"definition": "odd"}]}) if word != "mute" else "no answer")
        elif p.startswith("Is "):
            out.append(json.dumps({"ok": False} if "odd" in p or "part of speech verb" in p else {}))
        elif "part of speech" in p:
            out.append(json.dumps({"pos": {"a": "noun", "b": "verb", "c": "thing"}[word]}))
        else:
            out.append(json.dumps({"sense": 2 if "2. " in p else 7 if word == "b" else 0, "rating": 1}))
    return out


def test_cycle(spark):
    occ = spark.createDataFrame([(f, i, 4, f"text {i} {f}") for f in ("a", "mute", "other") for i in range(30)] + [("b", 1, 0, "b")], "form string, doc_id long, byte_offset long, context string")
    senses = spark.createDataFrame([("a", 1, "one"), ("mute", 1, "still")], "form string, position int, definition string")
    labels = spark.createDataFrame([("a", i, 4, "a#1", 2) for i in range(20)], "form string, doc_id long, byte_offset long, sense_key string, rating int")
    targets = spark.createDataFrame([("a",), ("mute",), ("b",), ("a",), ("unseen",), (None,)], "form string")
    after, done = update.cycle(targets, occ, senses, labels, _model)
    assert sorted(map(tuple, after.collect())) == [("a", 1, "one"), ("a", 2, "new a"), ("b", 1, "new b"), ("b", 2, "ONE"), ("mute", 1, "still")]
    got = {(r.form, r.doc_id): (r.sense_key, r.rating) for r in done.collect()}
    assert len(got) == done.count() and all(got["a", i] == ("a#1", 2) for i in range(20))
    assert all(got["a", i] == ("a#2", 1) for i in range(20, 30)) and got["b", 1] == ("b#2", 1)
    assert sum(f == "mute" for f, _ in got) == update.MAX_LABELS and {v for (f, _), v in got.items() if f == "mute"} == {("0", 1)}
    assert not any(f in ("other", "unseen") for f, _ in got)
    none = update.cycle(targets.limit(0), occ, senses, labels, _model)
    assert none[0].count() == 2 and none[1].count() == 20


def test_parts_of_speech(spark):
    senses = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", "verb"), ("b", 1, "z", None), ("c", 1, "z", None)], "form string, position int, definition string, pos string")
    seen = spark.createDataFrame([("a", 1, 7, 0, "a text")], "form string, position int, doc_id long, byte_offset long, context string")
    assert [tuple(r) for r in update.tag_pos(senses, seen, _model).collect()] == [("a", "update_pos", 1, "noun")]


def _rdf(about, lang="en", kind="Text", media="text/plain; charset=utf-8", title="<t:title>T</t:title>", tag="p:ebook"):
    value = lambda name, v: f"<t:{name}><r:Description><r:value>{v}</r:value></r:Description></t:{name}>"
    ns = 'xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:t="http://purl.org/dc/terms/" xmlns:p="http://www.gutenberg.org/2009/pgterms/"'
    file = f"<t:hasFormat><p:file>{value('format', 'image/x')}</p:file></t:hasFormat><t:hasFormat><p:file>{value('format', media)}</p:file></t:hasFormat>"
    who = "<t:creator><p:agent><p:name>Who</p:name></p:agent></t:creator>" if title else ""
    return f'<r:RDF {ns}><{tag} r:about="{about}">{title}{who}{value("language", lang)}{value("type", kind)}{file}</{tag}></r:RDF>'


def test_books(spark, tmp_path):
    members = [_rdf("ebooks/1"), _rdf("ebooks/2", lang="fr"), _rdf("ebooks/3", kind="Sound"), _rdf("ebooks/4", media="text/html"), _rdf("ebooks/x"), _rdf("ebooks/5", title="", tag="r:Description"), _rdf("ebooks/6"), _rdf("ebooks/7"), "<broken", "<r/>"]
    with tarfile.open(tmp_path / "cat.tar.bz2", "w:bz2") as tar:
        for i, m in enumerate([*members, "not read"]):
            info = tarfile.TarInfo(f"{i}.rdf" if m != "not read" else "x.txt")
            info.size = len(m.encode())
            tar.addfile(info, io.BytesIO(m.encode()))
    texts = {"1": f"head\n{books.START} T ***\nbody\n{books.END} T ***\ntail", "5": " plain ", "7": f"{books.START}\n{books.END}"}
    got = books.read_books(spark, readers.Source("books", "books", str(tmp_path / "cat.tar.bz2"), "http://b/"), texts.get)
    assert sorted(map(tuple, got.collect())) == [("Book #5", "plain", None, None, "books", "http://b/5"), ("T", "body", None, "Who", "books", "http://b/1")]


def test_cache(spark, tmp_path):
    path, calls = str(tmp_path / "dump"), []

    def broken(_):
        yield b"half"
        raise OSError

    with pytest.raises(OSError):
        books.cached(spark, "u", path, broken)
    assert not (tmp_path / "dump").exists()
    for _ in range(2):
        assert books.cached(spark, "u", path, lambda u: calls.append(u) or [b"\x00\xff", b"z"]) == path
    assert (tmp_path / "dump").read_bytes() == b"\x00\xffz" and calls == ["u"]


def test_backup(spark, tmp_path):
    entries = spark.createDataFrame([("Ab", None), ("abc", "x"), ("7", "y")], "form string, note string")
    events = spark.createDataFrame([("e1", "2024-01-05"), ("e2", "2024-02-01"), ("e3", None)], "id string, at string").select("id", F.col("at").cast("timestamp").alias("created_at"))
    (tmp_path / "block.json").write_text('{"form":"x"}')
    to = str(tmp_path / "b")
    for rows in (events.where("id = 'e1'"), events.unionByName(events)):  # the second run adds what is new, once
        sinks.backup(entries, to, rows, [str(tmp_path / "block.json"), str(tmp_path / "none.json")])
    log = spark.read.json(f"{to}/mutations")
    assert sorted((r.id, str(r.month)) for r in log.collect()) == [("e1", "2024-01"), ("e2", "2024-02"), ("e3", "unknown")]
    assert {r.bucket: r.n for r in spark.read.json(f"{to}/entries").groupBy("bucket").agg(F.count("*").alias("n")).collect()} == {"a/ab": 2, "special": 1}
    assert (tmp_path / "b/lists/block.json").read_text() == '{"form":"x"}' and not (tmp_path / "b/lists/none.json").exists()
