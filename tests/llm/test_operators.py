"""Each operator against brute force on small tables with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import bpe, embeddings, host_rules, html_text, langid, lm, minhash, packing, sharding, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, word string"
rnd = random.Random(5)


def _text(n, vocab=400):
    return " ".join(f"w{rnd.randrange(vocab)}" + rnd.choice(["", ",", "."]) for _ in range(n))


def _corpus():
    base = [_text(120) for _ in range(12)]
    texts = [None, "", " \n\t ", "one", "one two three", "é" * 70 + " " + "ü" * 90, "A" * 400, "same line\n" * 60]
    for b in base:
        w = b.split()
        texts += [b, b.upper(), b, " ".join(w[:60] + ["changed"] + w[61:]), " ".join(w[:40]) + " " + _text(80)]
    hub = base[0].split()
    for i in range(80):  # a dense group larger than a small node
        j = rnd.randrange(10, 110)
        texts.append(" ".join(hub[:j] + [f"x{i}"] + hub[j + 1 :]))
    return [(i * 3 % 997, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 9 else None, len(t or ""), i, "x") for i, t in enumerate(texts)]


ROWS = _corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, none, width):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, width).collect()}
    sets = {}
    for r in ROWS:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower())
        sets[r[0]] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    uf = Sets()
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            uf.join(a, b)
    for k, s in sets.items():
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (len(s), uf.find(k), uf.find(k) == k)
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.keep_one(docs).columns == docs.columns


def test_near_duplicates_odd_ids(spark):
    t = _text(30)
    rows = [(None, t), (None, None), (7, t), (7, t), (9, "other words here now"), (9, t), (3, "other words here now")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(got) == 7
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert {r.component_id for r in got if r.doc_id is not None} == {3}  # 9 carries both texts


def test_repeats(docs, none):
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    seen = set()
    for r in sorted(ROWS):
        t = (r[1] or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(t[i : i + 100])
        kept = bytes(c for c, g in zip(t, gone) if not g)
        g = got[r[0]]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
        assert bytes(g.kept) == kept
    assert suffixes.remove_repeats(none).count() == 0
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)


def test_repeats_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    t = rnd.randbytes(3000).hex()
    passage = t[900:1400]
    ids, texts = [1, 2], [t.encode(), (t[:50] + passage + "zz").encode()]
    found = np.concatenate(list(suffixes.doc_anchors(ids, texts, 100)))
    left, spans = suffixes.split_repeats(found, 100)
    assert set(left["doc"]) == {1, 2} and len(spans) == 3


def test_language_id(spark, none):
    rows = []
    alphabets = {"aa": "abcde ", "bb": "vwxyz ", "cc": "кирлц "}
    for i in range(300):
        k = rnd.choice(list(alphabets))
        rows.append((i, "".join(rnd.choice(alphabets[k]) for _ in range(rnd.randrange(8, 300))).strip() or "a", k if i % 11 else None, "s", 1, 1, "x"))
    rows += [(1000, None, "aa", "s", 1, 1, "x"), (1001, "123 ...", "aa", "s", 1, 1, "x"), (1002, "#%^" * 300 + "a", "aa", "s", 1, 1, "x")]
    d = spark.createDataFrame(rows, SCHEMA)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = {r.doc_id: r for r in langid.identify(d, langid.train_model(d, ~held & (F.col("doc_id") < 1000))).collect()}
    right = [got[i].lang_pred == k for i, _, k, *_ in rows[:300] if k and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(right) / len(right) > 0.95
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].rejected and got[1002].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.keep_known(none).count() == 0
    assert set(r.lang_pred for r in langid.identify(d, langid.train_model(none, F.lit(True))).collect()) == {"und"}


def test_kneser_ney_sums_to_one():
    m = langid.fit({"x": ["abracadabra abba"]})
    seen = sorted(set("abracadabra abba"))
    p = [2 ** float(m.entropy(["ab" + ch])[0][0, 0] * -3 + m.entropy(["ab"])[0][0, 0] * 2) for ch in seen]
    assert 0.5 < sum(p) <= 1.001


def test_packing(docs, none):
    got = packing.pack(docs, (16, 32, 64)).collect()
    bins, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
        pieces[r.doc_id].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        used = sum(r.length for r in own)
        assert own[0].bin_capacity == next(c for c in (16, 32, 64) if c >= used)
    for r in ROWS:
        own = sorted(pieces[r[0]], key=lambda x: x.piece)
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) + 1
        assert sum(x.length for x in own) == n and [x.start for x in own] == [64 * i for i in range(len(own))]
    assert packing.pack(none).count() == 0


def test_packing_plan_is_best_fit():
    h = {7: 5, 5: 9, 3: 20, 1: 4}
    bins = {}
    for length, a, b, first, per, used in packing.plan(h, (8, 16)):
        for r in range(b - a):
            k = first + r // per
            assert bins.get(k, 0) == used + (r % per) * length
            bins[k] = bins.get(k, 0) + length
    assert sum(bins.values()) == sum(k * v for k, v in h.items()) and max(bins.values()) <= 16


def test_sharding(docs, none, spark, tmp_path):
    out, m = sharding.shard(docs)
    got = out.collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    want = {r[0]: r[1] or "" for r in ROWS}
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    for r in got:
        assert r.size == len(want[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(want[r.doc_id].encode())
    sums = [sum(r.size for r in by[s]) for s in range(8)]
    assert max(sums) - min(sums) <= max(r.size for r in got)
    m.save(spark, str(tmp_path / "maps"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "maps")) == m
    assert sharding.shard(none)[0].count() == 0
    more = m.rebalanced({i: 10 for i in range(sharding.SLOTS)}, 9)
    assert more.version == m.version + 1 and set(more.shards) == set(range(9))


def test_host_rules(docs, none):
    got = {r.doc_id: r for r in host_rules.judge(docs).collect()}
    for r in ROWS:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert g.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
    kept = host_rules.keep(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, g in got.items() if g.kept}
    assert host_rules.judge(none).count() == 0


def test_bad_host(spark):
    rows = [(i, "x " * 3 if i < 900 else _text(80), "en", "bad.example" if i < 1000 else f"h{i % 7}", 1, 1, "x") for i in range(1400)]
    got = host_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert not any(r.kept for r in got if r.source == "bad.example") and all(r.kept for r in got if r.source != "bad.example")


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    x = [base[i % 60] + rng.normal(size=16) * s for i in range(300) for s in [[0.0, 0.05, 0.12, 0.3][i % 4]]]
    rows = [(i, [float(a) for a in v], 1) for i, v in enumerate(x)]
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15]
    rows += [(1000 + i, b, 1) for i, b in enumerate(bad)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile=64).collect()}
    u = np.array(x)
    u /= np.linalg.norm(u, axis=1)[:, None]
    c = u @ u.T
    uf = Sets()
    for a, b in zip(*np.nonzero(c >= 0.9)):
        uf.join(int(a), int(b))
    for i in range(300):
        assert (got[i].n_links, got[i].component_id) == (int((c[i] >= 0.9).sum()) - 1, uf.find(i))
    for i in range(len(bad)):
        assert (got[1000 + i].n_links, got[1000 + i].component_id, got[1000 + i].kept) == (0, 1000 + i, True)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bpe(docs, none, monkeypatch):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    enc = bpe.load(path, P.PATTERN)
    for t in [_text(300), "a  b \n\n c" * 40, " " * 500, "x" * 500, "né 'll don't 12 34!!   z" * 20]:
        assert bpe.encode(enc, t) == enc.encode_ordinary(t)
    got = bpe.encode_column(docs, path, P.PATTERN).collect()
    want = {r[0]: r[1] or "" for r in ROWS}
    assert all(bytes(r.decoded).decode() == want[r.doc_id] for r in got)
    assert bpe.encode_column(none, path, P.PATTERN, digests=True).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=x>Home</a> Site name</header><nav><ul><li><a>One</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
%s<h1>Head &amp; line</h1><p>First  para&#233;graph <b>bold</b>
text.<p>Second one.<div class="ad">Buy now</div><form>Name <input> please</form><p>Third.</p>%s
<aside>Related</aside><div id="comments"><p>Reader says no.</p></div><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    want = "Head & line\nFirst paraégraph bold text.\nSecond one.\nThird."
    assert html_text.main_text(PAGE % ("<article>", "</article>")) == want
    assert html_text.main_text(PAGE % ('<main role="main">', "</main>")) == want
    long = "words of the text go on " * 12
    got = html_text.main_text(PAGE.replace("Third.", long) % ("<div class='x'>", "</div>"))
    assert got.startswith("Head & line\nFirst para") and got.endswith(long.strip()) and "cookies" not in got and "Reader" not in got
    rows = [(1, "u", None, 5), (1, "u", "", 5), (None, None, "<p>x</p>", 5), (4, "u", "<<<&&&;>", 5)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert sorted((r.text, r.n_chars) for r in got)[:2] == [("", 0), ("", 0)] and ("x", 1) in [(r.text, r.n_chars) for r in got]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    failed = {r.doc_id for r in host_rules.judge(spark.createDataFrame(ROWS, SCHEMA)).where("not kept").collect()}
    ids = {r.doc_id for r in out.collect()}
    assert ids and not ids & failed
    for r in ROWS:  # one of each group of copies stays
        same = {x[0] for x in ROWS if x[1] and r[1] and x[1].lower() == r[1].lower()}
        assert len(ids & same) <= 1
