"""Catalogues that are read in several splits, against the archive's members one after the other."""

import io
import os
import random
import tarfile

import pytest

from lexspark.sources import books
from tests.test_update import _rdf


@pytest.mark.parametrize("kind", ["bz2", "gz", ""])
def test_a_catalogue_in_splits(spark, tmp_path, kind):
    rnd = random.Random(3)
    path = str(tmp_path / f"cat.tar{'.' * bool(kind)}{kind}")
    fill = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789 é") for _ in range(3000)) for _ in range(60)]
    members = []
    with tarfile.open(path, f"w:{kind}") as tar:
        for i in range(1500):
            xml = _rdf(f"ebooks/{i}", title=f"<t:title>T{i} {rnd.choice(fill)}</t:title>") if i % 50 else rnd.choice(["<broken", "", "<r/>", _rdf("ebooks/9")[:-3]])
            name = f"cache/epub/{i}/pg{i}.rdf" if i % 40 else f"cache/epub/{i}/{'long' * 30}/pg{i}.rdf"
            info = tarfile.TarInfo(name if i % 33 else f"cache/{i}.xml")
            info.size = len(xml.encode())
            tar.addfile(info, io.BytesIO(xml.encode()))
            if info.name.endswith(".rdf") and (e := books.described(xml.encode())):
                members.append((e["about"], e["title"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(os.path.getsize(path) // 9))
    try:
        rows = books.read_catalogue(spark, path)
        got = sorted((r.about, r.title) for r in rows.collect())
        parts = rows.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(members) and len(got) > 1300
    assert parts >= 8 if kind != "gz" else parts == 1
