"""Archives as a data source: rows, ranges, and filters that leave members unopened."""

import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringContains, StringEndsWith, StringStartsWith

from loomspan.sources.archives import ArchiveReader, register_archives


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    place = tmp_path_factory.mktemp("archives")
    for a in ("one", "two"):
        with zipfile.ZipFile(place / f"{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for i in range(40):
                z.writestr(f"pages/p{i}.html", f"{a} {i} " * 50)
            z.writestr("styles/main.css", "p{}")
            z.writestr("../outside.txt", "no")
            z.writestr("/etc/absolute.txt", "no")
            z.writestr("big.bin", "x" * 5000)
    (place / "broken.zip").write_bytes(b"no archive")
    (place / "other.txt").write_text("x")
    return str(place)


def test_all_members_are_rows(spark, folder):
    register_archives(spark)
    x = spark.read.format("archives").option("range", "2000").load(folder)
    rows = x.select("path", "member", "n_bytes", F.octet_length("content").alias("n")).collect()
    assert len(rows) == 2 * 42 and all(r.n_bytes == r.n for r in rows) and not any("outside" in r.member or "absolute" in r.member for r in rows)
    assert x.where("path like '%one.zip' and member = 'pages/p7.html'").first().content == b"one 7 " * 50
    assert spark.read.format("archives").option("most", "1000").load(f"{folder}/one.zip").where("member = 'big.bin'").count() == 0
    assert spark.read.format("archives").load(f"{folder}/broken.zip").count() == 0


def test_filters_reach_the_reader(spark, folder):
    register_archives(spark)
    x = spark.read.format("archives").load(folder).where("member = 'styles/main.css'")
    assert {r.content for r in x.collect()} == {b"p{}"} and x.count() == 2
    assert spark.read.format("archives").load(folder).where("member like 'pages/p1%' and member like '%9.html'").count() == 2


def test_only_wanted_members_are_in_partitions(folder):
    names = lambda r: [n for p in r.partitions() for n in p.names]
    whole = ArchiveReader({"path": folder, "range": "1000"})
    assert len(whole.partitions()) > 20 and len(names(whole)) == 84
    reader = ArchiveReader({"path": folder})
    left = list(reader.pushFilters([EqualTo(("member",), "pages/p3.html"), StringContains(("member",), "p"), EqualTo(("n_bytes",), 3), StringEndsWith(("path",), "two.zip")]))
    assert [type(f) for f in left] == [StringContains, EqualTo] and names(reader) == ["pages/p3.html"]
    reader = ArchiveReader({"path": folder})
    assert not list(reader.pushFilters([StringStartsWith(("member",), "styles/")])) and names(reader) == ["styles/main.css"] * 2
    nothing = ArchiveReader({"path": folder})
    assert not list(nothing.pushFilters([EqualTo(("member",), "none")])) and names(nothing) == [] and list(nothing.read(nothing.partitions()[0])) == []
