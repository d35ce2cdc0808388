"""Archives as a source, and bundles written, refused and restored."""

import datetime
import io
import tarfile

import pytest

from tessella.operators import bundles, versions
from tessella.sources import archives


def packed(path, entries, mode="w:gz"):
    with tarfile.open(path, mode) as tar:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))


def test_a_partition_for_each_archive(spark, tmp_path):
    packed(tmp_path / "a.tar.gz", [("x/one.nxml", b"1"), ("x/link.nxml", None), ("x/skip.txt", b"no"), ("two.nxml", b"22")])
    packed(tmp_path / "b.tar", [("../three.nxml", b""), ("noext", b"n")], "w")
    (tmp_path / "c.zip").write_bytes(b"no archive")
    df = archives.archived(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 2
    got = sorted((r.member, r.short_name, bytes(r.content)) for r in df.collect())
    assert got == [("../three.nxml", "three", b""), ("two.nxml", "two", b"22"), ("x/one.nxml", "one", b"1")]
    assert archives.archived(spark, f"file://{tmp_path}/b.tar", suffix="").count() == 2


@pytest.mark.parametrize("limits", [{"members": 1}, {"member_bytes": 9}, {"total_bytes": 15}])
def test_ceilings(spark, tmp_path, limits):
    packed(tmp_path / "a.tar.gz", [("a.nxml", b"x" * 10), ("b.nxml", b"y" * 10)])
    assert archives.archived(spark, str(tmp_path / "a.tar.gz")).count() == 2
    with pytest.raises(Exception, match="too many members|too large"):
        archives.archived(spark, str(tmp_path / "a.tar.gz"), **limits).count()
    # Options can't raise them.
    reader = archives.ArchiveReader({"path": "x", "members": str(10**9)})
    assert reader.limits == [archives.MEMBERS, archives.MEMBER_BYTES, archives.TOTAL_BYTES]


def test_broken_archives(spark, tmp_path):
    packed(tmp_path / "a.tar.gz", [("a.nxml", b"x" * 100_000)])
    (tmp_path / "b.tar.gz").write_bytes((tmp_path / "a.tar.gz").read_bytes()[:-60])
    with pytest.raises(Exception, match="(?s).+"):
        archives.archived(spark, str(tmp_path / "b.tar.gz")).count()
    with pytest.raises(Exception, match="nowhere"):
        archives.archived(spark, str(tmp_path / "nowhere")).count()


@pytest.fixture
def bundle(spark, tmp_path):
    root = str(tmp_path / "corpus")
    v = versions.publish(spark, root, {"chapters": spark.range(5), "passages": spark.range(900).repartition(3)}, datetime.date(2026, 3, 4))
    target = str(tmp_path / "b.tar")
    return root, v, target, bundles.write_bundle(spark, root, v, target)


def test_round_trip(spark, tmp_path, bundle):
    root, v, target, sha = bundle
    assert (tmp_path / "b.tar.sha256").read_text() == f"{sha}  b.tar\n"
    assert bundles.write_bundle(spark, root, v, str(tmp_path / "again.tar")) == sha
    other = str(tmp_path / "other")
    got = bundles.restore(spark, target, other, datetime.date(2026, 5, 6), sha256=sha.upper())
    assert got == "2026-05-06" == versions.current(spark, other)
    tables = versions.open_corpus(spark, other)
    assert {k: t.count() for k, t in tables.items()} == {"chapters": 5, "passages": 900}
    assert bundles.restore(spark, target, other, datetime.date(2026, 5, 6), sha256=sha) == "2026-05-06-r2"


def entries(path):
    with tarfile.open(path) as tar:
        return [(m.name, tar.extractfile(m).read()) for m in tar]


@pytest.mark.parametrize(
    "change, why",
    [
        (lambda e: e[:-1], "missing"),
        (lambda e: [*e, ("chapters/part-x.parquet", b"x")], "not declared"),
        (lambda e: [*e, e[-1]], "twice"),
        (lambda e: [*e[:-1], (e[-1][0], e[-1][1][:-1] + b"!")], "manifest says"),
        (lambda e: [*e[:-1], (e[-1][0], e[-1][1] + b"!")], "declared size"),
        (lambda e: e[1:], "begins with its manifest"),
        (lambda e: [(e[0][0], e[0][1].replace(b"chapters/part-", b"../../chapters/part-")), *e[1:]], "can't be part"),
        (lambda e: [(e[0][0], b"{}"), *e[1:]], "can't be read"),
        (lambda e: [*e, ("chapters/link", None)], "regular file"),
        (lambda e: [], "empty"),
    ],
)
def test_refused_before_anything_loads(spark, tmp_path, bundle, change, why):
    """Even if the digest is that of the changed archive."""
    import hashlib

    packed(tmp_path / "bad.tar", change(entries(bundle[2])), "w")
    sha = hashlib.sha256((tmp_path / "bad.tar").read_bytes()).hexdigest()
    other = tmp_path / "other"
    with pytest.raises(ValueError, match=why):
        bundles.restore(spark, str(tmp_path / "bad.tar"), str(other), datetime.date(2026, 5, 6), sha256=sha)
    assert not other.exists()


def test_the_digest_comes_first(spark, tmp_path, bundle):
    for sha in ("0" * 64, "", "xyz"):
        with pytest.raises(ValueError, match="SHA-256|is meant"):
            bundles.restore(spark, bundle[2], str(tmp_path / "other"), datetime.date(2026, 5, 6), sha256=sha)
    assert not (tmp_path / "other").exists()
