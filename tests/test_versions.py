"""Versions: readers while a pointer is replaced, and bundles with their manifests."""

import datetime

import pytest

from tessella.operators import versions


def test_pointer_is_replaced_in_one_step(spark, tmp_path):
    root, day = str(tmp_path / "corpus"), datetime.date(2026, 3, 4)
    seen = []
    for k in range(3):
        seen.append(versions.publish(spark, root, {"chapters": spark.range(k + 1)}, day))
        assert versions.current(spark, root) == seen[-1]
        assert versions.open_corpus(spark, root)["chapters"].count() == k + 1
    assert not (tmp_path / "corpus" / "CURRENT.new").exists()


def test_bundle(spark, tmp_path):
    root, day = str(tmp_path / "corpus"), datetime.date(2026, 3, 4)
    v = versions.publish(spark, root, {"chapters": spark.range(5), "passages": spark.range(9)}, day)
    digest = versions.write_bundle(spark, root, v)
    assert digest == versions.write_bundle(spark, root, v) and versions.bundle_faults(spark, root, v).count() == 0
    folder = tmp_path / "corpus" / v / "passages"
    part = next(p for p in folder.iterdir() if p.name.startswith("part"))
    part.rename(folder / "other.parquet")
    (folder / "more.txt").write_text("x")
    faults = {r.member: (r.size is None, r.found_size is None) for r in versions.bundle_faults(spark, root, v).collect()}
    assert faults == {f"passages/{part.name}": (False, True), "passages/other.parquet": (True, False), "passages/more.txt": (True, False)}
    manifest = next(p for p in (tmp_path / "corpus" / f"{v}.manifest").iterdir() if p.suffix == ".json")
    manifest.write_text(manifest.read_text().replace('"size":', '"size":1', 1))
    (tmp_path / "corpus" / f"{v}.manifest" / f".{manifest.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="manifest"):
        versions.bundle_faults(spark, root, v)
