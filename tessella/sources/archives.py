"""Archives (tar, gzip) as a Spark source: a partition for each archive, streamed by its task.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("tessella_archive").option("suffix", ".nxml").load(path)

A path is one archive or a folder of them, in any file system that Arrow knows. Only names are listed by the driver. A
member is one row, so that it has to fit a task; ceilings are checked while streaming, before a member is read.
"""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

#: Ceilings of an archive: members, bytes of one, bytes in all. Options lower them.
MEMBERS, MEMBER_BYTES, TOTAL_BYTES = 20_000, 64 << 20, 8 << 30


def located(path: str):
    """The file system of a path or uri, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str, endings: tuple[str, ...] = (".tar.gz", ".tgz", ".tar")) -> list[str]:
    """One archive, or those of a folder in order of their names."""
    from pyarrow import fs

    system, at = located(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = system.get_file_info(fs.FileSelector(at))
    return [f"{path.rstrip('/')}/{x.base_name}" for x in sorted(inside, key=lambda x: x.base_name) if x.type == fs.FileType.File and x.base_name.endswith(endings)]


def members(path: str, suffix: str = "", most: int = MEMBERS, member_bytes: int = MEMBER_BYTES, total_bytes: int = TOTAL_BYTES) -> Iterator[tuple[str, bytes]]:
    """Regular members with a suffix, in their order; raises beyond the ceilings. Links and devices are passed over."""
    system, at = located(path)
    total = 0
    with system.open_input_stream(at, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
        for n, m in enumerate(tar):
            if n >= most:
                raise ValueError(f"{path} has too many members")
            if not m.isfile():
                continue
            total += m.size
            if m.size > member_bytes or total > total_bytes:
                raise ValueError(f"{path} is too large when unpacked")
            if m.name.endswith(suffix):
                data = tar.extractfile(m).read(member_bytes + 1)
                if len(data) != m.size:
                    raise ValueError(f"{m.name} isn't of its declared size")
                yield m.name, data


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessella_archive"

    def schema(self) -> str:
        return "archive string, member string, short_name string, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


class ArchivePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        own = {"members": MEMBERS, "member_bytes": MEMBER_BYTES, "total_bytes": TOTAL_BYTES}
        self.limits = [min(most, int(options.get(k, options.get(k.replace("_", ""), most)))) for k, most in own.items()]

    def partitions(self) -> list[ArchivePartition]:
        return [ArchivePartition(p) for p in listed(self.path)]

    def read(self, partition: ArchivePartition):
        for member, data in members(partition.path, self.suffix, *self.limits):
            base = member.rpartition("/")[2]
            yield partition.path, member, base.rpartition(".")[0] or base, data


def archived(spark: SparkSession, path: str, suffix: str = ".nxml", **limits: int) -> DataFrame:
    """(archive, member, short_name, content) of an archive or of a folder of them."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("tessella_archive").option("suffix", suffix).options(**limits).load(path)
