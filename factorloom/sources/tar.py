"""Parquet files inside tar archives, read where they lie: a Spark data source whose partitions are members by offset and length."""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from factorloom.sources.store import Store
from factorloom.sources.tables import settled


def opened(path: str):
    fs, where = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs.open_input_file(where)


class Part(io.RawIOBase):
    """Some bytes of a file as a file of their own."""

    def __init__(self, file, start: int, size: int):
        super().__init__()
        self.file, self.start, self.size, self.at = file, start, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = min(self.size, max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]))
        return self.at

    def read(self, size: int = -1) -> bytes:
        size = self.size - self.at if size is None or size < 0 else min(size, self.size - self.at)
        self.file.seek(self.start + self.at)
        data = self.file.read(size)
        self.at += len(data)
        return data


@dataclass(frozen=True)
class Member(InputPartition):
    """A file of an archive: where its bytes are."""

    archive: str
    name: str
    start: int
    size: int


def members(path: str) -> list[Member]:
    """The files of an archive, from its headers alone: what lies between is skipped, not read."""
    with opened(path) as file:
        try:
            with tarfile.open(fileobj=file, mode="r:") as tar:
                return [Member(path, x.name.removeprefix("./"), x.offset_data, x.size) for x in tar if x.isfile()]
        except tarfile.ReadError as e:
            raise ValueError(f"{path} is no tar archive without compression: {e}") from None


def content(member: Member) -> bytes:
    with opened(member.archive) as file:
        return Part(file, member.start, member.size).read()


def beyond(group, names: Sequence[str], start, end) -> bool:
    """Whether a row group's statistics say that no date is in the span."""
    for i, n in enumerate(names):
        stats = group.column(i).statistics
        if n == "date" and stats is not None and stats.has_min_max:
            return start is not None and str(stats.max)[:10] < str(start)[:10] or end is not None and str(stats.min)[:10] > str(end)[:10]
    return False


class MembersReader(DataSourceReader):
    """Row groups of Parquet members: only the wanted columns, and groups whose dates may be in the span."""

    def __init__(self, found: list[Member], columns: list[str], start: str | None, end: str | None):
        self.found, self.columns, self.start, self.end = found, columns, start, end

    def partitions(self) -> list[Member]:
        return self.found

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        with opened(partition.archive) as file:
            table = pq.ParquetFile(Part(file, partition.start, partition.size))
            names = table.schema_arrow.names
            groups = [g for g in range(table.num_row_groups) if not beyond(table.metadata.row_group(g), names, self.start, self.end)]
            for batch in table.iter_batches(row_groups=groups, columns=self.columns, batch_size=16_384) if groups else ():
                yield batch.select(self.columns)


class ParquetInTar(DataSource):
    """``format("parquet_in_tar")``: options ``members`` (JSON of archive, name, start, size), ``columns`` (JSON), ``start`` and ``end``."""

    @classmethod
    def name(cls) -> str:
        return "parquet_in_tar"

    def _found(self) -> list[Member]:
        return [Member(*x) for x in json.loads(self.options["members"])]

    def schema(self):
        first = self._found()[0]
        with opened(first.archive) as file:
            whole = pq.read_schema(Part(file, first.start, first.size))
        wanted = json.loads(self.options["columns"]) if "columns" in self.options else whole.names
        return from_arrow_schema(pa.schema([whole.field(n).remove_metadata() for n in wanted]))

    def reader(self, schema) -> MembersReader:
        return MembersReader(self._found(), [f.name for f in schema.fields], self.options.get("start"), self.options.get("end"))


def scan_members(spark: SparkSession, found: Sequence[Member], columns: Sequence[str] | None = None, start=None, end=None) -> DataFrame:
    """The rows of Parquet members, a task each; row groups outside the dates and columns that aren't named are not read.

    Rows of a group that is partly outside stay; a filter on top takes them away.
    """
    if not found:
        raise ValueError("no members to read")
    spark.dataSource.register(ParquetInTar)
    read = spark.read.format("parquet_in_tar").option("members", json.dumps([(m.archive, m.name, m.start, m.size) for m in found]))
    for k, v in (("columns", json.dumps(list(columns)) if columns is not None else None), ("start", start), ("end", end)):
        if v is not None:
            read = read.option(k, str(v))
    return read.load()


class TarStore(Store):
    """A factor store in archives, read without unpacking: ``load`` gives what the store's own gives. Nothing can be written."""

    def __init__(self, spark: SparkSession, archives: str | Sequence[str]):
        paths = [archives] if isinstance(archives, str) else list(archives)
        super().__init__(spark, paths[0])
        found = [m for p in paths for m in members(p)]
        notes = [m for m in found if m.name.endswith(".json") and "manifest/" in m.name]
        if not notes:
            raise ValueError(f"no manifest of a factor store in {paths}")
        note = max(notes, key=lambda m: m.name)
        self.head = note.name[: note.name.rindex("manifest/")]
        self.note = json.loads(content(note))
        self.folders: dict[str, list[Member]] = {}
        for m in found:
            if m.name.endswith(".parquet"):
                self.folders.setdefault(m.name.removeprefix(self.head).rsplit("/", 1)[0], []).append(m)

    def manifest(self) -> dict:
        return json.loads(json.dumps(self.note))

    def _refuse(self, *args, **options):
        raise ValueError("a store in archives can't be changed")

    write_base = write_family = merge = _refuse

    def _read(self, where: str, at: Mapping[str, str], chunks: Sequence[int] | None = None, columns: Sequence[str] | None = None, start=None, end=None) -> DataFrame:
        wanted = [k for k in at if chunks is None or int(k) in set(chunks)]
        found = [(int(k), self.folders.get(f"{where}/w={at[k]}/chunk={k}", [])) for k in wanted or list(at)[:1]]
        if empty := [k for k, m in found if not m]:
            raise ValueError(f"the archives lack chunks {empty[:5]} of {where}")
        rows = scan_members(self.spark, [m for _, ms in found for m in ms], columns, start, end)
        return rows if wanted else rows.where(F.lit(False))


#: In how many parts a store is moved: beside it there is one of them at a time.
PARTS = 16


def pack(store: Store, folder: str, *, archive_bytes: int = 256 << 20, move: bool = False) -> list[str]:
    """Copies what the newest manifest of a store names into tar archives below ``folder``, each made by one task from its files in turn; returns them.

    An archive's name is new at each attempt and only those of attempts that succeed are returned. With ``move`` the archives take the store's place, so that there is no room
    needed for both: files go as soon as a part's archives are complete, and the manifest with the last; a run that dies on the way leaves each file in the store or in an archive.
    """
    spark, note = store.spark, store.manifest()
    places = [f"base/w={v['at']}/chunk={k}" for k, v in note["base"]["chunks"].items()] + [f"counts/w={v['at']}/chunk={k}" for k, v in note["base"]["chunks"].items()]
    for f, e in note["families"].items():
        places += [f"factors/{f}/w={at}/chunk={k}" for k, at in e["at"].items()] + [f"state/{f}/w={v['at']}/chunk={k}" for k, v in e.get("state", {}).items()]
    files = settled(spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{store.root}/{p}" for p in places]).select("path", "length"))
    total = files.agg(F.sum("length")).first()[0] or 0
    number = max(1, -(-total // archive_bytes))
    parts = min(PARTS, number) if move else 1
    rows = files.withColumn("archive", F.pmod(F.xxhash64("path"), F.lit(number)))
    root, text = store.root, json.dumps(note, sort_keys=True).encode()

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        rows = [r for b in batches for r in b.to_pylist()]  # names of one task's files
        if not rows:
            return
        name = f"{base}/{uuid.uuid4().hex}.tar"
        with fs.open_output_stream(name) as out, tarfile.open(fileobj=out, mode="w|") as tar:
            for r in rows:
                with opened(r["path"]) as file:
                    entry = tarfile.TarInfo(r["path"][r["path"].index(root.removeprefix("file://").rstrip("/")) + len(root.removeprefix("file://").rstrip("/")) + 1 :])
                    entry.size = r["length"]
                    tar.addfile(entry, file)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"])], names=["archive"])

    def remove(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, where = pafs.FileSystem.from_uri(path)
                if fs.get_file_info(where).type != pafs.FileType.NotFound:  # another attempt of this task may have been here
                    fs.delete_file(where)
            yield pa.RecordBatch.from_arrays([batch.column("path")], names=["path"])

    made = []
    for i in range(parts):
        part = rows.where(F.col("archive") % parts == i)
        dealt = part.repartition(max(1, number // parts), "archive").sortWithinPartitions("archive", "path")
        made += [r[0] for r in dealt.mapInArrow(write, "archive string").collect()]
        if move:
            part.select("path").mapInArrow(remove, "path string").write.format("noop").mode("overwrite").save()
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    last = f"{folder}/{uuid.uuid4().hex}.tar"
    with fs.open_output_stream(f"{base}/{last.rsplit('/', 1)[1]}") as out, tarfile.open(fileobj=out, mode="w|") as tar:
        entry = tarfile.TarInfo(f"manifest/{note['number']:08d}.json")
        entry.size = len(text)
        tar.addfile(entry, io.BytesIO(text))
    if move:
        for p in [*places, "manifest"]:  # what is left of folders: checksums
            files, where = store._files(f"{store.root}/{p}")
            files.delete(where, True)
    return [*made, last]
