"""Files as a Spark data source: audio headers and samples read where they are, and files written under a commit protocol."""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from corvane.sources import flac

EXTENSIONS = (".wav", ".flac")
HEADERS = "path string, size long, rate long, channels long, seconds double, bytes_read long, error string"
SIGNALS = "path string, signal array<double>, error string"


def file_system(folder: str):
    """A file system and the folder's path in it: a local one for a plain path or file:, else what pyarrow finds for the address."""
    from pyarrow import fs

    if "://" in folder and not folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/") if folder.startswith(("file:", "/")) else folder


def shown_path(system, path: str) -> str:
    return f"file:{path}" if system.type_name == "local" else path


# ---------------------------------------------------------------- reading


class Counted:
    """A file of which parts are read, and how many bytes have been."""

    def __init__(self, file):
        self.file, self.bytes_read = file, 0

    def part(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        self.bytes_read += len(data)
        return data


@dataclass
class WavFormat:
    """What a WAV file says of its samples, and where they lie."""

    kind: int
    channels: int
    rate: int
    wide: int
    bits: int
    at: int
    size: int


def wav_header(file: Counted, size: int) -> WavFormat:
    """From the heads of the chunks alone, be the samples before or after what describes them."""
    head = file.part(0, 12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("no WAVE file")
    at, told, samples = 12, None, None
    while at + 8 <= size and (told is None or samples is None):
        chunk = file.part(at, 8)
        kind, long = chunk[:4], int.from_bytes(chunk[4:], "little")
        if kind == b"fmt ":
            told = file.part(at + 8, 26 if long >= 26 else 16)
        elif kind == b"data":
            samples = at + 8, min(long, size - at - 8)  # a recorder that was cut off leaves a length that isn't there
        at += 8 + long + (long & 1)
    if told is None or samples is None:
        raise ValueError("no format or no samples")
    field = lambda i, n: int.from_bytes(told[i : i + n], "little")
    out = WavFormat(field(24, 2) if field(0, 2) == 0xFFFE else field(0, 2), field(2, 2), field(4, 4), field(12, 2), field(14, 2), *samples)
    if not out.channels or not out.rate or not out.wide:
        raise ValueError("an empty format")
    return out


def wav_samples(content: bytes) -> tuple[np.ndarray, int]:
    """Samples from -1 to 1, a row for each frame, and the rate. Whole numbers of one to four bytes, and floats."""
    told = wav_header(Counted(io.BytesIO(content)), len(content))
    raw = content[told.at : told.at + told.size // told.wide * told.wide]
    width = told.wide // told.channels
    if told.kind == 3:
        samples = np.frombuffer(raw, {4: "<f4", 8: "<f8"}[width]).astype(np.float64)
    elif told.kind != 1:
        raise ValueError(f"no PCM: format {told.kind}")
    elif width == 1:
        samples = (np.frombuffer(raw, np.uint8) - 128.0) / 128
    else:  # the bytes of a sample at the top of four
        padded = np.zeros((len(raw) // width, 4), np.uint8)
        padded[:, 4 - width :] = np.frombuffer(raw, np.uint8).reshape(-1, width)
        samples = padded.view("<i4").ravel() / float(1 << 31)
    return samples.reshape(-1, told.channels), told.rate


def audio_header(file: Counted, size: int) -> tuple[int, int, float]:
    """Rate, channels and seconds of a WAV or FLAC file."""
    if file.part(0, 4) == b"fLaC":
        info = flac.stream_info(file.part(0, flac.HEADER_BYTES))
        if not info.rate:
            raise ValueError("an empty format")
        return info.rate, info.channels, info.samples / info.rate
    told = wav_header(file, size)
    return told.rate, told.channels, told.size // told.wide / told.rate


def decode_audio(content: bytes, rate: int = 16000) -> np.ndarray:
    """Mono samples from -1 to 1 of a WAV or FLAC file, at the given rate, resampled linearly."""
    if content[:4] == b"fLaC":
        whole, info = flac.decode(content)
        own, samples = info.rate, whole.mean(axis=0) / float(1 << (info.bits - 1))
    else:
        frames, own = wav_samples(content)
        samples = frames.mean(axis=1)
    if own == rate or not len(samples):
        return samples
    n = int(len(samples) * rate / own)
    return np.interp(np.linspace(0, len(samples) - 1, n), np.arange(len(samples)), samples)


@dataclass
class Files(InputPartition):
    """Files that a task reads one after another: path and size."""

    files: list[tuple[str, int]]


class AudioReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.headers = options.get("what", "signals") == "headers"

    def listed(self) -> list[tuple[str, int]]:
        """Files of the folder or of the screened index, in the order of their paths; what an index names and isn't there is left out."""
        from pyarrow import fs

        system, path = file_system(self.options["path"])
        if path.lower().endswith(".json"):
            with system.open_input_file(path) as f:
                entries = json.loads(f.read()).get(self.options.get("kind", "noise"), [])
            infos = system.get_file_info([file_system(e["path"])[1] for e in entries])
        else:
            infos = system.get_file_info(fs.FileSelector(path, recursive=True))
        found = {i.path: i.size for i in infos if i.is_file and i.path.lower().endswith(EXTENSIONS)}
        return sorted(found.items())

    def partitions(self) -> list[InputPartition]:
        """Files in tasks of as many bytes, or as many files, as options say; a header counts as little, whatever the file's size."""
        most_bytes, most_files = int(self.options.get("bytes", 32 << 20)), int(self.options.get("files", 1000))
        parts: list[Files] = []
        total = 0
        for path, size in self.listed():
            cost = min(size, 4096) if self.headers else size
            if not parts or total + cost > most_bytes or len(parts[-1].files) >= most_files:
                parts.append(Files([]))
                total = 0
            parts[-1].files.append((path, size))
            total += cost
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = file_system(self.options["path"])
        rate = int(self.options.get("rate", 16000))
        for path, size in partition.files:
            shown, counted = shown_path(system, path), None
            try:
                with system.open_input_file(path) as f:
                    if self.headers:
                        counted = Counted(f)
                        yield (shown, size, *audio_header(counted, size), counted.bytes_read, None)
                    else:
                        yield shown, decode_audio(f.read(), rate).tolist(), None
            except Exception as e:  # whatever is wrong with a file is its row's result
                error = f"{type(e).__name__}: {e}"
                yield (shown, size, None, None, None, counted.bytes_read if counted else 0, error) if self.headers else (shown, None, error)


class AudioSource(DataSource):
    """WAV and FLAC files below a folder, or those that a screened index (JSON: kind to entries with path) names.

    Options: path, kind (of an index's entries), what ("headers" or "signals"), rate, and bytes and files of a task. A
    header takes ranged reads of a few bytes at the heads of chunks; a file that can't be read is a row with an error.
    """

    @classmethod
    def name(cls) -> str:
        return "corvane_audio"

    def schema(self) -> str:
        return HEADERS if self.options.get("what", "signals") == "headers" else SIGNALS

    def reader(self, schema: StructType) -> DataSourceReader:
        return AudioReader(dict(self.options))


# ---------------------------------------------------------------- writing


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: where it lies, and where it belongs."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Each attempt of a task writes to a folder of its own; the job's commit moves what the attempts that count have
    written to its place, and nothing is there before. An aborted job leaves no file behind."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, base = file_system(self.folder)
        context = TaskContext.get()
        own = posixpath.join(base, self.staging, f"{context.partitionId()}-{context.taskAttemptId()}")
        system.create_dir(own, recursive=True)
        files: list[tuple[str, str]] = []
        for row in rows:
            path = posixpath.normpath(row.path)
            if path.startswith(("/", "..")) or path == ".":
                raise ValueError(f"a path has to lie below the folder: {row.path}")
            lies = posixpath.join(own, str(len(files)))
            with system.open_output_stream(lies) as f:
                f.write(bytes(row.content or b""))
            files.append((lies, posixpath.join(base, path)))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = file_system(self.folder)
        files = [f for m in messages if m for f in m.files]
        places = [place for _, place in files]
        twice = {p for p in places if places.count(p) > 1} if len(set(places)) < len(places) else set()
        there = [] if self.overwrite or not places else [i.path for i in system.get_file_info(places) if i.type != fs.FileType.NotFound]
        if twice or there:
            system.delete_dir(posixpath.join(base, self.staging))
            raise ValueError(f"written twice: {sorted(twice)}" if twice else f"already there: {sorted(there)}")
        for folder in {posixpath.dirname(p) for p in places}:
            system.create_dir(folder, recursive=True)
        for lies, place in files:
            system.move(lies, place)
        system.delete_dir(posixpath.join(base, self.staging))

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = file_system(self.folder)
        staging = posixpath.join(base, self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class FileSink(DataSource):
    """Rows (path below the folder, content) as files. Option: folder. Mode append refuses to replace a file; overwrite replaces it."""

    @classmethod
    def name(cls) -> str:
        return "corvane_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["folder"], overwrite)


def read_files(spark: SparkSession, folder: str, what: str, **options) -> DataFrame:
    spark.dataSource.register(AudioSource)
    return spark.read.format("corvane_audio").options(path=folder, what=what, **options).load()


def write_files(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """rows (path, content) as files below folder, all of them or none."""
    rows.sparkSession.dataSource.register(FileSink)
    rows.select(F.col("path").cast("string"), F.col("content").cast("binary")).write.format("corvane_files").mode(mode).option("folder", folder).save()
