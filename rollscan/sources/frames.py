"""A folder of stills as a Spark data source: spark.read.format("roll_frames") and spark.readStream.format("roll_frames").

    spark.dataSource.register(RollFrames)
    spark.read.format("roll_frames").option("glob", "*.png").option("stride", 3).load(folder)

Options: path, glob (*.png), stride (1), fps (30), framesPerPartition (64); for streams also loop (false), maxFramesPerTrigger and
progress, a folder where the reader notes how far it has planned. Frames carry the file's bytes; decoding is the caller's.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, source_id string, frame_index long, ts_s double, stride int, content binary"
#: How image files begin (PNG, JPEG, BMP, TIFF).
BEGINNINGS = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"BM", b"II*\x00", b"MM\x00*")


def natural(path: str) -> list:
    """Sorts names with runs of digits as numbers and the rest lower-cased."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
    return [[(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", stem) if p], path]


class Span(InputPartition):
    """Frames to read: (path, frame_index, ts_s) each."""

    def __init__(self, frames: list[tuple[str, int, float]]) -> None:
        self.frames = frames


class Folder:
    """What both readers share: the listing, in natural order, and the frames that a stride leaves of it."""

    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("roll_frames needs a path")
        self.uri, self.glob = options["path"], options.get("glob", "*.png")
        self.stride, self.fps = int(options.get("stride", 1)), float(options.get("fps", 30))
        self.each = int(options.get("framesperpartition", 64))
        if self.stride < 1 or self.fps <= 0 or self.each < 1:
            raise ValueError("stride, fps and framesPerPartition are positive")

    def _store(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else f"file://{self.uri}")

    def listed(self) -> list[tuple[str, float]]:
        """(path, ts_s) of the frames that are emitted, in order: only these files are ever read."""
        store, root = self._store()
        info = store.get_file_info(pa.fs.FileSelector(root, recursive=False, allow_not_found=True))
        names = sorted((i.path for i in info if i.type == pa.fs.FileType.File and fnmatch.fnmatch(i.base_name, self.glob)), key=natural)
        if not names:
            raise FileNotFoundError(f"no file in {self.uri} matches {self.glob}")
        return [(p, k / self.fps) for k, p in enumerate(names) if k % self.stride == 0]

    def spans(self, frames: list[tuple[str, int, float]]) -> Sequence[Span]:
        return [Span(frames[k : k + self.each]) for k in range(0, len(frames), self.each)]

    def batches(self, span: Span) -> Iterator[pa.RecordBatch]:
        """One frame a batch, so that a task holds one file's bytes. A file that is no image is fatal."""
        store, _ = self._store()
        for path, index, ts in span.frames:
            with store.open_input_stream(path) as f:
                content = f.read()
            if not content.startswith(BEGINNINGS):
                raise OSError(f"cannot read {path} as an image")
            columns = [[path], [self.uri], [index], [ts], [self.stride], [content]]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = Folder(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.folder.spans([(p, i, ts) for i, (p, ts) in enumerate(self.folder.listed())])

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.folder.batches(partition)


class FrameStreamReader(DataSourceStreamReader):
    """Offsets count emitted frames. A batch takes maxFramesPerTrigger of them at most; what it was planned to take is noted in
    `progress` first, so that a query that starts again goes on from there. With loop the folder begins again without end, its
    times too, and frame numbers go on. New files count once they are listed, so they must arrive in natural order."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder = Folder(options)
        self.loop = options.get("loop", "false").lower() == "true"
        self.most = int(options["maxframespertrigger"]) if "maxframespertrigger" in options else None
        self.progress = options.get("progress")
        if (self.loop or self.most) and not (self.most and self.progress):
            raise ValueError("loop and maxFramesPerTrigger need maxFramesPerTrigger and progress")
        self.planned = self._noted()

    def _noted(self) -> int:
        if not self.progress:
            return 0
        store, root = pa.fs.FileSystem.from_uri(self.progress if "://" in self.progress or self.progress.startswith("file:") else f"file://{self.progress}")
        store.create_dir(root)
        found = [int(i.base_name) for i in store.get_file_info(pa.fs.FileSelector(root)) if i.base_name.isdigit()]
        return max(found, default=0)

    def _note(self, end: int) -> None:
        if self.progress:
            store, root = pa.fs.FileSystem.from_uri(self.progress if "://" in self.progress or self.progress.startswith("file:") else f"file://{self.progress}")
            with store.open_output_stream(f"{root}/{end}") as f:
                f.write(b"")
            for i in store.get_file_info(pa.fs.FileSelector(root)):
                if i.base_name.isdigit() and int(i.base_name) < end:
                    store.delete_file(i.path)

    def initialOffset(self) -> dict:
        return {"frames": 0}

    def latestOffset(self) -> dict:
        there = None if self.loop else len(self.folder.listed())
        upto = there if self.most is None else self.planned + self.most if there is None else min(there, self.planned + self.most)
        self.planned = max(self.planned, upto)
        return {"frames": self.planned}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self._note(end["frames"])
        self.planned = max(self.planned, end["frames"])
        files = self.folder.listed()
        numbers = range(start["frames"], end["frames"])
        return self.folder.spans([(*files[n % len(files)][:1], n, files[n % len(files)][1]) for n in numbers])

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.folder.batches(partition)


class RollFrames(DataSource):
    """S1, S3, ST1: a folder of stills, in batch and as a stream of bounded batches."""

    @classmethod
    def name(cls) -> str:
        return "roll_frames"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FrameStreamReader(self.options)
