"""Point clouds and map vertices from binary files, label images to pixel rows.

Large files are read in slices: the header is parsed once per file, then byte ranges are distributed, so
one big map file is spread over many tasks.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorgrid.session import cut, file_system

HEADER_STEP = 65536
SLICE_RECORDS = 1_000_000
SMALL_BYTES = 8192  # records of a file that go along with its layout, so that it is opened once
BATCH_RECORDS = 100_000
IMAGES_A_TASK = 4096
# PLY scalar names and their NumPy codes.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4",
             "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4",
             "float32": "f4", "float64": "f8"}


def _open(path: str):
    """A seekable stream."""
    system, local = file_system(path)
    return system.open_input_file(local)


def _save(path: str, data: bytes, folders: set[str] | None = None) -> None:
    """Write a whole file; a task that runs again writes the same one. Folders that the task has made are not made again."""
    system, local = file_system(path)
    folder = local.rsplit("/", 1)[0]
    if folders is None or folder not in folders:
        system.create_dir(folder, recursive=True)
        (folders if folders is not None else set()).add(folder)
    with system.open_output_stream(local) as f:
        f.write(data)


def write_point_clouds(points: DataFrame, root: str) -> DataFrame:
    """One binary cloud per frame under <root>/<sequence>/lidar; returns (path, points). A task takes its frames one after another."""
    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders: set[str] = set()

        def put(key: tuple, parts: list[np.ndarray]) -> tuple[str, int]:
            n, path = sum(map(len, parts)), f"{root}/{key[0]}/lidar/{key[1]:06d}.pcd"
            head = f"VERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
            _save(path, head.encode() + b"".join(p.tobytes() for p in parts), folders)
            return path, n

        key, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            xyz = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)]).astype("<f4")
            done = []
            for at, end in _runs(b, 2):
                now = (b.column(0)[at].as_py(), b.column(1)[at].as_py())
                if now != key and parts:
                    done.append(put(key, parts))
                    parts = []
                key = now
                parts.append(xyz[at:end])
            yield _written(done, "points")
        if parts:
            yield _written([put(key, parts)], "points")

    frames = points.select("sequence", "frame_idx", *[F.col(c).cast("double").alias(c) for c in "xyz"], "point_idx").repartition("sequence", "frame_idx")
    return frames.sortWithinPartitions("sequence", "frame_idx", F.asc_nulls_last("point_idx")).mapInArrow(save, "path string, points long")


def write_map_points(points: DataFrame, root: str) -> DataFrame:
    """One PLY file per map_id with x, y and z; returns (path, points). A map is one task's work."""
    def save(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, path = len(rows), f"{root}/{key[0]}.ply"
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
        _save(path, head.encode() + rows.sort_values("point_idx")[["x", "y", "z"]].to_numpy("<f4").tobytes())
        return pd.DataFrame({"path": [path], "points": [n]})

    return points.groupBy("map_id").applyInPandas(save, "path string, points long")


def write_label_images(pixels: DataFrame, root: str, width: int, height: int) -> DataFrame:
    """One 8-bit grey PNG per (sequence, camera, frame_idx), label 0 where there is no pixel; returns (path, pixels). A task takes its images
    one after another."""
    def part(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders: set[str] = set()
        key, image, n = None, None, 0

        def put() -> tuple[str, int]:
            path = f"{root}/{key[0]}/{key[1]}/{key[2]:06d}.png"
            _save(path, b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
                  + part(b"IDAT", zlib.compress(image.tobytes())) + part(b"IEND", b""), folders)
            return path, n

        for b in batches:
            if not b.num_rows:
                continue
            if b.column(3).null_count or b.column(4).null_count:
                raise ValueError("a pixel needs u and v")
            u, v, label = (b.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
            done = []
            for at, end in _runs(b, 3):
                now = tuple(b.column(i)[at].as_py() for i in range(3))
                if now != key:
                    if n:
                        done.append(put())
                    key, image, n = now, np.zeros((height, width + 1), np.uint8), 0  # a line begins with its filter, 0
                image[v[at:end], u[at:end] + 1] = label[at:end]
                n += end - at
            yield _written(done, "pixels")
        if n:
            yield _written([put()], "pixels")

    images = ["sequence", "camera", "frame_idx"]
    return pixels.select(*images, "u", "v", "label").repartition(*images).sortWithinPartitions(*images).mapInArrow(save, "path string, pixels long")


def _runs(b: pa.RecordBatch, keys: int) -> list[tuple[int, int]]:
    """Starts and ends of the runs of equal values in the first columns."""
    codes = [b.column(i).dictionary_encode("encode").indices.to_numpy() for i in range(keys)]
    changed = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    starts = np.flatnonzero(np.concatenate([[True], changed])).tolist()
    return list(zip(starts, [*starts[1:], b.num_rows]))


def _written(done: list[tuple[str, int]], what: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", what])


def _header(f, size: int, layout, path: str) -> dict:
    """The layout of a file; more of it is read as long as its header has no end."""
    head = b""
    while True:
        more = f.read(HEADER_STEP)
        head += more
        try:
            return layout(head, size, path)
        except IncompleteHeader:
            if not more:
                raise


class IncompleteHeader(ValueError):
    pass


def pcd_layout(head: bytes, size: int, path: str) -> dict:
    """Record layout of a binary xyz float32 PCD; anything else is an error."""
    fields: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in fields:
        end = head.find(b"\n", at)
        if end < 0:
            raise IncompleteHeader(f"incomplete header: {path}")
        words = head[at:end].decode("ascii").split()
        at = end + 1
        if words and not words[0].startswith("#"):
            fields[words[0].upper()] = words[1:]
    good = (fields["DATA"] == ["binary"] and fields.get("FIELDS") == ["x", "y", "z"] and fields.get("SIZE") == ["4", "4", "4"]
            and fields.get("TYPE") == ["F", "F", "F"] and fields.get("COUNT") == ["1", "1", "1"])
    if not good:
        raise ValueError(f"only binary xyz float32 clouds are supported: {path}")
    n = int((fields.get("POINTS") or fields.get("WIDTH") or ["0"])[0])
    if size - at < n * 12:
        raise ValueError(f"{path} should hold {n * 12} bytes of points, but has {size - at}")
    return {"offset": at, "count": n, "dtype": [["x", "<f4"], ["y", "<f4"], ["z", "<f4"]]}


def ply_layout(head: bytes, size: int, path: str) -> dict:
    """Vertex layout of a binary little-endian PLY."""
    end = head.find(b"end_header\n")
    if end < 0:
        raise IncompleteHeader(f"incomplete header: {path}")
    lines = head[:end].decode("ascii").splitlines()
    if not lines or lines[0].strip() != "ply" or not any(ln.split()[:2] == ["format", "binary_little_endian"] for ln in lines):
        raise ValueError(f"only binary little-endian PLY is supported: {path}")
    count, inside, dtype = 0, False, []
    for words in (ln.split() for ln in lines):
        if words[:1] == ["element"]:
            inside = words[1] == "vertex"
            count = int(words[2]) if inside else count
        elif words[:1] == ["property"] and inside:
            dtype.append([words[2], "<" + PLY_TYPES[words[1]]])
    if not {"x", "y", "z"} <= {n for n, _ in dtype}:
        raise ValueError(f"vertices need x, y and z: {path}")
    return {"offset": end + len(b"end_header\n"), "count": count, "dtype": dtype}


def _files(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """(path, length) of the files under a folder. Tasks list the folders, level by level; only names of folders reach the driver."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for folder in (f for b in batches for f in b.column(0).to_pylist()):
            system, local = file_system(folder)
            inside = [i for i in system.get_file_info(fs.FileSelector(local)) if i.base_name[:1] not in ("_", ".")]  # as Spark hides them
            for at in range(0, len(inside), BATCH_RECORDS):
                part = inside[at:at + BATCH_RECORDS]
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{i.base_name}" for i in part], pa.string()), pa.array([i.size or 0 for i in part], pa.int64()),
                                                  pa.array([i.type == fs.FileType.Directory for i in part], pa.bool_())], names=["path", "length", "folder"])

    level, out = [root.rstrip("/")], None
    while level:
        folders = spark.createDataFrame([(f,) for f in level], "path string").repartition(min(len(level), 1000))
        listed = cut(folders.mapInArrow(entries, "path string, length long, folder boolean"))
        level = [r.path for r in listed.where("folder").select("path").collect()]
        files = listed.where(~F.col("folder") & F.col("path").endswith(suffix and f".{suffix}")).select("path", "length")
        out = files if out is None else out.unionByName(files)
    return out


def _records(spark: SparkSession, path: str, suffix: str, layout, columns: list[str], names: dict[str, Column]) -> DataFrame:
    """`names` are taken from the path, `columns` from the records; small files are read with their header, others in slices."""
    files, kept = _files(spark, path, suffix).repartition("path"), list(names)

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with _open(p) as f:
                    lay = _header(f, size, layout, p)
                    n = lay["count"] * np.dtype([tuple(d) for d in lay["dtype"]]).itemsize
                    raw = None
                    if 0 < n <= SMALL_BYTES and lay["count"] <= SLICE_RECORDS:
                        f.seek(lay["offset"])
                        raw = f.read(n)
                    rows.append((p, json.dumps(lay), raw))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], names=["path", "layout", "raw"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int, np.ndarray]] = []
            held = 0
            for i, (p, text, raw, first) in enumerate(zip(*[b.column(c).to_pylist() for c in ("path", "layout", "raw", "first")])):
                lay = json.loads(text)
                dtype = np.dtype([tuple(d) for d in lay["dtype"]])
                n = min(SLICE_RECORDS, lay["count"] - first)
                if raw is None:
                    with _open(p) as f:
                        f.seek(lay["offset"] + first * dtype.itemsize)
                        raw = f.read(n * dtype.itemsize)
                if len(raw) != n * dtype.itemsize:
                    raise ValueError(f"{p} ends before its last point")
                found.append((i, first, np.frombuffer(raw, dtype=dtype)))
                held += n
                if held >= BATCH_RECORDS:
                    yield points(b, found)
                    found, held = [], 0
            if found:
                yield points(b, found)

    def points(b: pa.RecordBatch, found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        of = pa.array(np.repeat([i for i, _, _ in found], [len(d) for _, _, d in found]))
        out = [b.column(c).take(of) for c in kept]
        out.append(pa.array(np.concatenate([np.arange(first, first + len(d), dtype=np.int64) for _, first, d in found])))
        for c in columns:
            parts = [pa.array(d[c].astype(np.float32), from_pandas=True) if c in d.dtype.names else pa.nulls(len(d), pa.float32()) for _, _, d in found]
            out.append(pa.concat_arrays(parts))
        return pa.RecordBatch.from_arrays(out, names=[*kept, "point_idx", *columns])

    laid = files.mapInArrow(headers, "path string, layout string, raw binary")
    count = F.get_json_object("layout", "$.count").cast("bigint")
    parts = laid.where(count > 0).withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1, F.lit(SLICE_RECORDS).cast("bigint"))))
    parts = parts.select("path", "layout", "raw", "first", *[v.alias(n) for n, v in names.items()]).repartition("path", "first")
    ddl = ", ".join([f"{n} {k}" for n, k in parts.select(*names).dtypes] + ["point_idx bigint", *[f"{c} float" for c in columns]])
    return parts.mapInArrow(slices, ddl)


def read_point_clouds(spark: SparkSession, root: str) -> DataFrame:
    """points(sequence, frame_idx, point_idx, x, y, z) from <root>/<sequence>/lidar/<six digits>.pcd."""
    return _records(spark, root, "pcd", pcd_layout, ["x", "y", "z"], {
        "sequence": F.regexp_extract("path", r"([^/]+)/[^/]+/\d+\.pcd$", 1), "frame_idx": F.regexp_extract("path", r"(\d+)\.pcd$", 1).cast("int")})


def read_map_points(spark: SparkSession, root: str) -> DataFrame:
    """map_points(map_id, point_idx, x, y, z, nx, ny, nz) from PLY files; normals are NULL when absent."""
    return _records(spark, root, "ply", ply_layout, ["x", "y", "z", "nx", "ny", "nz"], {"map_id": F.regexp_extract("path", r"([^/]+)\.ply$", 1)})


def grey_png(data: bytes, path: str) -> np.ndarray:
    """The lines of an 8-bit (of a 16-bit one, the low bytes) grey PNG, whose transparency is left out."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError(f"not a PNG file: {path}")
    at, head, packed = 8, None, []
    while at + 8 <= len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        if name == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif name == b"IDAT":
            packed.append(data[at + 8:at + 8 + n])
        at += 12 + n
    if head is None or head[3] not in (0, 4) or head[2] not in (8, 16):
        raise ValueError(f"label images have one channel: {path}")
    width, height, deep, kind, interlaced = head[0], head[1], head[2], head[3], head[6]
    step = (2 if kind == 4 else 1) * deep // 8
    raw, at = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8), 0
    out = np.zeros((height, width), np.uint8)
    passes = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)] if interlaced else [(0, 0, 1, 1)]
    for r, c, dr, dc in passes:
        h, w = -(-(height - r) // dr), -(-(width - c) // dc)
        if h > 0 and w > 0:
            lines = raw[at:at + h * (1 + w * step)].reshape(h, 1 + w * step)
            at += lines.size
            out[r::dr, c::dc] = _unfiltered(lines[:, 0], lines[:, 1:].reshape(h, w, step))[:, :, deep // 8 - 1]
    return out


def _unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Lines (h, w, bytes of a pixel) without the filters of PNG."""
    if not kinds.any():
        return lines
    h, w, step = lines.shape
    if kinds.max() <= 2:
        out = lines.copy()
        for r in np.flatnonzero(kinds):
            if kinds[r] == 1:
                out[r] = np.add.accumulate(out[r], axis=0, dtype=np.uint8)
            elif r:
                out[r] += out[r - 1]
        return out
    out = np.zeros((h + 1, w + 1, step), np.int32)  # with a line above and a column before
    for d in range(h + w - 1):  # pixels of a diagonal do not need each other
        r = np.arange(max(0, d - w + 1), min(h, d + 1))
        c = d - r
        left, up, corner, kind = out[r + 1, c], out[r, c + 1], out[r, c], kinds[r][:, None]
        a, b, both = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        paeth = np.where((a <= b) & (a <= both), left, np.where(b <= both, up, corner))
        out[r + 1, c + 1] = (lines[r, c] + np.choose(kind, [np.zeros_like(left), left, up, (left + up) // 2, paeth])) & 255
    return out[1:, 1:].astype(np.uint8)


def read_label_images(spark: SparkSession, root: str, pattern: str = r"([^/]+)/([^/]+)/(\d+)\.png$", without: int | None = None) -> DataFrame:
    """pixels(sequence, camera, frame_idx, u, v, label) from 8-bit single-channel images, one row per pixel, or one per pixel of other labels
    than `without`. Tasks list the folders and read the PNG files; Spark's reader takes images of other kinds."""
    names = {"sequence": F.regexp_extract("path", pattern, 1), "camera": F.regexp_extract("path", pattern, 2),
             "frame_idx": F.regexp_extract("path", pattern, 3).cast("int")}
    ddl, kept = "sequence string, camera string, frame_idx int, u int, v int, label int", 3

    def pixels(batches: Iterator[pa.RecordBatch], decoded) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
            held = 0
            for i in range(b.num_rows):
                image = decoded(b, i)
                v, u = np.nonzero(np.ones(image.shape, bool) if without is None else image != without)
                found.append((i, u, v, image[v, u]))
                held += len(u)
                if held >= BATCH_RECORDS or i == b.num_rows - 1:
                    of = pa.array(np.repeat([k for k, *_ in found], [len(x) for _, x, _, _ in found]))
                    columns = [pa.array(np.concatenate([f[k] for f in found]).astype(np.int32)) for k in (1, 2, 3)]
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(of) for c in range(kept)], *columns], names=["sequence", "camera", "frame_idx", "u", "v", "label"])
                    found, held = [], 0

    def png(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decoded(b: pa.RecordBatch, i: int) -> np.ndarray:
            path = b.column(kept)[i].as_py()
            with _open(path) as f:
                return grey_png(f.read(), path)

        yield from pixels(batches, decoded)

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decoded(b: pa.RecordBatch, i: int) -> np.ndarray:
            path, height, width, channels, data = (b.column(c)[i].as_py() for c in range(kept, kept + 5))
            if channels != 1:
                raise ValueError(f"label images have one channel: {path}")
            return np.frombuffer(data, np.uint8).reshape(height, width)

        yield from pixels(batches, decoded)

    files = _files(spark, root)
    ours = F.col("path").endswith(".png")
    tasks = -(-files.count() // IMAGES_A_TASK) or 1  # named, since a list of paths is small and would be put into one task
    out = files.where(ours).repartition(tasks, "path").select(*[v.alias(n) for n, v in names.items()], "path").mapInArrow(png, ddl)
    if files.where(~ours).isEmpty():
        return out
    images = spark.read.format("image").option("recursiveFileLookup", True).load(root).select(F.col("image.origin").alias("path"), "image").where(~ours)
    images = images.select(*[v.alias(n) for n, v in names.items()], "path", *[f"image.{c}" for c in ("height", "width", "nChannels", "data")])
    return out.unionByName(images.mapInArrow(other, ddl))


def read_rgb_images(spark: SparkSession, root: str, size: tuple[int, int] | None = None) -> DataFrame:
    """pixels(path, u, v, r, g, b), optionally sampled to `size` = (height, width) by nearest pixel."""
    images = spark.read.format("image").option("recursiveFileLookup", True).load(root)
    flat = images.select(*[F.col(f"image.{c}").alias(c) for c in ("origin", "height", "width", "nChannels", "data")])

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                data = np.frombuffer(bytes(r.data), dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
                h, w = size or (r.height, r.width)
                data = data[np.arange(h) * r.height // h][:, np.arange(w) * r.width // w]
                v, u = np.divmod(np.arange(h * w), w)
                bgr = data.reshape(h * w, -1).astype("int32")
                yield pd.DataFrame({"path": r.origin, "u": u.astype("int32"), "v": v.astype("int32"), "r": bgr[:, min(2, bgr.shape[1] - 1)],
                                    "g": bgr[:, min(1, bgr.shape[1] - 1)], "b": bgr[:, 0]})

    return flat.mapInPandas(pixels, "path string, u int, v int, r int, g int, b int")
