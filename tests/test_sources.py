import json
import os
import struct
import zlib

import numpy as np
import pytest

from conftest import rows
from spoorgrid.sources import binary, frame_index, manifests, persist, reports, text


def _pcd(path, pts, fields="x y z", cut=0):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    head = (f"# .PCD v0.7\nVERSION 0.7\nFIELDS {fields}\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {len(pts)}\nHEIGHT 1\n"
            f"VIEWPOINT 0 0 0 1 0 0 0\nPOINTS {len(pts)}\nDATA binary\n")
    body = np.asarray(pts, dtype="<f4").tobytes()
    with open(path, "wb") as f:
        f.write(head.encode() + body[: len(body) - cut])


def test_point_clouds(spark, tmp_path, monkeypatch):
    pts = [(-9.5, -9.5, 1.0), (0.0, 0.0, 2.0), (9.4, 9.3, 3.0)]
    _pcd(f"{tmp_path}/seq_a/lidar/000000.pcd", pts)
    _pcd(f"{tmp_path}/seq_a/lidar/000007.pcd", pts[:1])
    got = rows(binary.read_point_clouds(spark, str(tmp_path)), "frame_idx", "point_idx")
    assert [(r[0], r[1], r[2]) for r in got] == [("seq_a", 0, 0), ("seq_a", 0, 1), ("seq_a", 0, 2), ("seq_a", 7, 0)]
    assert np.allclose([r[3:] for r in got], pts + pts[:1])


def test_point_cloud_files_are_written_by_runs_of_frames_and_listed_by_tasks(spark, tmp_path):
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # frames go over the borders of batches
    try:
        pts = [(s, f, 10 - i, float(i), float(f), None if i == 2 else 0.5) for s in ("a", "b") for f in (0, 3, 1234567) for i in range(7)]
        df = spark.createDataFrame(pts, "sequence string, frame_idx int, point_idx int, x double, y double, z double")
        done = binary.write_point_clouds(df, str(tmp_path))
        assert sorted(r.points for r in done.collect()) == [7] * 6
        back = binary.read_point_clouds(spark, str(tmp_path))
        want = sorted((s, f, 10 - p - 4, x, y, z is None) for s, f, p, x, y, z in pts)
        assert sorted((r[0], r[1], 6 - r[2], r[3], r[4], r[5] is None) for r in back.collect()) == sorted((s, f, int(x), x, y, z) for s, f, _, x, y, z in want)
        plans = [d._jdf.queryExecution().toString() for d in (done, back)]
        assert "FlatMapGroupsInPandas" not in plans[0] and "binaryFile" not in plans[1]  # no call a frame, no list of all files at the driver
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


@pytest.mark.parametrize("kwargs,message", [({"cut": 4}, "should hold"), ({"fields": "x y i"}, "float32")])
def test_bad_point_clouds_are_errors(spark, tmp_path, kwargs, message):
    _pcd(f"{tmp_path}/s/lidar/000000.pcd", [(1, 2, 3)], **kwargs)
    with pytest.raises(Exception, match=message):
        binary.read_point_clouds(spark, str(tmp_path)).collect()


def test_map_vertices_with_and_without_normals(spark, tmp_path):
    def write(name, props, values):
        head = "ply\nformat binary_little_endian 1.0\nelement vertex %d\n%send_header\n" % (
            len(values), "".join(f"property {t} {n}\n" for n, t in props))
        with open(f"{tmp_path}/{name}.ply", "wb") as f:
            f.write(head.encode())
            for v in values:
                f.write(struct.pack("<" + "".join({"float": "f", "double": "d", "uchar": "B"}[t] for _, t in props), *v))
    write("a", [(n, "float") for n in ("x", "y", "z", "nx", "ny", "nz")], [(1, 2, 3, 0, 0, 1)])
    write("b", [("x", "double"), ("y", "double"), ("z", "double"), ("red", "uchar")], [(4, 5, 6, 7), (7, 8, 9, 1)])
    got = rows(binary.read_map_points(spark, str(tmp_path)), "map_id", "point_idx")
    assert got == [("a", 0, 1.0, 2.0, 3.0, 0.0, 0.0, 1.0), ("b", 0, 4.0, 5.0, 6.0, None, None, None), ("b", 1, 7.0, 8.0, 9.0, None, None, None)]


def test_sliced_reads_cover_the_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "SLICE_RECORDS", 3)
    pts = np.arange(30, dtype="f4").reshape(10, 3)
    _pcd(f"{tmp_path}/s/lidar/000001.pcd", pts)
    got = rows(binary.read_point_clouds(spark, str(tmp_path)).select("point_idx", "x"), "point_idx")
    assert got == [(i, 3.0 * i) for i in range(10)]


def _png(path, grid):
    import zlib

    os.makedirs(os.path.dirname(path), exist_ok=True)
    h, w = len(grid), len(grid[0])

    def part(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    raw = b"".join(b"\0" + bytes(r) for r in grid)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_label_images(spark, tmp_path):
    _png(f"{tmp_path}/seq/left/000003.png", [[0, 13, 2], [5, 5, 15]])
    got = rows(binary.read_label_images(spark, str(tmp_path)), "v", "u")
    assert got == [("seq", "left", 3, u, v, x) for v, r in enumerate([[0, 13, 2], [5, 5, 15]]) for u, x in enumerate(r)]
    assert binary.read_rgb_images(spark, str(tmp_path), (1, 2)).count() == 2


def test_trajectory_and_imu_text(spark, tmp_path):
    d = tmp_path / "seq_a"
    d.mkdir()
    (d / "traj.txt").write_text("# t x y z q\n0.1 1 0 0 0 0 0.04997917 0.99875026\n0.0 0 0 0 0 0 0 1\n0.2 2 0.5 0 0 0 0.09983342 0.99500417\n")
    got = text.read_trajectory(spark, f"{tmp_path}/*/traj.txt").orderBy("frame_idx").collect()
    assert [(r.sequence, r.frame_idx, r.px) for r in got] == [("seq_a", 0, 0.0), ("seq_a", 1, 1.0), ("seq_a", 2, 2.0)]
    assert abs(np.arctan2(got[2].pose[4], got[2].pose[0]) - 0.2) < 1e-6
    (d / "imu.txt").write_text("0.0 0.1 0 0 0 0 9.8\n0.05 0.1 0 0\n")
    with pytest.raises(Exception, match="expected 7 values"):
        text.read_imu(spark, f"{tmp_path}/*/imu.txt").collect()


def test_calibration(spark, tmp_path):
    cam = "\n".join(f"Camera1.{k}: {v}" for k, v in {"fx": 100, "fy": 110.0, "cx": 3, "cy": 2, "width": 6, "height": 4, "D": "[0.1, 0, 0, 0, 0]"}.items())
    tf = "\n".join(f"T_cam1_os.{k} = {v}" for k, v in {"px": 0.1, "py": 0, "pz": -0.2, "qx": 0, "qy": 0, "qz": 0, "qw": 1}.items())
    (tmp_path / "calib.txt").write_text(f"# rig\n{cam}\n\n{tf}\n")
    e = text.read_calibration_entries(spark, f"{tmp_path}/calib.txt")
    c = text.cameras(e, {"left": "Camera1"}).first()
    assert (c.camera, c.fx, c.width, c.k1) == ("left", 100.0, 6, 0.1)
    assert text.transforms(e, ["T_cam1_os"]).first().pose[11] == -0.2
    with pytest.raises(Exception, match="missing calibration field"):
        text.cameras(e, {"right": "Camera2"}).collect()


def test_frame_listing_and_violations(spark, tmp_path):
    for m, ids in (("lidar", (0, 1, 2)), ("image_left", (0, 1, 3))):
        for i in ids:
            p = tmp_path / "s" / m / f"{i:06d}.bin"
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(b"x")
    files = frame_index.list_frames(spark, str(tmp_path), "lidar", "bin").unionByName(frame_index.list_frames(spark, str(tmp_path), "image_left", "bin"))
    bad = frame_index.modality_violations(files)
    assert {r.modality for r in bad.collect()} == {"image_left", "lidar"}
    with pytest.raises(ValueError, match="inconsistent"):
        frame_index.require_empty(bad, "inconsistent")
    good = frame_index.modality_violations(files.where("modality = 'lidar'"))
    frame_index.require_empty(good, "inconsistent")


def test_split_rules(spark):
    s = spark.createDataFrame([("Seq_A",), ("Seq_B",), ("Seq_C",)], "sequence string")
    got = dict(rows(frame_index.split_sequences(s, "sequence")))
    assert got == {"Seq_A": "train", "Seq_B": "train", "Seq_C": "validation"}
    with pytest.raises(Exception, match="empty"):
        frame_index.split_sequences(s, "sequence", names=["nope"]).collect()


def test_report_round_trip(spark, tmp_path):
    pose = [[1.0, 0, 0, 2.0], [0, 1.0, 0, 3.0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
    doc = {"num": 1, "frame_results": [{"frame_idx": 4, "position_error_m": 0.3, "selected_candidate_index": 1, "candidate_results": [
        {"patch_id": 1, "final_score": 1.0, "final_pose_4x4": pose}, {"patch_id": 2, "final_score": 0.5}]},
        {"frame_idx": 5, "position_error_m": 0.1, "candidate_results": []}]}
    (tmp_path / "run_a.json").write_text(json.dumps(doc, indent=1))
    r = reports.read_reports(spark, f"{tmp_path}/*.json")
    got = r.select("sequence", "frame_idx", reports.selected_candidate("selected_candidate_index")["patch_id"].alias("p")).orderBy("frame_idx")
    assert rows(got) == [("run_a", 4, 2), ("run_a", 5, None)]
    flat = reports.unnest_candidates(r)
    assert flat.count() == 3 and flat.where("cand_idx = 0").select(reports.flat_pose("c.final_pose_4x4").alias("p")).first().p[3] == 2.0


def test_fingerprint_reuses_and_refreshes(spark, tmp_path):
    src = tmp_path / "in.txt"
    src.write_text("a")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    for params in ({"r": 1}, {"r": 1}, {"r": 2}):
        assert persist.build_or_load(spark, f"{tmp_path}/out", [str(src)], params, build).count() == 3
    assert len(calls) == 2
    src.write_text("ab")
    persist.build_or_load(spark, f"{tmp_path}/out", [str(src)], {"r": 1}, build)
    assert len(calls) == 3


def test_detection_export_strictness(spark, tmp_path):
    m = spark.createDataFrame([(1, 0, "train", 3, "person", "moving", "i1", "[1, 2, 5, 9]", '["a", "b"]'), (2, 0, "train", 4, "pending", "", "", "", '["c"]')],
                              "doc_id long, sequence int, split string, anchor_frame int, person_label string, motion_label string, instance_id string, box_json string, paths_json string")
    with pytest.raises(Exception, match="unverified row"):
        manifests.export_detection_dataset(m, "doc_id", f"{tmp_path}/a", strict=True)
    manifests.export_detection_dataset(m, "doc_id", f"{tmp_path}/b", strict=False)
    a = spark.read.json(f"{tmp_path}/b/annotations").first()
    assert (a.bbox, a.area, a.image_id) == ([1.0, 2.0, 4.0, 7.0], 28.0, 1)
    assert spark.read.json(f"{tmp_path}/b/issues").first().issue == "person_label"


def _filtered(image: np.ndarray, interlaced: bool, channels: int = 1, deep: int = 8) -> bytes:
    """A grey PNG whose lines use all five filters in turn."""
    step = channels * deep // 8

    def lines(part: np.ndarray) -> bytes:
        h, w = part.shape
        px = np.zeros((h + 1, w + 1, step), int)
        px[1:, 1:, deep // 8 - 1] = part
        out = b""
        for r in range(1, h + 1):
            left, up, corner = px[r, :-1], px[r - 1, 1:], px[r - 1, :-1]
            near = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
            paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
            kind = (r + 3) % 5
            out += bytes([kind]) + ((px[r, 1:] - [0 * left, left, up, (left + up) // 2, paeth][kind]) & 255).astype(np.uint8).tobytes()
        return out

    passes = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)] if interlaced else [(0, 0, 1, 1)]
    raw = b"".join(lines(image[r::dr, c::dc]) for r, c, dr, dc in passes if image[r::dr, c::dc].size)
    part = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], deep, 0 if channels == 1 else 4, 0, 0, int(interlaced))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)[:9]) + part(b"IDAT", zlib.compress(raw)[9:]) + part(b"IEND", b"")


def test_label_images_of_all_kinds_without_listing_by_the_driver(spark, tmp_path):
    rng = np.random.default_rng(4)
    kinds = [(False, 1, 8), (True, 1, 8), (False, 2, 8), (False, 1, 16), (True, 2, 16)]
    images = {i: rng.integers(0, 256, (7 + i, 11)) for i in range(len(kinds))}
    for i, kind in enumerate(kinds):
        (tmp_path / "s" / "left").mkdir(parents=True, exist_ok=True)
        (tmp_path / "s" / "left" / f"{i:06d}.png").write_bytes(_filtered(images[i], *kind))
    read = binary.read_label_images(spark, str(tmp_path))
    assert "image" not in read._jdf.queryExecution().toString()  # Spark's reader would list all files in the driver
    got = {(r.frame_idx, r.v, r.u): r.label for r in read.collect()}
    assert got == {(i, v, u): int(x) for i, im in images.items() for v, line in enumerate(im) for u, x in enumerate(line)}
    some = binary.read_label_images(spark, str(tmp_path), without=5)
    assert some.count() == sum(int((im != 5).sum()) for im in images.values())
    pixels = [(s, c, f, u, v, (s + f + u * v) % 15 + 1) for s in (1, 2) for c in ("left", "right") for f in (0, 7) for u in range(0, 9, 2) for v in range(0, 6, 5)]
    out = binary.write_label_images(spark.createDataFrame(pixels, "sequence int, camera string, frame_idx int, u int, v int, label int"), f"{tmp_path}/new", 9, 6)
    assert sorted(r.pixels for r in out.collect()) == [10] * 8
    back = binary.read_label_images(spark, f"{tmp_path}/new").where("label > 0").collect()
    assert sorted((int(r.sequence), r.camera, r.frame_idx, r.u, r.v, r.label) for r in back) == sorted(pixels)
