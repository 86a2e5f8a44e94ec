import base64
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismarium.operators import detect
from prismarium.settings import Session, Settings
from prismarium.sources import content, copying, pictures, scan


def raf(jpeg=b"\xff\xd8\xff\xe0\1\2\3\4", place=100, length=None):
    head = bytearray(100)
    head[:16] = content.RAW_MAGIC
    struct.pack_into(">I", head, 84, place)
    struct.pack_into(">I", head, 88, len(jpeg) if length is None else length)
    return bytes(head) + jpeg


def exif_jpeg(date=b"2024:03:15 14:30:45\0", orientation=6):
    entries = [(0x010F, 2, b"Canon\0"), (0x0110, 2, b"  \0"), (0x0112, 3, struct.pack("<H", orientation)), (0x829D, 5, struct.pack("<II", 28, 10)), (0x920A, 5, struct.pack("<II", 5, 0)), (0x9003, 2, date), (0xA002, 4, struct.pack("<I", 640))]
    at = 8 + 2 + 12 * len(entries) + 4
    table, data = struct.pack("<H", len(entries)), b""
    for tag, kind, value in entries:
        count = {2: len(value), 3: 1, 4: 1, 5: 1}[kind]
        if len(value) <= 4:
            table += struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0")
        else:
            table += struct.pack("<HHII", tag, kind, count, at + len(data))
            data += value
    tiff = b"II*\0" + struct.pack("<I", 8) + table + b"\0\0\0\0" + data
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def test_previews(spark):
    good = raf()
    assert content.extract_preview(good) == b"\xff\xd8\xff\xe0\1\2\3\4"
    bad = [b"", b"no raw file" * 20, good[:50], raf(place=0), raf(length=0), raf(length=99), raf(jpeg=b"abcdefgh")]
    for data in bad:
        with pytest.raises(ValueError):
            content.extract_preview(data)
    got = spark.createDataFrame([(x,) for x in [good, *bad]] + [(None,)], "c binary").select(content.preview_column("c")).collect()
    assert bytes(got[0][0]) == b"\xff\xd8\xff\xe0\1\2\3\4" and all(r[0] is None for r in got[1:])


def test_scan_and_metadata(spark, rows, tmp_path):
    for name in ("a.jpg", "b.PNG", "notes.txt", "_DSC1.JPG", ".h.jpg", "sub/c.jpeg", ".hid/x.jpg", "sub/deep/y.raf"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(exif_jpeg() if name != "sub/deep/y.raf" else raf(exif_jpeg()))
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8\xff")
    (tmp_path / "link.jpg").symlink_to(tmp_path / "a.jpg")
    for spread in (1, 64):
        found = sorted(r.path[len(str(tmp_path)) + 1 :] for r in scan.scan(spark, str(tmp_path), spread).collect())
        assert found == [".hid/x.jpg", "_DSC1.JPG", "a.jpg", "b.PNG", "broken.jpg", "sub/c.jpeg", "sub/deep/y.raf"]
    with pytest.raises(NotADirectoryError):
        scan.scan(spark, str(tmp_path / "a.jpg"))
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.jpg", "sub/deep/y.raf", "broken.jpg", "none.jpg")], "path string")
    got = rows(content.extract_metadata(files), "filename", "make", "model", "aperture", "focal_length", "width", "orientation", "taken_at")
    assert got == [("a.jpg", "Canon", None, 2.8, None, 640, 6, 1710513045), ("broken.jpg", None, None, None, None, None, None, None), ("none.jpg", None, None, None, None, None, None, None), ("y.raf", "Canon", None, 2.8, None, 640, 6, 1710513045)]
    hashed = content.hash_files(files.withColumn("size", F.lit(0).cast("long")))
    assert hashed.where("hash is null").count() == 1


def test_copying(spark, rows, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in" / "p.jpg").write_bytes(exif_jpeg())
    (tmp_path / "in" / "q.jpg").write_bytes(b"plain")
    src = spark.createDataFrame([(k, str(tmp_path / "in" / n)) for k, n in enumerate(("p.jpg", "q.jpg", "none.jpg"))], "seq long, path string")
    plan = copying.plan_copies(src, str(tmp_path / "out"), "%Y/%m").cache()
    done = copying.copy_files(plan, verify=True).cache()
    assert rows(copying.summarize(done)) == [(2, 1)]
    assert (tmp_path / "out/2024/03/p.jpg").exists() and (tmp_path / "out/q.jpg").read_bytes() == b"plain"
    again = {r.target for r in copying.plan_copies(src, str(tmp_path / "out"), "").collect()}
    assert str(tmp_path / "out/q_1.jpg") in again
    with pytest.raises(NotADirectoryError):
        copying.plan_copies(src, str(tmp_path / "nowhere"), "")


def test_copies_may_keep_their_folders(spark, rows, tmp_path):
    for n in ("in/p.jpg", "in/sub/q.jpg", "other/r.jpg", "out/sub/q.jpg"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    src = spark.createDataFrame([(k, str(tmp_path / n)) for k, n in enumerate(("in/p.jpg", "in/sub/q.jpg", "other/r.jpg"))], "seq long, path string")
    plan = copying.plan_copies(src, str(tmp_path / "out"), "", keep_below=str(tmp_path / "in"))
    assert sorted(r.target[len(str(tmp_path)) + 1 :] for r in plan.collect()) == ["out/p.jpg", "out/r.jpg", "out/sub/q_1.jpg"]
    seen = []
    done = copying.watched(copying.copy_files(plan), 3, lambda *x: seen.append(x[:2]))
    assert seen == [(1, 3), (2, 3), (3, 3)] and all(e is None for _, _, e in done) and (tmp_path / "out/sub/q_1.jpg").exists()


def test_describing_over_http(spark, rows, tmp_path):
    (tmp_path / "a.png").write_bytes(b"picture")
    asked = []

    def send(url, body, timeout):
        asked.append((url, json.loads(body), timeout))
        return json.dumps({"choices": [{"message": {"content": "  a dog \n"}}]}).encode()

    say = detect.chat_describer("http://here:1/", "m", "What?", send=send)()
    assert say(str(tmp_path / "a.png")) == "a dog"
    url, body, timeout = asked[0]
    assert url == "http://here:1/v1/chat/completions" and timeout == 120 and body["max_tokens"] == 512 and body["model"] == "m"
    text, image = body["messages"][0]["content"]
    assert text == {"type": "text", "text": "What?"} and image["image_url"]["url"] == "data:image/png;base64," + base64.b64encode(b"picture").decode()
    with pytest.raises(ValueError):
        detect.chat_describer("x", "m", "p", send=lambda *_: b'{"choices": [{"message": {"content": null}}]}')()(str(tmp_path / "a.png"))


def test_a_detector_is_built_of_its_parts(tmp_path):
    (tmp_path / "a.png").write_bytes(pictures.encode_png(np.zeros((64, 64, 3), np.uint8)))

    def open_model(path, device):
        assert str(device) == "cpu"
        if path == "embed":
            return lambda x: [np.ones((1, 4), np.float32)]
        sizes = [(640 // s) ** 2 * 2 for s in (8, 16, 32)]
        scores = [np.zeros(n, np.float32) for n in sizes]
        scores[2][400] = 0.9
        return lambda x: [*scores, *(np.full((n, 4), 2.0, np.float32) for n in sizes), *(np.zeros((n, 10), np.float32) for n in sizes)]

    found = detect.build_detector("find", "embed", open_model=open_model)()(str(tmp_path / "a.png"))
    assert len(found) == 1 and abs(found[0][2] - 0.9) < 1e-6 and np.allclose(found[0][1], 0.5)
    aligned = detect.build_aligned_detector("find", open_model=lambda *_: lambda x: [np.array([[0, 0, 32, 32]]), np.array([0.7]), np.zeros((1, 112, 112, 3))])()(str(tmp_path / "a.png"))
    assert aligned[0][0] == [0, 0, 0.5, 0.5] and len(aligned[0][1]) == 0


def test_pictures(spark):
    draw = np.random.default_rng(1)
    for shape in ((480, 640, 3), (5, 7, 1), (3, 2, 4)):
        pixels = draw.integers(0, 256, shape, np.uint8)
        assert (pictures.decode_png(pictures.encode_png(pixels)) == pixels).all()
    thumb = pictures.decode_png(pictures.thumbnail(pictures.encode_png(draw.integers(0, 256, (400, 800, 3), np.uint8)), 100))
    assert thumb.shape == (50, 100, 3)
    a = np.arange(6).reshape(2, 3, 1)
    assert pictures.apply_orientation(a, 6)[:, :, 0].tolist() == [[3, 0], [4, 1], [5, 2]]
    assert pictures.apply_orientation(a, 5)[:, :, 0].tolist() == [[0, 3], [1, 4], [2, 5]]
    assert pictures.apply_orientation(a, 9) is a and pictures.read_orientation(exif_jpeg(orientation=3)) == 3 and pictures.read_orientation(b"x") == 1
    got = pictures.thumbnails(spark.createDataFrame([("x", b"bad"), ("y", pictures.encode_png(np.zeros((4, 4, 3), np.uint8)))], "path string, content binary"), 2).orderBy("path").collect()
    assert got[0].error and got[1].png[:8] == pictures.PNG


def test_settings(tmp_path):
    at = tmp_path / "c" / "settings.toml"
    made = Settings.load_from(at)
    assert at.exists() and made.preview_buffer_size == 21 and made.face.tagging_top_k == 5 and made.face.similarity_threshold == 0.4 and made.library_dir
    made.face.device = "cuda:1"
    made.save_to(at)
    assert Settings.load_from(at) == made and not made.face.models_available() and made.face.embedder_path() is None
    at.write_text("[face]\ntagging_top_k = 'x'")
    assert Settings.load_from(at) == Settings()
    at.write_text("= broken")
    assert Settings.load_from(at) == Settings()
    s = Session(str(tmp_path), "/nowhere")
    s.save_to(tmp_path / "s.json")
    back = Session.load_from(tmp_path / "s.json")
    assert back == s and back.config.similarity_threshold == 0.92
    back.validate_paths()
    assert back.source == str(tmp_path) and back.destination is None
    assert Session.load_from(tmp_path / "none.json") == Session()


def slow_suppress(boxes, most):
    kept = []
    for i, a in enumerate(boxes):
        for j in kept:
            b = boxes[j]
            w, h = max(min(a[2], b[2]) - max(a[0], b[0]) + 1, 0), max(min(a[3], b[3]) - max(a[1], b[1]) + 1, 0)
            area = lambda q: (q[2] - q[0] + 1) * (q[3] - q[1] + 1)
            if w * h / (area(a) + area(b) - w * h) > most:
                break
        else:
            kept.append(i)
    return kept


def test_suppression(spark, rows):
    draw = np.random.default_rng(0)
    for _ in range(30):
        low = draw.integers(0, 40, (12, 2))
        boxes = np.concatenate([low, low + draw.integers(1, 30, (12, 2))], 1).astype(float)
        assert detect.suppress(boxes).tolist() == slow_suppress(boxes, 0.5)
    assert detect.suppress(np.zeros((0, 4))).tolist() == []
    half = np.array([[0, 0, 9, 9], [0, 0, 9, 4]], float)  # overlap exactly 0.5 stays
    assert detect.suppress(half).tolist() == [0, 1]
    f = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 9.0, 9.0), (1, 2, 0.9, 0.0, 0.0, 9.0, 8.0), (1, 3, 0.8, 50.0, 0.0, 59.0, 9.0), (2, 4, 0.1, 0.0, 0.0, 9.0, 9.0), (2, 5, None, 0.0, 0.0, 9.0, 9.0)], "image_id long, id long, confidence double, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double")
    assert rows(detect.suppress_faces(f), "id") == [(1,), (3,), (4,)]


def test_detector(spark):
    assert detect.anchor_centers(2, 1, 8, 2).tolist() == [[0, 0], [0, 0], [8, 0], [8, 0]]
    assert detect.boxes_from(np.array([[10.0, 10.0]]), np.array([[1.0, 2.0, 3.0, 4.0]])).tolist() == [[9, 8, 13, 14]]
    assert detect.points_from(np.array([[1.0, 2.0]]), np.zeros((1, 10))).tolist() == [[1, 2] * 5]
    assert detect.order_by_score(np.array([1.0, 3.0, 3.0])).tolist() == [1, 2, 0]
    rgb = np.zeros((320, 640, 3), np.uint8)
    rgb[:, :, 0] = 255
    scale, blob = detect.letterbox(rgb)
    assert scale == 1.0 and blob.shape == (1, 3, 640, 640) and blob[0, 2, 0, 0] == 127.5 / 128 and blob[0, 2, 639, 0] == -127.5 / 128 and blob[0, 0, 0, 0] == -127.5 / 128

    def model(_tensor):
        out = [[], [], []]
        for stride in detect.STRIDES:
            n = (640 // stride) ** 2 * 2
            s, b = np.zeros((1, n, 1), np.float32), np.zeros((n, 4), np.float32)
            if stride == 8:
                s[0, 500], b[500] = 0.9, [1, 1, 2, 2]
                s[0, 501], b[501] = 0.8, [1, 1, 2, 2]
            out[0].append(s)
            out[1].append(b)
            out[2].append(np.zeros((n, 10), np.float32))
        return [x for part in out for x in part]

    found = detect.detect(rgb, model, embed=lambda crop: np.array([3.0, 4.0]) + 0 * crop.mean())
    assert len(found) == 1 and abs(found[0][2] - 0.9) < 1e-6 and np.allclose(found[0][1], [0.6, 0.8])
    with pytest.raises(ValueError):
        detect.detect(rgb, lambda _: [])
    assert detect.detect(rgb, lambda t: [np.zeros_like(x) for x in model(t)]) == []
    assert detect.downscale_large(np.zeros((10, 3840, 3), np.uint8))[1].shape == (5, 1920, 3)


def test_pipeline_and_device():
    p = detect.Pipeline().add("swap_channels").add("linear_scale", scale=2.0, offset=1.0).add("normalize", mean=[1, 1, 1], std=[2, 2, 2]).add("hwc_to_chw").add("add_batch_dim")
    out = p.run(np.arange(6, dtype=np.float32).reshape(1, 2, 3))
    assert out.shape == (1, 3, 1, 2) and out[0, 0, 0].tolist() == [2.0, 5.0]
    assert detect.Pipeline.from_list(p.to_list()) == p
    with pytest.raises(ValueError):
        detect.Pipeline().add("hwc_to_chw").run(np.zeros((2, 2)))
    assert str(detect.Device.parse(" CUDA:1 ")) == "cuda:1" and detect.Device.parse("cpu").providers() == ["CPUExecutionProvider"]
    for bad in ("gpu", "cuda:x", "cuda:", "cpu:1"):
        with pytest.raises(ValueError):
            detect.Device.parse(bad)


def test_describing(spark, rows):
    images = spark.createDataFrame([(1, "a"), (2, "bad")], "id long, path string")

    def load():
        def say(path):
            if path == "bad":
                raise OSError("no")
            return "  a picture "

        return say

    assert rows(detect.describe_images(images, "m", load, 9)) == [(1, "m", "a picture", 9)]
    answer = '{"choices": [{"message": {"content": " hi "}}]}'
    assert spark.createDataFrame([(answer,), ("{}",), (None,)], "r string").select(detect.message_text("r")).collect()[0][0] == "hi"
