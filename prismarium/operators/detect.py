"""Around a face detector: preparing pixels, decoding its outputs, non-maximum suppression, and running it over a table.

The model itself is given by the caller as a function; none comes with this package.
"""

from __future__ import annotations

import base64
import json
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismarium.functions import col
from prismarium.functions.paths import mime_of
from prismarium.operators.grouped import by_group
from prismarium.sources.content import loadable
from prismarium.sources.pictures import read_pixels, resize_mean, resize_nearest

#: Fixed values of the detector: canvas, pixel scaling, strides, anchors of a cell, landmarks, thresholds, size of a face crop.
CANVAS, MEAN, SPREAD, STRIDES, ANCHORS, LANDMARKS = 640, 127.5, 128.0, (8, 16, 32), 2, 5
LEAST_SCORE, MOST_OVERLAP, CROP, LARGEST_SIDE = 0.4, 0.5, 112, 1920
#: Fixed values of the describing server: where it is asked, tokens of an answer at most, seconds to wait.
CHAT_PATH, MOST_ANSWER, ANSWER_SECONDS = "/v1/chat/completions", 512, 120.0
SCHEMA = "image_id long, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, embedding array<float>, confidence double"


def letterbox(rgb: np.ndarray, canvas: int = CANVAS) -> tuple[float, np.ndarray]:
    """(scale, tensor): the picture in the canvas' upper left corner as (1, 3, h, w), blue first; scale leads from canvas to picture pixels."""
    h, w = rgb.shape[:2]
    tall = h > w
    ratio = np.float32(h) / np.float32(w)
    nh = canvas if tall else max(1, int(np.float32(canvas) * ratio))
    nw = max(1, int(np.float32(canvas) / ratio)) if tall else canvas
    board = np.zeros((canvas, canvas, 3), np.float32)
    board[:nh, :nw] = resize_nearest(rgb, nw, nh)
    return float(np.float32(h) / np.float32(nh)), ((board[:, :, ::-1] - MEAN) / SPREAD).transpose(2, 0, 1)[None].astype(np.float32)


def anchor_centers(width: int, height: int, stride: int, repeat: int = ANCHORS) -> np.ndarray:
    """(x, y) of every cell of a grid, row by row, each ``repeat`` times."""
    y, x = np.mgrid[:height, :width]
    return np.repeat(np.stack([x, y], -1).reshape(-1, 2) * stride, repeat, axis=0).astype(np.float32)


def boxes_from(anchors: np.ndarray, distances: np.ndarray) -> np.ndarray:
    """Boxes from distances to the left, top, right and bottom of an anchor."""
    return np.concatenate([anchors - distances[:, :2], anchors + distances[:, 2:]], 1)


def box_columns(anchor: Sequence[Column | str], distances: Sequence[Column | str]) -> list[Column]:
    """As `boxes_from`, of columns."""
    (x, y), (left, top, right, bottom) = (col(c) for c in anchor), (col(c) for c in distances)
    return [x - left, y - top, x + right, y + bottom]


def points_from(anchors: np.ndarray, distances: np.ndarray) -> np.ndarray:
    return distances + np.tile(anchors, distances.shape[1] // 2)


def order_by_score(scores: np.ndarray) -> np.ndarray:
    """Positions from the highest score down; equal ones keep their order."""
    return np.argsort(-scores, kind="stable")


def suppress(boxes: np.ndarray, most: float = MOST_OVERLAP) -> np.ndarray:
    """Positions of boxes, given from the highest score down, that overlap no kept one by more than ``most`` (areas count border pixels)."""
    size = (boxes[:, 2:] - boxes[:, :2] + 1).prod(1)
    kept, open_ = [], np.arange(len(boxes))
    while len(open_):
        first, open_ = open_[0], open_[1:]
        kept.append(first)
        low, high = np.maximum(boxes[first, :2], boxes[open_, :2]), np.minimum(boxes[first, 2:], boxes[open_, 2:])
        shared = np.maximum(high - low + 1, 0).prod(1)
        open_ = open_[shared / (size[first] + size[open_] - shared) <= most]
    return np.array(kept, int)


def suppress_faces(faces: DataFrame, most: float = MOST_OVERLAP) -> DataFrame:
    """Rows of ``faces`` (image_id, id, confidence, bbox in pixels) that remain after suppression within their image, best first, the smaller id first among equals."""

    def run(bounds: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        boxes = np.stack([rows.column(k).to_numpy() for k in range(3, 7)], 1)
        stays = np.ones(len(boxes), bool)
        for start, end in zip(bounds, bounds[1:]):
            if end - start > 1:
                stays[start:end] = False
                stays[start + suppress(boxes[start:end], most)] = True
        at = pa.array(np.flatnonzero(stays))
        yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at)], ["image_id", "id"])

    whole = faces.select("image_id", "id", "confidence", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2").dropna()
    ordered = whole.repartition("image_id").sortWithinPartitions("image_id", F.desc("confidence"), "id")
    kept = ordered.mapInArrow(by_group(0, run), "image_id long, id long")
    return faces.join(kept, ["image_id", "id"], "left_semi")


def anchors_table(spark, width: int, height: int, stride: int, repeat: int = ANCHORS) -> DataFrame:
    """(n, x, y) as `anchor_centers`, as a table."""
    n = F.col("id")
    cell = F.floor(n / repeat)
    return spark.range(width * height * repeat).select(n.alias("n"), (F.pmod(cell, F.lit(width)) * stride).alias("x"), (F.floor(cell / width) * stride).alias("y"))


def iou(a: Sequence[Column | str], b: Sequence[Column | str]) -> Column:
    """Overlap of two boxes, border pixels counted."""
    a, b = [col(x) for x in a], [col(x) for x in b]
    zero = F.lit(0.0)
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1, zero)
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1, zero)
    area = lambda q: (q[2] - q[0] + 1) * (q[3] - q[1] + 1)
    return w * h / (area(a) + area(b) - w * h)


@dataclass(frozen=True)
class Step:
    """One step of `Pipeline`: swap_channels, linear_scale, normalize, hwc_to_chw or add_batch_dim."""

    name: str
    options: dict = field(default_factory=dict)

    def apply(self, a: np.ndarray) -> np.ndarray:
        if self.name == "linear_scale":
            return a * self.options["scale"] + self.options["offset"]
        if self.name == "add_batch_dim":
            return a[None]
        if a.ndim != 3:
            raise ValueError(f"{self.name} needs an array of height, width and channels")
        if self.name == "swap_channels":
            return a[:, :, [2, 1, 0, *range(3, a.shape[2])]]
        if self.name == "normalize":
            return (a - np.array(self.options["mean"], a.dtype)) / np.array(self.options["std"], a.dtype)
        if self.name == "hwc_to_chw":
            return np.ascontiguousarray(a.transpose(2, 0, 1))
        raise ValueError(f"no step {self.name}")


@dataclass(frozen=True)
class Pipeline:
    """Steps applied in order; `to_list` and `from_list` give it a plain form."""

    steps: tuple[Step, ...] = ()

    def add(self, name: str, **options) -> Pipeline:
        return Pipeline((*self.steps, Step(name, options)))

    def run(self, image: np.ndarray) -> np.ndarray:
        for step in self.steps:
            image = step.apply(image)
        return image

    def to_list(self) -> list[dict]:
        return [{"name": s.name, **s.options} for s in self.steps]

    @staticmethod
    def from_list(rows: list[dict]) -> Pipeline:
        return Pipeline(tuple(Step(r["name"], {k: v for k, v in r.items() if k != "name"}) for r in rows))


def l2_normalize(v: np.ndarray) -> np.ndarray:
    length = float(np.sqrt((v * v).sum()))
    return v / length if length > 1e-10 else v


def detect(rgb: np.ndarray, run_model: Callable[[np.ndarray], list[np.ndarray]], embed: Callable[[np.ndarray], np.ndarray] | None = None) -> list[tuple[list[float], np.ndarray, float]]:
    """(box in fractions of the picture, embedding, score) of every face.

    ``run_model`` gives nine outputs: scores, distances of boxes and of landmarks, each for three strides. ``embed`` gets
    the face as CROP by CROP pixels, blue first.
    """
    scale, tensor = letterbox(rgb)
    outputs = run_model(tensor)
    if len(outputs) != 3 * len(STRIDES):
        raise ValueError(f"the detector has {len(outputs)} outputs, not {3 * len(STRIDES)}")
    scores, boxes = [], []
    for k, stride in enumerate(STRIDES):
        anchors = anchor_centers(CANVAS // stride, CANVAS // stride, stride)
        score = np.asarray(outputs[k], np.float32).reshape(-1)
        distance = np.asarray(outputs[k + len(STRIDES)], np.float32).reshape(-1, 4) * stride
        likely = score >= LEAST_SCORE
        scores.append(score[likely])
        boxes.append(boxes_from(anchors, distance)[likely] * scale)
    score, box = np.concatenate(scores), np.concatenate(boxes)
    order = order_by_score(score)
    order = order[suppress(box[order])] if len(order) else order
    h, w = rgb.shape[:2]
    out = []
    for i in order:
        part = np.clip(box[i] / np.array([w, h, w, h], np.float32), 0, 1)
        vector = np.zeros(0, np.float32)
        if embed is not None:
            x, y = int(part[0] * w), int(part[1] * h)
            crop = rgb[y : y + max(1, int((part[3] - part[1]) * h)), x : x + max(1, int((part[2] - part[0]) * w))]
            if crop.size:
                small = resize_mean(crop, CROP, CROP) if min(crop.shape[:2]) > CROP else resize_nearest(crop, CROP, CROP)
                vector = l2_normalize(np.asarray(embed(small[:, :, ::-1].astype(np.float32)), np.float32))
        out.append((part.tolist(), vector, float(score[i])))
    return out


def downscale_large(rgb: np.ndarray, side: int = LARGEST_SIDE) -> tuple[float, np.ndarray]:
    """(factor, picture): at most ``side`` pixels wide and high."""
    h, w = rgb.shape[:2]
    factor = min(1.0, side / max(h, w))
    return factor, rgb if factor == 1.0 else resize_mean(rgb, max(1, int(w * factor)), max(1, int(h * factor)))


def aligned_faces(boxes: np.ndarray, scores: np.ndarray, crops: np.ndarray, factor: float, width: int, height: int, embed: Callable[[np.ndarray], np.ndarray] | None = None) -> list[tuple[list[float], np.ndarray, float]]:
    """(box in fractions of the picture, embedding, score) from a model that gives boxes in pixels of its shrunk input and aligned crops, blue first."""
    out = []
    for box, score, crop in zip(boxes, scores, crops):
        part = np.clip(box / factor / np.array([width, height, width, height]), 0, 1)
        vector = l2_normalize(np.asarray(embed(resize_mean(crop, CROP, CROP).astype(np.float32)), np.float32)) if embed is not None else np.zeros(0, np.float32)
        out.append((part.tolist(), vector, float(score)))
    return out


def detect_images(images: DataFrame, load: Callable[[], Callable[[str], list[tuple[Sequence[float], Sequence[float], float]]]]) -> DataFrame:
    """Face rows of ``images`` (id, path). ``load`` is called once per task and gives a function of a path.

    An image without faces gets one row with confidence -1, a zero box and an empty embedding; one that fails gets none,
    so that it stays in the queue.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = load()
        for b in batches:
            rows = []
            for key, path in zip(b["id"], b["path"]):
                try:
                    found = find(path)
                except Exception:  # noqa: BLE001 - whatever a model raises
                    continue
                rows += [(key, *map(float, box), [float(x) for x in v], float(score)) for box, v, score in found] or [(key, 0.0, 0.0, 0.0, 0.0, [], -1.0)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return images.select("id", "path").mapInPandas(run, SCHEMA)


def describe_images(images: DataFrame, model_id: str, load: Callable[[], Callable[[str], str]], now: int) -> DataFrame:
    """(image_id, model_id, description, created_at): what a describer says, trimmed; images for which it fails are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        say = load()
        for b in batches:
            rows = []
            for key, path in zip(b["id"], b["path"]):
                try:
                    rows.append((key, model_id, say(path).strip(), now))
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(rows, columns=["image_id", "model_id", "description", "created_at"], dtype=object)

    return images.select("id", "path").mapInPandas(run, "image_id long, model_id string, description string, created_at long")


def chat_request(data: bytes, mime: str, model: str, prompt: str) -> dict:
    """The body of a chat server's request to describe a picture."""
    url = f"data:{mime};base64,{base64.b64encode(data).decode()}"
    return {"model": model, "messages": [{"role": "user", "content": [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": url}}]}], "max_tokens": MOST_ANSWER}


def chat_describer(server: str, model: str, prompt: str, timeout: float = ANSWER_SECONDS, send: Callable[[str, bytes, float], bytes] | None = None) -> Callable[[], Callable[[str], str]]:
    """For `describe_images`: asks a chat server below the address ``server``. ``send`` posts a body to an address, by default over HTTP."""

    def load() -> Callable[[str], str]:
        def say(path: str) -> str:
            body = json.dumps(chat_request(loadable(path), mime_of(path), model, prompt)).encode()
            answer = json.loads((send or _post)(server.rstrip("/") + CHAT_PATH, body, timeout))
            text = answer["choices"][0]["message"]["content"]
            if not isinstance(text, str):
                raise ValueError("the answer holds no text")
            return text.strip()

        return say

    return load


def _post(url: str, body: bytes, timeout: float) -> bytes:
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


def message_text(response: Column | str) -> Column:
    """The trimmed text in a chat server's JSON answer."""
    return F.trim(F.get_json_object(col(response), "$.choices[0].message.content"))


@dataclass(frozen=True)
class Device:
    """Where a model runs: cpu, cuda:N or tensorrt:N."""

    kind: str = "cpu"
    index: int = 0

    @staticmethod
    def parse(text: str) -> Device:
        kind, colon, index = text.strip().lower().partition(":")
        if (kind, colon) == ("cpu", ""):
            return Device()
        if kind in ("cuda", "tensorrt") and colon:
            if not (index.isascii() and index.isdigit()):
                raise ValueError(f"no device index: {index!r}")
            return Device(kind, int(index))
        raise ValueError(f"no device {text!r}: it is cpu, cuda:N or tensorrt:N")

    def __str__(self) -> str:
        return self.kind if self.kind == "cpu" else f"{self.kind}:{self.index}"

    def providers(self) -> list[str]:
        """Execution providers in order of preference."""
        more = {"cpu": [], "cuda": ["CUDAExecutionProvider"], "tensorrt": ["TensorrtExecutionProvider", "CUDAExecutionProvider"]}[self.kind]
        return [*more, "CPUExecutionProvider"]


def onnx_session(path: str, device: Device | None = None):
    """A function from a tensor to the outputs of an ONNX model; needs onnxruntime."""
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_BASIC
    options.enable_mem_pattern = False
    providers = [p for p in (device or Device()).providers() if p in ort.get_available_providers()]
    session = ort.InferenceSession(path, options, providers=providers)
    name = session.get_inputs()[0].name
    return lambda tensor: session.run(None, {name: tensor})


def build_detector(model: str, embedder: str | None = None, device: str = "cpu", open_model: Callable = onnx_session, pixels: Callable[[str], np.ndarray] = read_pixels) -> Callable[[], Callable[[str], list]]:
    """For `detect_images`: sessions of a detector and, if given, an embedder, opened once per task on a device, joined to a function of a path."""
    on = Device.parse(device)

    def load() -> Callable[[str], list]:
        find = open_model(model, on)
        vector = open_model(embedder, on) if embedder else None
        embed = (lambda crop: np.asarray(vector(crop.transpose(2, 0, 1)[None])[0], np.float32).reshape(-1)) if vector else None
        return lambda path: detect(pixels(path), find, embed)

    return load


def build_aligned_detector(model: str, embedder: str | None = None, device: str = "cpu", open_model: Callable = onnx_session, pixels: Callable[[str], np.ndarray] = read_pixels) -> Callable[[], Callable[[str], list]]:
    """As `build_detector`, of a model that takes the shrunk picture, blue first, and gives boxes, scores and aligned crops."""
    on = Device.parse(device)

    def load() -> Callable[[str], list]:
        find = open_model(model, on)
        vector = open_model(embedder, on) if embedder else None
        embed = (lambda crop: np.asarray(vector(crop.transpose(2, 0, 1)[None])[0], np.float32).reshape(-1)) if vector else None

        def of(path: str) -> list:
            rgb = pixels(path)
            factor, small = downscale_large(rgb)
            boxes, scores, crops = find(np.ascontiguousarray(small[:, :, ::-1]).astype(np.uint8))[:3]
            return aligned_faces(np.asarray(boxes, np.float32).reshape(-1, 4), np.asarray(scores, np.float32).reshape(-1), np.asarray(crops), factor, rgb.shape[1], rgb.shape[0], embed)

        return of

    return load
