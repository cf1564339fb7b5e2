"""Where models plug in: functions over batches of images, whose results are rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 20
FEATURES = 512


def detect(frames: DataFrame, model: Callable[[list[bytes]], list[Iterable[tuple]]], batch: int = BATCH, least: float = 0.1) -> DataFrame:
    """Detections of frames (match_id, frame_num, image): match_id, frame_num, det_order, object_class, confidence, x1 to y2.

    model: for up to ``batch`` images, a list of (class, confidence, x1, y1, x2, y2) each. It is made once a task if it is a
    callable object that loads on its first call.
    """

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                few, out = part.iloc[at : at + batch], []
                for match, frame, found in zip(few["match_id"], few["frame_num"], model([bytes(x) for x in few["image"]]), strict=True):
                    out += [(match, frame, k, *map(str, d[:1]), *map(float, d[1:])) for k, d in enumerate(found) if d[1] >= least]
                yield pd.DataFrame(out, columns=["match_id", "frame_num", "det_order", "object_class", "confidence", "x1", "y1", "x2", "y2"])

    schema = "match_id long, frame_num long, det_order int, object_class string, confidence double, x1 double, y1 double, x2 double, y2 double"
    return frames.select("match_id", "frame_num", "image").mapInPandas(rows, schema)


def read_crops(crops: DataFrame, reader: Callable[[], Callable[[bytes], Iterable[tuple[str, float]]]]) -> DataFrame:
    """Texts of crops (match_id, track_id, frame_num, quality, image): text, confidence, frame_num, crop_quality; and error.

    reader: makes the engine, once a task. A crop that it fails on gives no rows; an engine that cannot be made gives a row a
    crop with the reason and no text. Confidences are cut to 0..1.
    """
    names = ["match_id", "track_id", "frame_num", "text", "confidence", "crop_quality", "error"]

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, reason = None, None
        try:
            engine = reader()
        except Exception as e:  # noqa: BLE001
            reason = str(e)
        for part in parts:
            out = []
            for match, track, frame, quality, image in part[["match_id", "track_id", "frame_num", "quality", "image"]].itertuples(index=False, name=None):
                if engine is None:
                    out.append((match, track, frame, None, None, quality, reason))
                    continue
                try:
                    out += [(match, track, frame, str(t), min(1.0, max(0.0, float(c))), quality, None) for t, c in engine(bytes(image))]
                except Exception:  # noqa: BLE001, S112
                    continue
            yield pd.DataFrame(out, columns=names)

    schema = "match_id long, track_id long, frame_num long, text string, confidence double, crop_quality double, error string"
    return crops.select("match_id", "track_id", "frame_num", "quality", "image").mapInPandas(rows, schema)


def fixed_width(features: Column, width: int = FEATURES) -> Column:
    """The first ``width`` values, filled up with zeros."""
    head = F.slice(features, 1, width)
    return F.concat(head, F.array_repeat(F.lit(0.0).cast("float"), F.lit(width) - F.size(head)))


def equalised(grey: np.ndarray, clip: float = 2.0) -> np.ndarray:
    """A grey crop with its histogram made even; no value counts for more than ``clip`` times the mean, what is cut off goes to all."""
    counts = np.bincount(grey.ravel(), minlength=256)
    limit = max(1, int(clip * grey.size / 256))
    cut = np.minimum(counts, limit)
    upto = 256 * np.cumsum(cut) + np.arange(1, 257) * (grey.size - cut.sum())  # 256 times the count up to a value
    return ((2 * 255 * upto + 256 * grey.size) // (2 * 256 * grey.size))[grey].astype(np.int64)


def unsharp(grey: np.ndarray) -> np.ndarray:
    """1.8 times a crop less 0.8 times its blur by a kernel of three, cut to 0..255, in whole numbers."""
    p = np.pad(grey, 1, mode="reflect" if min(grey.shape) > 1 else "edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    blur = rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]  # 16 times the mean
    return np.clip((288 * grey - 8 * blur + 80) // 160, 0, 255)


class CropVariants:
    """A table function: for a grey crop as bytes, rows of points, the crop as it is (variant 0) and evened and sharpened (1).

    An empty crop, and one whose size is not height times width, has no variants.
    """

    def eval(self, image: bytes, height: int, width: int) -> Iterator[tuple[int, bytes]]:
        if not image or not height or not width or height * width != len(image):
            return
        grey = np.frombuffer(image, dtype=np.uint8).reshape(height, width)
        yield 0, bytes(image)
        yield 1, unsharp(equalised(grey)).astype(np.uint8).tobytes()


def crop_variants(crops: DataFrame) -> DataFrame:
    """crops (image, height, width, and other columns) with variant and the variant's image in place of the crop's, in a lateral join.

    Both variants of a crop keep its frame, so a text that is read from both has twice the weight in the consensus of readings
    but supports it once.
    """
    variants = F.udtf(CropVariants, returnType="variant int, variant_image binary")
    image, height, width = (F.col(c).outer() for c in ("image", "height", "width"))
    rows = crops.lateralJoin(variants(image, height.cast("int"), width.cast("int")))
    return rows.drop("image").withColumnRenamed("variant_image", "image")
