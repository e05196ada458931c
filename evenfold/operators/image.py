"""Gray images: Otsu's threshold, binarization, crops and the readings' variants.

An image is a row (image_id, width, height, pixels binary), one byte a pixel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IMAGES = "image_id string, width int, height int, pixels binary"
#: What regions are called.
REGIONS = ("title_block", "invoice_totals", "structural_table", "signature")
VARIANTS = ("original", "high_contrast", "rotated")


def otsu_of(histogram: np.ndarray) -> int:
    """The least level that parts 256 counts with the greatest variance between the parts; 128 for a flat or empty histogram."""
    n = histogram.astype(np.float64)
    below = np.cumsum(n)
    above = below[-1] - below
    sums = np.cumsum(n * np.arange(256))
    ok = (below > 0) & (above > 0)
    if not ok.any():
        return 128
    gap = np.zeros(256)
    gap[ok] = sums[ok] / below[ok] - (sums[-1] - sums[ok]) / above[ok]
    between = np.where(ok, below * above * gap**2, 0.0)
    return int(between.argmax()) if between.max() > 0 else 128


def otsu_table(histograms: DataFrame) -> DataFrame:
    """(image_id, threshold) of rows (image_id, level 0-255, n): the same in windows over at most 256 rows an image."""
    levels = histograms.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("level").cast("int"), F.col("n").cast("double")))).alias("m"))
    rows = levels.select("image_id", "m", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("t")).select("image_id", "t", F.coalesce(F.try_element_at("m", F.col("t")), F.lit(0.0)).alias("n"))
    w = Window.partitionBy("image_id")
    upto = w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"b": F.sum("n").over(upto), "s": F.sum(F.col("n") * F.col("t")).over(upto), "all": F.sum("n").over(w), "sum": F.sum(F.col("n") * F.col("t")).over(w)})
    above = F.col("all") - F.col("b")
    gap = F.col("s") / F.col("b") - (F.col("sum") - F.col("s")) / above
    rows = rows.withColumn("v", F.when((F.col("b") > 0) & (above > 0), F.col("b") * above * gap * gap).otherwise(0.0))
    best = rows.groupBy("image_id").agg(F.max("v").alias("v"), F.max_by("t", F.struct("v", -F.col("t"))).alias("t"))
    return best.select("image_id", F.when(F.col("v") > 0, F.col("t")).otherwise(128).alias("threshold"))


def png(gray: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    h, w = gray.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.hstack([np.zeros((h, 1), np.uint8), gray]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def read_gray(spark, path: str) -> DataFrame:
    """Gray images of the PNG, JPEG and other files under a path; files that are no image are left out."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, h, w, n, data in zip(b["origin"], b["height"], b["width"], b["nChannels"], b["data"], strict=True):
                px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                out.append((name, w, h, (px[..., 0] if n == 1 else luma(px[..., 2::-1])).tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "pixels"])

    return raw.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, IMAGES)


def binarize(gray: np.ndarray, threshold: int) -> np.ndarray:
    return np.where(gray > threshold, 255, 0).astype(np.uint8)


def luma(rgb: np.ndarray) -> np.ndarray:
    """Gray of an RGB array by the weights of BT.709."""
    return np.clip(rgb[..., :3].astype(np.float64) @ [0.2126, 0.7152, 0.0722], 0, 255).astype(np.uint8)


def _lanczos(n: int, m: int) -> np.ndarray:
    """Weights that resample n samples to m, three lobes wide."""
    ratio = n / m
    wide = max(ratio, 1.0)
    centre = (np.arange(m) + 0.5) * ratio
    x = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / wide
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos resampling to exactly this size; an empty image gives zeros."""
    if not gray.size:
        return np.zeros((height, width), np.uint8)
    out = _lanczos(gray.shape[0], height) @ gray.astype(np.float64) @ _lanczos(gray.shape[1], width).T
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def nearest(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    y = np.minimum(((np.arange(height) + 0.5) * gray.shape[0] / height).astype(int), gray.shape[0] - 1)
    x = np.minimum(((np.arange(width) + 0.5) * gray.shape[1] / width).astype(int), gray.shape[1] - 1)
    return gray[y][:, x]


def variant_of(gray: np.ndarray, variant: str) -> tuple[np.ndarray, int | None, float | None, tuple[int, int]]:
    """(image, threshold, resize factor, (width, height) read): original and unknown variants stay gray, high_contrast is binarized, rotated
    loses its detail at 60 percent of the size."""
    h, w = gray.shape
    if variant == "high_contrast":
        t = otsu_of(np.bincount(gray.ravel(), minlength=256))
        return binarize(gray, t), t, None, (w, h)
    if variant == "rotated" and gray.size:
        small = max(1, int(np.float32(w) * np.float32(0.6))), max(1, int(np.float32(h) * np.float32(0.6)))
        return resize(nearest(gray, *small), w, h), None, 0.6, small
    return gray, None, None, (w, h)


_VARIANT = "image_id string, variant string, width int, height int, pixels binary, threshold int, resize_factor float, roi_width int, roi_height int"


def variants(images: DataFrame, names: tuple[str, ...] = VARIANTS) -> DataFrame:
    """Every image in every variant, with what was done to it. Rows whose pixels don't fill width times height are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, w, h, p in zip(b["image_id"], b["width"], b["height"], b["pixels"], strict=True):
                gray = np.frombuffer(p, np.uint8).reshape(h, w)
                for name in names:
                    got, t, f, small = variant_of(gray, name)
                    out.append((i, name, w, h, got.tobytes(), t, f, *small))
            yield pd.DataFrame(out, columns=["image_id", "variant", "width", "height", "pixels", "threshold", "resize_factor", "roi_width", "roi_height"]).astype({"threshold": "Int32"})

    ok = images.where(F.octet_length("pixels") == F.col("width") * F.col("height"))
    return ok.select("image_id", "width", "height", "pixels").mapInPandas(run, _VARIANT)


_REGION = "image_id string, kind string, name string, width int, height int, pixels binary, threshold int, resize_factor float, roi_width int, roi_height int"


def regions(images: DataFrame) -> DataFrame:
    """Crops of rows with roi struct<x, y, width, height, kind, resize struct<w, h>>: clamped to the image, binarized, resized if asked for; named
    <kind>_<x>_<y>. An empty crop has no threshold and, if it is to be resized, the factor 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, w, h, p, roi in zip(b["image_id"], b["width"], b["height"], b["pixels"], b["roi"], strict=True):
                gray = np.frombuffer(p, np.uint8).reshape(h, w)
                x, y = min(roi["x"], w), min(roi["y"], h)
                crop = gray[y : y + roi["height"], x : x + roi["width"]]
                t = otsu_of(np.bincount(crop.ravel(), minlength=256)) if crop.size else None
                got, to, f = crop if t is None else binarize(crop, t), roi["resize"], None
                if to is not None:
                    f = to["w"] / crop.shape[1] if crop.shape[1] else 1.0
                    got = resize(got, to["w"], to["h"])
                out.append((i, roi["kind"], f"{roi['kind']}_{roi['x']}_{roi['y']}", got.shape[1], got.shape[0], got.tobytes(), t, f, crop.shape[1], crop.shape[0]))
            yield pd.DataFrame(out, columns=["image_id", "kind", "name", "width", "height", "pixels", "threshold", "resize_factor", "roi_width", "roi_height"]).astype({"threshold": "Int32"})

    return images.where("roi is not null").select("image_id", "width", "height", "pixels", "roi").mapInPandas(run, _REGION)
