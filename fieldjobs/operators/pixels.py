"""Pixel metrics and image preparation, one Arrow batch of images at a time; only numbers leave the scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

WHITE, INVALID_FROM, EMPTY_FROM = 245, 0.05, 0.95
#: A pixel is in shadow below this brightness (of 255), after the image's 95th percentile is put at 1.
SHADOW = 55
METRICS = "mean_brightness double, sf_illuminorm double, contrast_rms double, white_fraction double, is_valid boolean, reason string"


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """RGB of Spark's image bytes (BGR order); of one or two channels (gray, transparency) the first is repeated, channels beyond three are left out.

    Two bytes a value (16-bit images) are told by the length of the data; the high byte counts.
    """
    a = np.frombuffer(bytes(data), np.uint8)
    if a.size == 2 * height * width * channels:
        a = (a.view("<u2") >> 8).astype(np.uint8)
    a = a.reshape(height, width, channels)
    return np.repeat(a[:, :, :1], 3, axis=2) if channels < 3 else a[:, :, 2::-1]


def measure(a: np.ndarray | None, v_threshold: float = SHADOW, white: int = WHITE) -> tuple:
    """Brightness, shadow fraction and contrast of an image; the white share and what it means.

    White fill is left out of the first two but not of contrast. The shadow fraction is
    the share of the other pixels whose brightness, over its 95th percentile, is below
    ``v_threshold`` / 255. An image that can't be read counts as all white, as does one
    whose channels are neither gray nor colour.
    """
    if a is None or a.size == 0:
        return None, None, None, 1.0, False, "load_error"
    if a.ndim != 3 or a.shape[2] != 3:
        return None, None, None, 1.0, False, "wrong_channels"
    fill = (a >= white).all(axis=2)
    share = float(fill.mean())
    reason = "fully_oob" if share >= EMPTY_FROM else "partially_oob_white" if share >= INVALID_FROM else "ok"
    gray = np.rint(a @ np.array([0.299, 0.587, 0.114]))
    v = a.max(axis=2)[~fill].astype(float)
    if not v.size:
        return None, None, None, share, False, reason
    shadow = v / (np.percentile(v, 95) + 1e-6) < v_threshold / 255
    return float(v.mean()), float(shadow.mean()), float(gray.std()), share, share < INVALID_FROM, reason


def pixel_covariates(images: DataFrame, v_threshold: float = SHADOW, white: int = WHITE) -> DataFrame:
    """``origin, basename`` and the metrics of each image; null images are load errors."""
    names = ["origin", "basename", *(x.split()[0] for x in METRICS.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(r.origin, r.basename, *measure(rgb(r.data, r.height, r.width, r.nChannels) if r.data is not None else None, v_threshold, white)) for r in pdf.itertuples()]
            yield pd.DataFrame(made, columns=names)

    src = images.select("origin", "basename", "image.data", "image.height", "image.width", "image.nChannels")
    return src.mapInPandas(run, f"origin string, basename string, {METRICS}")


def reason_counts(report: DataFrame) -> DataFrame:
    counts = report.groupBy("reason").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("n_valid"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select("reason", "n", "n_valid", (F.col("n") / F.col("_all")).alias("share"))


#: The usual channel means and deviations of natural images.
MEAN, SD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    r = np.clip((np.arange(height) + 0.5) * a.shape[0] / height - 0.5, 0, a.shape[0] - 1)
    c = np.clip((np.arange(width) + 0.5) * a.shape[1] / width - 0.5, 0, a.shape[1] - 1)
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    r1, c1 = np.minimum(r0 + 1, a.shape[0] - 1), np.minimum(c0 + 1, a.shape[1] - 1)
    fr, fc = (r - r0)[:, None, None], (c - c0)[None, :, None]
    rows = a[r0] * (1 - fr) + a[r1] * fr
    return rows[:, c0] * (1 - fc) + rows[:, c1] * fc


def prepare_images(images: DataFrame, size: int, crop: int | None = None, mean: tuple = MEAN, sd: tuple = SD) -> DataFrame:
    """``origin, tensor``: channel-first floats, resized, cropped at the centre if asked, scaled to 0..1 and normalised."""
    m, s = np.array(mean)[:, None, None], np.array(sd)[:, None, None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if r.data is None:
                    continue
                a = resized(rgb(r.data, r.height, r.width, r.nChannels).astype(float), size, size)
                if crop:
                    o = (size - crop) // 2
                    a = a[o : o + crop, o : o + crop]
                out.append((r.origin, ((a.transpose(2, 0, 1) / 255 - m) / s).astype(np.float32).ravel()))
            yield pd.DataFrame(out, columns=["origin", "tensor"])

    return images.select("origin", "image.data", "image.height", "image.width", "image.nChannels").mapInPandas(run, "origin string, tensor array<float>")


def restore(tensors: DataFrame, mean: tuple = MEAN, sd: tuple = SD) -> DataFrame:
    """``origin, pixels``: the prepared values back on 0..255, channel first."""
    per = F.size("tensor") / 3
    channel = lambda i: F.floor(i / per).cast("int")
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, sd))
    value = lambda x, i: F.greatest(F.lit(0), F.least(F.lit(255), F.round((x * F.get(s, channel(i)) + F.get(m, channel(i))) * 255))).cast("int")
    return tensors.select("origin", F.transform("tensor", value).alias("pixels"))
