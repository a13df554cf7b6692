"""Page images: quality metrics and verdicts, and the boxes of a detector's raw output. Numpy in Arrow batches.

An image column is struct<width:int, height:int, gray:binary>: one byte for each pixel, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.settings import DEFAULT, Settings

INK_BELOW = 200
NORMAL_WIDTH = 1000
GRID = 32


def effective_dpi(width: Column, height: Column, source: Column, render_dpi: float = 200.0, page_inches: float = 11.0) -> Column:
    """The rendering's resolution of a PDF page, else the longer edge over the page's assumed length."""
    return F.when(source == "pdf", F.lit(float(render_dpi))).otherwise(F.round(F.greatest(width, height) / page_inches, 1))


def _narrowed(gray: np.ndarray, width: int) -> np.ndarray:
    """The image no wider than `width`, by the means of the pixels that fall together."""
    if gray.shape[1] <= width:
        return gray
    step = gray.shape[1] / width
    cols = (np.arange(width) * step).astype(int)
    rows = (np.arange(max(1, int(gray.shape[0] / step))) * step).astype(int)
    sums = np.add.reduceat(np.add.reduceat(gray.astype(np.float64), rows, axis=0), cols, axis=1)
    counts = np.outer(np.diff(np.append(rows, gray.shape[0])), np.diff(np.append(cols, gray.shape[1])))
    return sums / counts


def focus(gray: np.ndarray, width: int = NORMAL_WIDTH) -> float:
    """Variance of the Laplacian of the image at a common width; edges are mirrored."""
    g = np.pad(_narrowed(gray, width).astype(np.float64), 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


_METRICS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("sharpness", "contrast", "brightness", "ink")])


@F.pandas_udf(_METRICS)
def image_metrics(image: pd.DataFrame) -> pd.DataFrame:
    """sharpness, contrast, brightness and share of ink; null for an image that is missing or too short."""
    out = []
    for w, h, data in zip(image["width"], image["height"], image["gray"], strict=True):
        if data is None or pd.isna(w) or pd.isna(h) or w < 1 or h < 1 or len(data) < w * h:
            out.append((None,) * 4)
            continue
        gray = np.frombuffer(data, np.uint8, int(w * h)).reshape(int(h), int(w))
        out.append((round(focus(gray), 1), float(gray.std()), float(gray.mean()), float((gray < INK_BELOW).mean())))
    return pd.DataFrame(out, columns=_METRICS.names)


def verdicts(m: Column, dpi: Column, settings: Settings = DEFAULT) -> Column:
    """(name, verdict) of each metric: pass or warn; contrast of an almost empty page isn't held against it."""
    blank = m["ink"] < settings.blank_ink
    tests = {
        "resolution": dpi < settings.min_dpi, "sharpness": m["sharpness"] < settings.blur,
        "contrast": ~blank & (m["contrast"] < settings.contrast), "brightness": m["brightness"] < settings.dark,
    }
    return F.array(*(F.struct(F.lit(n).alias("name"), F.when(F.coalesce(t, F.lit(True)), "warn").otherwise("pass").alias("verdict")) for n, t in tests.items()))


def said_of(checks: Column, page: Column) -> Column:
    """Texts of a page's warnings."""
    return F.transform(F.filter(checks, lambda c: c["verdict"] == "warn"), lambda c: F.concat(F.lit("page "), page, F.lit(": "), c["name"]))


def reasons_of(listed: Column) -> Column:
    """A document's reasons, from an array of (page, said)."""
    return F.array_distinct(F.flatten(F.transform(F.sort_array(listed), lambda x: x["said"])))


def prescan(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page") -> DataFrame:
    """(id, verdict, reasons) from page rows with `checks`: one warning makes the document warn."""
    listed = pages.select(id_col, page_col, said_of(F.col("checks"), F.col(page_col)).alias("said")).groupBy(id_col).agg(F.collect_list(F.struct(page_col, "said")).alias("p"))
    found = listed.select(id_col, reasons_of(F.col("p")).alias("reasons"))
    return found.select(id_col, F.when(F.size("reasons") > 0, "warn").otherwise("pass").alias("verdict"), "reasons")


def skew(angle: Column) -> Column:
    """An angle brought to (-45, 45]."""
    turned = angle - 90 * F.floor((angle + 45) / 90)
    return F.when(turned == -45, F.lit(45.0)).otherwise(turned)


def _met(owner: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i before j, of one owner's boxes that share a cell of its grid."""
    n = int(owner.max()) + 1
    low, high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
    np.minimum.at(low, owner, boxes[:, :2])
    np.maximum.at(high, owner, boxes[:, 2:])
    side = np.bincount(owner, (boxes[:, 2:] - boxes[:, :2]).max(axis=1), n) / np.maximum(1, np.bincount(owner, minlength=n))
    cell = np.maximum(np.maximum(side, (high - low).max(axis=1) / GRID), 1e-9)[owner][:, None]  # GRID cells a side at most
    first, last = ((np.floor((boxes[:, c : c + 2] - low[owner]) / cell)).astype(np.int64) for c in (0, 2))
    wide, tall = (last - first + 1).T
    of = np.repeat(np.arange(len(boxes)), wide * tall)
    k = np.arange(len(of)) - np.repeat(np.cumsum(wide * tall) - wide * tall, wide * tall)
    x, y = first[of, 0] + k % wide[of], first[of, 1] + k // wide[of]
    key = (owner[of] * (GRID + 2) + x) * (GRID + 2) + y
    order = np.lexsort((of, key))
    key, of, step, pairs = key[order], of[order], 1, []
    while len(at := np.flatnonzero(key[step:] == key[:-step])):
        pairs.append(of[at] * len(boxes) + of[at + step])
        step += 1
    return np.divmod(np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64), len(boxes))


def best_boxes(owner: np.ndarray, boxes: np.ndarray, scores: np.ndarray, least: float, overlap: float) -> np.ndarray:
    """Places of the boxes (x1, y1, x2, y2) that stay, by owner and then best first: those that overlap a better one that stays
    too much go, as do those with a score below `least`.

    All owners' boxes at once: boxes meet in the cells of a grid; in rounds, those with no better one left that they overlap
    stay, and what they overlap goes.
    """
    order = np.lexsort((np.arange(len(scores)), -scores, owner))
    order = order[scores[order] >= least]
    if not len(order):
        return order
    own, b = owner[order], boxes[order]
    area = np.maximum(0, b[:, 2] - b[:, 0]) * np.maximum(0, b[:, 3] - b[:, 1])
    i, j = _met(own, b)
    common = np.maximum(0, np.minimum(b[i, 2], b[j, 2]) - np.maximum(b[i, 0], b[j, 0])) * np.maximum(0, np.minimum(b[i, 3], b[j, 3]) - np.maximum(b[i, 1], b[j, 1]))
    too_near = common > overlap * (area[i] + area[j] - common)
    i, j = i[too_near], j[too_near]
    open_, kept = np.ones(len(order), bool), np.zeros(len(order), bool)
    while open_.any():
        stays = open_.copy()
        stays[j] = False
        kept |= stays
        open_ &= ~stays
        open_[j[stays[i]]] = False
        left = open_[i] & open_[j]
        i, j = i[left], j[left]
    return order[kept]


def detections(pages: DataFrame, id_cols: list[str], least: float = 0.45, overlap: float = 0.5) -> DataFrame:
    """(ids, x1, y1, x2, y2, score) from raw rows: candidates array<struct<cx,cy,w,h,score>>, scale, pad_x, pad_y, width, height."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("candidates"))
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            cx, cy, w, h, score = (x.to_numpy(zero_copy_only=False).astype(float) for x in lists.flatten().flatten())
            owner = np.repeat(np.arange(len(n)), n)
            boxes = np.stack([cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2], axis=1)
            at = best_boxes(owner, boxes, score, least, overlap)
            one = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(float)[owner[at]]
            scale = one("scale")
            placed = [np.clip((boxes[at, k] - one(f"pad_{'xy'[k % 2]}")) / scale, 0, one(("width", "height")[k % 2])) for k in range(4)]
            ids = [batch.column(batch.schema.get_field_index(c)).take(pa.array(owner[at])) for c in id_cols]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x) for x in placed), pa.array(score[at])], [*id_cols, "x1", "y1", "x2", "y2", "score"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in id_cols)
    number = lambda x: F.struct(*(x[c].cast("double").alias(c) for c in ("cx", "cy", "w", "h", "score")))
    chosen = pages.select(*id_cols, F.transform("candidates", number).alias("candidates"), "scale", "pad_x", "pad_y", "width", "height")
    return chosen.mapInArrow(run, f"{kinds}, x1 double, y1 double, x2 double, y2 double, score double")


def skewed(pages: DataFrame, angle_col: str = "angle", settings: Settings = DEFAULT) -> DataFrame:
    """pages with `skew`, the angle brought to (-45, 45], and `straighten`: whether it is beyond what is left as it is."""
    return pages.withColumn("skew", skew(F.col(angle_col))).withColumn("straighten", F.coalesce(F.abs("skew") > settings.max_skew_degrees, F.lit(False)))
