"""Arrow functions over encoded pixels: the physical form of the sharpness score, and detectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, LongType, StructField, StructType

from ..functions import constants as C
from .pixels import MOMENTS, downscale_factor

DETECTION = (
    "ord int, label string, confidence float, box struct<x:double,y:double,w:double,h:double>, "
    "eye_kps array<struct<x:double,y:double>>, nose struct<x:double,y:double>"
)


def gray_image(width: int, height: int, channels: int, data: bytes):
    """Luma of a buffer with channels blue, green, red (and alpha), or of a gray one."""
    import numpy as np

    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return pixels[:, :, 0].astype(np.int32)
    p = pixels[:, :, :3].astype(np.int32)
    return (p[:, :, 2] * 299 + p[:, :, 1] * 587 + p[:, :, 0] * 114) // 1000


def block_mean(g, block: int):
    """Truncated mean over blocks; blocks at the far edges may be smaller."""
    import numpy as np

    if block == 1:
        return g
    rows, cols = np.arange(0, g.shape[0], block), np.arange(0, g.shape[1], block)
    sums = np.add.reduceat(np.add.reduceat(g.astype(np.int64), rows, axis=0), cols, axis=1)
    heights = np.diff(np.append(rows, g.shape[0]))[:, None]
    widths = np.diff(np.append(cols, g.shape[1]))[None, :]
    return sums // (heights * widths)


def moments(g) -> tuple[int, int, int, int, int] | None:
    """Integer moments of the two second differences; none without interior pixels."""
    import numpy as np

    if g.shape[0] < 3 or g.shape[1] < 3:
        return None
    g = g.astype(np.int64)
    centre = 2 * g[1:-1, 1:-1]
    h = centre - g[1:-1, :-2] - g[1:-1, 2:]
    v = centre - g[:-2, 1:-1] - g[2:, 1:-1]
    return h.size, int(h.sum()), int((h * h).sum()), int(v.sum()), int((v * v).sum())


BUFFER_TYPE = StructType([
    StructField("width", IntegerType()), StructField("height", IntegerType()),
    StructField("channels", IntegerType()), StructField("data", BinaryType()),
])
MOMENTS_TYPE = StructType([StructField(k, LongType()) for k in MOMENTS])


@F.pandas_udf(BUFFER_TYPE)
def shrink_udf(image: pd.DataFrame, block: pd.Series) -> pd.DataFrame:
    """Gray and downscaled: one byte per pixel, so that what follows moves as little as possible."""
    import numpy as np

    out = []
    for w, h, c, data, k in zip(image["width"], image["height"], image["channels"], image["data"], block):
        if data is None or pd.isna(w):
            out.append((None, None, None, None))
            continue
        g = block_mean(gray_image(int(w), int(h), int(c), data), int(k)).astype(np.uint8)
        out.append((g.shape[1], g.shape[0], 1, g.tobytes()))
    frame = pd.DataFrame(out, columns=["width", "height", "channels", "data"])
    return frame.astype({"width": "Int32", "height": "Int32", "channels": "Int32"})


@F.pandas_udf(MOMENTS_TYPE)
def laplacian_udf(image: pd.DataFrame, block: pd.Series, window: pd.DataFrame) -> pd.DataFrame:
    """Gray, downscale, crop and moments of ``struct<width, height, channels, data>`` per row.

    ``block`` is the downscale factor and ``window`` the crop ``struct<x0, y0, x1, y1>`` in
    downscaled pixels. Whole frames never become rows, so nothing is shuffled.
    """
    out = []
    for w, h, c, data, k, x0, y0, x1, y1 in zip(
        image["width"], image["height"], image["channels"], image["data"], block,
        window["x0"], window["y0"], window["x1"], window["y1"],
    ):
        if data is None or pd.isna(w) or pd.isna(x0):
            out.append(None)
            continue
        g = block_mean(gray_image(int(w), int(h), int(c), data), int(k))
        out.append(moments(g[int(y0):int(y1), int(x0):int(x1)]))
    rows = [m if m is not None else (None,) * 5 for m in out]
    return pd.DataFrame(rows, columns=list(MOMENTS)).astype("Int64")


def running_sums(g):
    """``[5, h + 1, w + 1]``: sums of 1, both second differences and their squares over everything above and to the left."""
    import numpy as np

    h, w = g.shape
    out = np.zeros((len(MOMENTS), h + 1, w + 1), np.int64)
    if h < 3 or w < 3:
        return out
    g = g.astype(np.int64)
    centre = 2 * g[1:-1, 1:-1]
    along, across = centre - g[1:-1, :-2] - g[1:-1, 2:], centre - g[:-2, 1:-1] - g[2:, 1:-1]
    for k, d in enumerate((np.ones_like(along), along, along * along, across, across * across)):
        out[k, 2:h, 2:w] = d.cumsum(0).cumsum(1)
    return out


@F.pandas_udf(ArrayType(MOMENTS_TYPE))
def regions_udf(image: pd.DataFrame, block: pd.Series, windows: pd.Series) -> pd.Series:
    """Moments of every window of an image, ``array<struct<x0, y0, x1, y1>>`` in downscaled pixels: the image is gone through once,
    and each window takes four looks into its running sums. Equal to ``laplacian_udf`` for each; ``n`` is 0 where that is null.
    """
    import numpy as np

    out = []
    for w, h, c, data, k, regions in zip(image["width"], image["height"], image["channels"], image["data"], block, windows):
        if data is None or pd.isna(w) or regions is None:
            out.append(None)
            continue
        g = block_mean(gray_image(int(w), int(h), int(c), data), int(k))
        sums = running_sums(g)
        at = np.array([[r["x0"], r["y0"], r["x1"], r["y1"]] for r in regions], np.int64).reshape(-1, 4)
        # Pixels whose neighbours all lie in the window too.
        x0, y0 = at[:, 0] + 1, at[:, 1] + 1
        x1, y1 = np.maximum(np.minimum(at[:, 2], g.shape[1]) - 1, x0), np.maximum(np.minimum(at[:, 3], g.shape[0]) - 1, y0)
        x0, y0, x1, y1 = np.minimum(x0, g.shape[1]), np.minimum(y0, g.shape[0]), np.minimum(x1, g.shape[1]), np.minimum(y1, g.shape[0])
        found = sums[:, y1, x1] - sums[:, y0, x1] - sums[:, y1, x0] + sums[:, y0, x0]
        out.append([dict(zip(MOMENTS, column)) for column in found.T.tolist()])
    return pd.Series(out)


@F.pandas_udf(MOMENTS_TYPE)
def grid_moments_udf(grid: pd.Series, width: pd.Series, window: pd.DataFrame) -> pd.DataFrame:
    """Moments of row-major integer arrays inside ``struct<x0, y0, x1, y1>`` windows.

    Arrays of one shape are stacked and done in one step, each under the mask of its own window. An array
    that holds a null, or whose size is no multiple of its width, has no moments.
    """
    import numpy as np

    grid = pd.Series([None if g is None or pd.isna(g).any() else g for g in grid], index=grid.index)

    out = pd.DataFrame(pd.NA, index=grid.index, columns=list(MOMENTS), dtype="Int64")
    shapes = pd.DataFrame({
        "size": [-1 if g is None else len(g) for g in grid], "width": width.to_numpy(),
        "known": window["x0"].notna().to_numpy()}, index=grid.index)
    for (size, w), part in shapes[shapes["known"]].groupby(["size", "width"]):
        w = int(w)
        if size < 9 or w < 3 or size // w < 3 or size % w:
            continue
        g = np.stack(grid.loc[part.index].to_numpy()).reshape(len(part), -1, w).astype(np.int64)
        x0, y0, x1, y1 = [window.loc[part.index, k].to_numpy().astype(np.int64)[:, None] for k in ("x0", "y0", "x1", "y1")]
        ys, xs = np.arange(1, g.shape[1] - 1)[None, :], np.arange(1, w - 1)[None, :]
        inside = ((ys > y0) & (ys < y1 - 1))[:, :, None] & ((xs > x0) & (xs < x1 - 1))[:, None, :]
        count = inside.sum(axis=(1, 2))
        centre = 2 * g[:, 1:-1, 1:-1]
        columns = {"n": count}
        for name, d in (
            ("h", centre - g[:, 1:-1, :-2] - g[:, 1:-1, 2:]), ("v", centre - g[:, :-2, 1:-1] - g[:, 2:, 1:-1])
        ):
            d = d * inside
            columns[f"sum_{name}"] = d.sum(axis=(1, 2))
            columns[f"ss_{name}"] = (d * d).sum(axis=(1, 2))
        found = pd.DataFrame(columns, index=part.index)[list(MOMENTS)]
        out.loc[part.index[count > 0]] = found[count > 0]
    return out


def full_window(width: Column, height: Column) -> Column:
    zero = F.lit(0)
    return F.struct(
        zero.alias("x0"), zero.alias("y0"), width.cast("int").alias("x1"), height.cast("int").alias("y1")
    )


Detector = Callable[..., list[tuple]]


def model_of(name: uuid.UUID, load: Callable) -> object:
    """Spark's cache of models, one for each Python worker: functions of this package are sent anew with every task."""
    if ModelCache.get(name) is None:
        ModelCache.add(name, (load(),))
    return ModelCache.get(name)[0]


def detect_with(
    images: DataFrame, load: Callable[[], Detector | None], key: str = "path", image: str = "image"
) -> DataFrame:
    """Runs a detector over images and returns ``(path, ord, label, confidence, box, eye_kps, nose)``.

    ``load`` runs once per Python worker and returns a function from a gray array to detections
    ``(label, confidence, (x, y, w, h), eye points, nose point or None)``, or None if there is no
    model; the result is empty then. Detections are numbered in the order they are given. Images keep their size and are
    given one by one; ``detect_in_batches`` is for models of a fixed size.
    """
    key_type, name = dict(images.dtypes)[key], uuid.uuid4()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = model_of(name, load)
        for batch in batches:
            rows = []
            if detector is not None:
                for path, w, h, c, data in batch.itertuples(index=False, name=None):
                    if data is None or pd.isna(w):
                        continue
                    found = detector(gray_image(int(w), int(h), int(c), data))
                    for i, (label, confidence, box, eyes, nose) in enumerate(found):
                        rows.append((path, i, label, confidence, _as_rect(box), [_as_point(p) for p in eyes],
                                     None if nose is None else _as_point(nose)))
            yield pd.DataFrame(rows, columns=[key, "ord", "label", "confidence", "box", "eye_kps", "nose"])

    flat = images.select(key, f"{image}.width", f"{image}.height", f"{image}.channels", f"{image}.data")
    return flat.mapInPandas(run, f"{key} {key_type}, {DETECTION}")


@F.pandas_udf(ArrayType(FloatType()))
def letterbox_udf(image: pd.DataFrame, block: pd.Series, side: pd.Series) -> pd.Series:
    """Gray, downscaled, in the upper left corner of a black square of ``side`` pixels, row by row, 0..1."""
    import numpy as np

    out = []
    for w, h, c, data, k, n in zip(image["width"], image["height"], image["channels"], image["data"], block, side):
        if data is None or pd.isna(w):
            out.append(None)
            continue
        g = block_mean(gray_image(int(w), int(h), int(c), data), int(k))
        square = np.zeros((n, n), np.float32)
        square[:g.shape[0], :g.shape[1]] = g / np.float32(255)
        out.append(square.ravel())
    return pd.Series(out)


def detect_in_batches(
    images: DataFrame, load: Callable[[], Callable], labels: list[str], side: int = C.DETECTOR_SIDE, batch: int = 32, key: str = "path",
    image: str = "image",
) -> DataFrame:
    """The same rows from a model that takes many images of one size at once.

    ``load`` runs once per Python worker and returns a function from a numpy array ``[n, side, side]`` of gray levels (0..1) to
    n lists of ``[class, confidence, x, y, w, h]``, in pixels of the square from the upper left. Images are made small by whole
    blocks and fill the square from its corner; boxes are given back as parts of the image. An image that cannot be decoded has no detections.
    """

    def make() -> Callable:
        import numpy as np

        predict = load()
        # Six numbers for each detection, on end.
        return lambda squares: [{"found": np.array([v for row in found for v in row], np.float32)} for found in predict(squares)]

    model = predict_batch_udf(
        make, return_type=StructType([StructField("found", ArrayType(FloatType()))]), batch_size=batch, input_tensor_shapes=[[side, side]])
    width, height = F.col(f"{image}.width"), F.col(f"{image}.height")
    block = downscale_factor(width, height, side)
    squares = images.where(width.isNotNull()).select(
        key, block.alias("_block"), (width / block).alias("_w"), (height / block).alias("_h"),
        letterbox_udf(F.col(image), block, F.lit(side)).alias("_square"))
    found = squares.where(F.col("_square").isNotNull()).select(key, "_w", "_h", model("_square").alias("_model"))
    ends = F.filter(F.sequence(F.lit(0), F.size("_model.found"), F.lit(6)), lambda i: i < F.size("_model.found"))
    rows = found.select(key, "_w", "_h", F.posexplode(F.transform(ends, lambda i: F.slice("_model.found", i + 1, F.lit(6)))).alias("ord", "_row"))

    def part(i: int, size: str) -> Column:
        return (F.col("_row")[i] / F.col(size)).cast("double")

    box = F.struct(part(2, "_w").alias("x"), part(3, "_h").alias("y"), part(4, "_w").alias("w"), part(5, "_h").alias("h"))
    label = F.get(F.array(*map(F.lit, labels)), F.col("_row")[0].cast("int"))
    fields = StructType.fromDDL(DETECTION)
    return rows.select(
        key, "ord", F.coalesce(label, F.lit("unknown")).alias("label"), F.col("_row")[1].alias("confidence"),
        box.cast(fields["box"].dataType).alias("box"), F.array().cast(fields["eye_kps"].dataType).alias("eye_kps"),
        F.lit(None).cast(fields["nose"].dataType).alias("nose"))


def _as_rect(box) -> dict:
    return dict(zip("xywh", map(float, box)))


def _as_point(p) -> dict:
    return dict(zip("xy", map(float, p)))
