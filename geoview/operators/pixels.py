"""Pixel operators: integration, contrast, composition, stencils and borders.

Pixels are rows (image, x, y, channels) where they are aggregated, or arrays in
row order where a whole image is one record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.camera import Camera
from .footprints import met_by_cell

RGB = ("r", "g", "b")


def image_pixels(images: DataFrame, image_col: str, array_col: str, width: int, channels: int = 1) -> DataFrame:
    """(image, x, y, v0..) from images stored as arrays in row order."""
    cells = images.select(image_col, F.posexplode(array_col).alias("pos", "v"))
    at = F.floor(F.col("pos") / channels)
    cells = cells.select(image_col, (at % width).cast("int").alias("x"), F.floor(at / width).cast("int").alias("y"), (F.col("pos") % channels).alias("ch"), "v")
    if channels == 1:
        return cells.select(image_col, "x", "y", F.col("v").alias("v0"))
    return cells.groupBy(image_col, "x", "y").agg(*[F.max(F.when(F.col("ch") == i, F.col("v"))).alias(f"v{i}") for i in range(channels)])


def integral(pixels: DataFrame, by: list[str], channels: tuple[str, ...] = RGB, overlap: str = "a", threshold: float = 0.1) -> DataFrame:
    """Mean of the overlapping views of each pixel, where the overlap is more
    than the threshold.  Sums are commutative, so tasks add up first and one row
    per pixel and task is shuffled."""
    sums = pixels.groupBy(*by).agg(*[F.sum(c).alias(c) for c in channels], F.sum(overlap).alias("overlap"))
    return sums.filter(F.col("overlap") > threshold).select(*by, *[(F.col(c) / F.col("overlap")).alias(c) for c in channels], "overlap")


def integral_or_zero(pixels: DataFrame, by: list[str], channels: tuple[str, ...] = RGB, overlap: str = "a") -> DataFrame:
    """Sums over an overlap of at least 1; pixels without overlap stay."""
    return pixels.groupBy(*by).agg(*[(F.sum(c) / F.greatest(F.sum(overlap), F.lit(1.0))).alias(c) for c in channels])


def blended(pixels: DataFrame, by: list[str], channels: tuple[str, ...] = RGB) -> DataFrame:
    """Plain mean of images."""
    return pixels.groupBy(*by).agg(*[F.avg(c).alias(c) for c in channels])


def auto_contrast(pixels: DataFrame, image: list[str], channels: tuple[str, ...] = RGB) -> DataFrame:
    """Channels stretched jointly by the least and greatest value of any of them
    in the image; an image of one value becomes 0.  The two numbers per image
    are an aggregate that joins back, so no task holds an image's pixels."""
    low, high = (f(*[g(c) for c in channels]) if len(channels) > 1 else g(channels[0]) for f, g in ((F.least, F.min), (F.greatest, F.max)))
    ends = pixels.groupBy(*image).agg(low.alias("low__"), high.alias("high__"))
    out = pixels.join(ends, image) if image else pixels.crossJoin(F.broadcast(ends))  # one row
    span = F.col("high__") - F.col("low__")
    return out.withColumns({c: F.when(span > 0, (F.col(c) - F.col("low__")) / span).otherwise(F.lit(0.0)) for c in channels}).drop("low__", "high__")


def to_byte(v: Column) -> Column:
    """0..1 to 0..255, towards zero."""
    return (v * 255).cast("int")


def normalized(v: Column, image_max: Column) -> Column:
    """Divided by 255 if the image holds values over 1."""
    return F.when(image_max > 1, v / 255.0).otherwise(v)


def normalize_images(pixels: DataFrame, image: list[str], channels: tuple[str, ...], height: int | None = None) -> DataFrame:
    """Every image in 0..1, upside down if ``height`` is given."""
    top = F.greatest(*[F.max(c) for c in channels]) if len(channels) > 1 else F.max(channels[0])
    out = pixels.join(pixels.groupBy(*image).agg(top.alias("top__")), image)
    out = out.withColumns({c: normalized(F.col(c), F.col("top__")) for c in channels}).drop("top__")
    return out.withColumn("y", F.lit(height - 1) - F.col("y")) if height else out


def overlay(under: Column, over: Column, alpha: Column | None, whole: bool = False) -> Column:
    """``over`` on ``under`` by alpha, which counts to 255 for integers."""
    if alpha is None:
        return over
    a = alpha / 255.0 if whole else alpha
    return over * a + under * (1 - a)


def overlay_images(under: DataFrame, over: DataFrame, on: list[str], channels: tuple[str, ...] = RGB, alpha: str = "a", whole: bool = False) -> DataFrame:
    top = over.select(*on, *[F.col(c).alias(f"{c}__") for c in (*channels, alpha)])
    return under.join(top, on).select(*on, *[overlay(F.col(c), F.col(f"{c}__"), F.col(f"{alpha}__"), whole).alias(c) for c in channels])


def replaced_color(colors: dict[str, Column], old: tuple, new: tuple) -> dict[str, Column]:
    """Channels recoloured where all of them equal ``old``."""
    same = F.lit(True)
    for c, o in zip(colors.values(), old):
        same = same & (c == F.lit(o))
    return {n: F.when(same, F.lit(v)).otherwise(c) for (n, c), v in zip(colors.items(), new)}


def binary_mask(v: Column) -> Column:
    """1 at 255, else 0."""
    return F.when(v < 255, 0.0).otherwise(1.0)


def soft_mask(v: Column) -> Column:
    return v / 255.0


def masked(pixels: DataFrame, mask: DataFrame, on: list[str], channels: tuple[str, ...] = (*RGB, "a")) -> DataFrame:
    """Channels times the mask; pixels without one stay as they are."""
    out = pixels.join(mask.select(*on, F.col("m").alias("m__")), on, "left")
    m = F.coalesce("m__", F.lit(1.0))
    return out.withColumns({c: F.col(c) * m for c in channels}).drop("m__")


def mirrored(i: Column, n: int) -> Column:
    """Index behind the border, reflected without the border itself."""
    return F.abs(F.lit(n - 1) - F.abs(F.lit(n - 1) - i)) if n > 1 else F.lit(0)


def laplacian_variance(images: DataFrame, image_col: str, array_col: str, width: int, height: int) -> DataFrame:
    """Population variance of the 4-neighbour Laplacian of each image.

    An image is one record; the stencil is an expression over its array, which
    needs no shuffle.
    """
    v = F.col(array_col)
    at = lambda x, y: F.get(v, (y * width + x).cast("int")).cast("double")

    def lap(i: Column) -> Column:
        x, y = i % width, F.floor(i / width)
        around = at(mirrored(x - 1, width), y) + at(mirrored(x + 1, width), y) + at(x, mirrored(y - 1, height)) + at(x, mirrored(y + 1, height))
        return around - 4.0 * at(x, y)

    values = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lap)
    n = float(width * height)
    mean = F.aggregate("lap__", F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate("lap__", F.lit(0.0), lambda a, x: a + (x - F.col("mean__")) * (x - F.col("mean__"))) / n
    return images.select(image_col, values.alias("lap__")).withColumn("mean__", mean).select(image_col, var.alias("laplacian_variance"))


def content_borders(pixels: DataFrame, image_col: str, value_col: str, width: int, height: int) -> DataFrame:
    """(image, top, right, bottom, left) of what remains without the largest
    border of one corner colour; right and bottom are exclusive.

    Images whose four corners differ stay whole.  Ties between colours go to
    the first corner in the order top left, bottom left, bottom right, top right.
    """
    corner = lambda x, y: F.max(F.when((F.col("x") == x) & (F.col("y") == y), F.col(value_col)))
    places = [(0, 0), (0, height - 1), (width - 1, height - 1), (width - 1, 0)]
    corners = pixels.groupBy(image_col).agg(F.array(*[corner(x, y) for x, y in places]).alias("corners"))
    colors = corners.select(image_col, F.array_distinct("corners").alias("colors")).select(image_col, F.size("colors").alias("kinds"), F.posexplode("colors").alias("rank", "color"))
    other = F.col(value_col) != F.col("color")
    inner = pixels.join(colors, image_col).groupBy(image_col, "rank", "kinds").agg(
        F.min(F.when(other, F.col("x"))).alias("left"), F.max(F.when(other, F.col("x")) + 1).alias("right"),
        F.min(F.when(other, F.col("y"))).alias("top"), F.max(F.when(other, F.col("y")) + 1).alias("bottom"),
    )
    # An image of one colour has no content: an empty box at its far side.
    inner = inner.withColumns({"left": F.coalesce("left", F.lit(width)), "right": F.coalesce("right", F.lit(width)), "top": F.coalesce("top", F.lit(height)), "bottom": F.coalesce("bottom", F.lit(height))})
    wide = F.col("right") - F.col("left")
    border = (F.col("left") + width - F.col("right")) * height + (F.col("top") + height - F.col("bottom")) * wide
    best = inner.withColumn("border", border).groupBy(image_col).agg(F.max("kinds").alias("kinds"), F.max_by(F.struct("top", "right", "bottom", "left"), F.struct("border", -F.col("rank"))).alias("box"))
    whole = F.struct(F.lit(0).alias("top"), F.lit(width).alias("right"), F.lit(height).alias("bottom"), F.lit(0).alias("left"))
    box = F.when(F.col("kinds") >= 4, whole).otherwise(F.col("box"))
    return best.select(image_col, box.alias("b")).select(image_col, "b.*")


def center_delta(width: int, height: int) -> dict[str, Column]:
    """From the old centre of an image to the centre of its crop."""
    return {
        "dx": F.col("left") + (F.col("right") - F.col("left")) / 2.0 - width / 2.0,
        "dy": F.col("top") + (F.col("bottom") - F.col("top")) / 2.0 - height / 2.0,
    }


def sample_shots(
    surface: DataFrame, shots: DataFrame, project: Callable[[], tuple[Column, Column, Column]], on: list[str], pixels: DataFrame, width: int, height: int, bilinear: tuple[str, ...] = (),
    camera: Camera | None = None, point: tuple[str, str, str] = ("gx", "gy", "gz"), bounds: dict[str, float] | None = None,
) -> DataFrame:
    """Pixels of shots seen at surface points: ``project`` gives u, v and whether
    the point is in front, from columns of both; points outside [0, 1] x [0, 1]
    are discarded, others take the nearest pixel.

    With columns of ``pixels`` named ``bilinear``, a point has a row for each of the
    pixels around it, up to four, and those columns hold that pixel's share: their
    sums over a point's rows are the values between pixel centres.  Beyond the
    outer centres the border repeats.

    ``surface`` and ``shots`` meet on the keys ``on`` (a scene) and, given the shots'
    ``camera`` and the names of a point's coordinates, by the cells of an index of
    footprints: then a shot meets the points of the cells that its frustum reaches,
    which are fewer than three for each that it sees on even ground.  ``bounds`` of the
    surface save a pass over it.  Without a camera all pairs of a key meet.
    """
    u, v, front = project()
    met = surface.join(shots, on) if camera is None else met_by_cell(surface, shots, on, camera, point, bounds)
    seen = met.withColumns({"u__": u, "v__": v, "front__": front}).filter(F.col("front__") & F.col("u__").between(0, 1) & F.col("v__").between(0, 1))
    side = pixels.withColumnRenamed("x", "px").withColumnRenamed("y", "py")
    if not bilinear:
        nearest = lambda t, n: F.least(F.floor(t * n), F.lit(n - 1)).cast("int")
        seen = seen.withColumns({"px": nearest(F.col("u__"), width), "py": nearest(1 - F.col("v__"), height)}).drop("u__", "v__", "front__")
        return seen.join(side, ["shot_id", "px", "py"])

    def around(t: Column, n: int) -> Column:
        """The one or two pixels at ``t`` along an axis, and their weights."""
        at = F.greatest(F.lit(0.0), F.least(t * n - 0.5, F.lit(n - 1.0)))
        low = F.floor(at)
        both = F.array(F.struct(low.cast("int").alias("p"), (1 - (at - low)).alias("w")), F.struct((low + 1).cast("int").alias("p"), (at - low).alias("w")))
        return F.filter(both, lambda s: s["w"] > 0)

    seen = seen.withColumn("x__", F.explode(around(F.col("u__"), width))).withColumn("y__", F.explode(around(1 - F.col("v__"), height)))
    seen = seen.withColumns({"px": F.col("x__.p"), "py": F.col("y__.p"), "w__": F.col("x__.w") * F.col("y__.w")}).drop("u__", "v__", "front__", "x__", "y__")
    out = seen.join(side, ["shot_id", "px", "py"])
    return out.withColumns({c: F.col(c) * F.col("w__") for c in bilinear}).drop("w__")


def laplacian_of_rows(pixels: DataFrame, image: list[str], value: str) -> DataFrame:
    """The inner Laplacian for images too large for one record, by windows over
    rows and columns; border pixels have none."""
    x_win, y_win = Window.partitionBy(*image, "y").orderBy("x"), Window.partitionBy(*image, "x").orderBy("y")
    v = F.col(value)
    around = F.lag(v).over(x_win) + F.lead(v).over(x_win) + F.lag(v).over(y_win) + F.lead(v).over(y_win)
    return pixels.withColumn("laplacian", around - 4 * v)
