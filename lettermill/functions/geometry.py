"""Layouts, sizes and corner scores over tables of measures."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(bundles: DataFrame) -> DataFrame:
    """First page of each part of a bundle."""
    w = Window.partitionBy("bundle_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return bundles.withColumn("first_page", F.coalesce(F.sum("n_pages").over(w), F.lit(0)))


def strip(bundles: DataFrame, gap: int, align: str = "center") -> DataFrame:
    """Horizontal strip: all parts scaled to the least height; place of each and canvas size."""
    own = Window.partitionBy("bundle_id")
    before = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    b = bundles.withColumn("h", F.min("height").over(own))
    b = b.withColumn("w", F.greatest(F.lit(1), F.floor(F.col("width") * F.col("h") / F.col("height"))).cast("long"))
    x = F.coalesce(F.sum(F.col("w") + gap).over(before), F.lit(0))
    tall = F.max("h").over(own)
    y = {"start": F.lit(0), "end": tall - F.col("h")}.get(align, F.floor((tall - F.col("h")) / 2)).cast("long")
    return b.withColumns({"x": x, "y": y, "canvas_w": F.sum("w").over(own) + (F.count("*").over(own) - 1) * gap, "canvas_h": tall})


def grid(bundles: DataFrame, gap: int, columns: int = 0) -> DataFrame:
    """Cells of the largest width and height in about as many columns as rows; parts are centred."""
    own = Window.partitionBy("bundle_id")
    b = bundles.withColumns({"n": F.count("*").over(own), "cell_w": F.max("width").over(own), "cell_h": F.max("height").over(own), "i": F.row_number().over(own.orderBy("pos")) - 1})
    b = b.withColumn("cols", F.lit(columns).cast("long") if columns > 0 else F.greatest(F.lit(1), F.bround(F.sqrt("n")).cast("long")))
    row, col = F.floor(F.col("i") / F.col("cols")), F.col("i") % F.col("cols")
    x = col * (F.col("cell_w") + gap) + F.floor((F.col("cell_w") - F.col("width")) / 2)
    y = row * (F.col("cell_h") + gap) + F.floor((F.col("cell_h") - F.col("height")) / 2)
    return b.withColumns({"x": x.cast("long"), "y": y.cast("long")})


def resized(w: Column, h: Column, to_w: int, to_h: int, mode: str) -> tuple[Column, Column]:
    """fit, cover, or stretch into a box; `edge`: the longer edge becomes to_w, never larger than before."""
    if mode == "stretch":
        return F.lit(to_w), F.lit(to_h)
    if mode == "edge":
        r = F.least(F.lit(1.0), to_w / F.greatest(w, h))
    else:
        r = (F.least if mode == "fit" else F.greatest)(to_w / w, to_h / h)
    return tuple(F.greatest(F.lit(1), F.floor(c * r).cast("int")) for c in (w, h))


def skew(segments: DataFrame) -> DataFrame:
    """Median angle of each item's long flat segments; 0 below 0.3 degrees or with fewer than 3."""
    angle = F.degrees(F.atan2("dy", "dx"))
    own = segments.withColumn("angle", angle).filter((F.abs("dx") >= 5) & (F.abs("angle") < 45))
    got = own.groupBy("item_id").agg(F.median("angle").alias("m"), F.count("*").alias("n"))
    out = segments.select("item_id").distinct().join(got, "item_id", "left")
    use = (F.col("n") >= 3) & (F.abs("m") >= 0.3)
    return out.select("item_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(use, F.col("m")).otherwise(0.0).alias("angle"))


def _distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def corners(quads: DataFrame, width: int = 800, height: int = 600) -> DataFrame:
    """Orders four points (x0..y3) into tl, tr, br, bl and adds area share, least rectangle, sides and side ratios."""
    pts = F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in range(4)])
    by = lambda key, last: F.element_at(F.array_sort(F.transform(pts, lambda p: F.struct(key(p).alias("k"), p.alias("p")))), -1 if last else 1)["p"]
    total, tilt = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    area = F.abs(sum((F.col(f"x{i}") * F.col(f"y{(i + 1) % 4}") - F.col(f"x{(i + 1) % 4}") * F.col(f"y{i}") for i in range(4)), F.lit(0.0))) / 2
    q = quads.withColumns({"tl": by(total, False), "br": by(total, True), "tr": by(tilt, False), "bl": by(tilt, True), "area": area, "box": least_rectangle()})
    tl, tr, br, bl = (F.col(c) for c in ("tl", "tr", "br", "bl"))
    q = q.withColumns({"share": F.col("area") / (width * height), "top": _distance(tr, tl), "bottom": _distance(br, bl), "left": _distance(bl, tl), "right": _distance(br, tr)})
    ratio = lambda a, b: F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(1.0)
    return q.withColumns({"w_ratio": ratio(F.col("top"), F.col("bottom")), "h_ratio": ratio(F.col("left"), F.col("right"))})


def valid(width: int = 800, height: int = 600) -> Column:
    """Area from 5 to 80 %, fewer than 3 sides at the border, no side far shorter than another."""
    m = max(width, height) * 0.03
    c = lambda p, k: F.col(p)[k]
    touching = sum(
        (a & b).cast("int") for a, b in (
            (c("tl", "y") < m, c("tr", "y") < m), (c("bl", "y") > height - m, c("br", "y") > height - m),
            (c("tl", "x") < m, c("bl", "x") < m), (c("tr", "x") > width - m, c("br", "x") > width - m),
        )
    )
    sides = [F.col(s) for s in ("top", "bottom", "left", "right")]
    return F.col("share").between(0.05, 0.80) & (touching < 3) & (F.least(*sides) >= F.greatest(*sides) * 0.15) & (F.col("w_ratio") >= 0.2) & (F.col("h_ratio") >= 0.2)


def least_rectangle() -> Column:
    """Area of the least rectangle, turned any way, around the four points (x0..y3); 0 if they lie on one line.

    One of its sides runs along a side of their hull. All six lines through two
    of the points are tried: those inside the hull give no smaller one.
    """
    areas = []
    for i in range(4):
        for j in range(i + 1, 4):
            dx, dy = F.col(f"x{j}") - F.col(f"x{i}"), F.col(f"y{j}") - F.col(f"y{i}")
            along = [F.col(f"x{k}") * dx + F.col(f"y{k}") * dy for k in range(4)]
            across = [F.col(f"y{k}") * dx - F.col(f"x{k}") * dy for k in range(4)]
            square = dx * dx + dy * dy
            areas.append((F.greatest(*along) - F.least(*along)) * (F.greatest(*across) - F.least(*across)) / F.when(square > 0, square))
    return F.coalesce(F.least(*areas), F.lit(0.0))


def score(width: int = 800, height: int = 600) -> Column:
    """Weights area, rectangularity (against the least rectangle), distance from the border and paper proportions."""
    s = F.col("share")
    area = (
        F.when((s < 0.05) | (s >= 0.80), 0.0).when(s < 0.10, (s - 0.05) / 0.05 * 0.5)
        .when(s < 0.60, 0.5 + 0.5 * (1 - F.abs(s - 0.30) / 0.30)).otherwise(0.5 * (1 - (s - 0.60) / 0.20))
    )
    box = F.col("box")
    rect = F.least(F.col("area") / F.when(box > 0, box).otherwise(1.0), F.lit(1.0))
    p = lambda c, k: F.col(c)[k]
    near = F.least(p("tl", "x"), p("tl", "y"), width - p("tr", "x"), p("tr", "y"), width - p("br", "x"), height - p("br", "y"), p("bl", "x"), height - p("bl", "y"))
    border = F.least(near / (max(width, height) * 0.05), F.lit(1.0))
    w, h = (F.col("top") + F.col("bottom")) / 2, (F.col("left") + F.col("right")) / 2
    aspect = F.when(F.greatest(w, h) > 0, F.least(w, h) / F.greatest(w, h)).otherwise(0.0)
    paper = F.greatest(F.lit(0.0), 1 - F.abs(aspect - 0.72) * 2.5)
    return area * 0.30 + rect * 0.30 + border * 0.25 + paper * 0.15


def best(quads: DataFrame, least: float = 0.15) -> DataFrame:
    """Per item the candidate of the highest score, the first of equals; none below `least`."""
    got = quads.groupBy("item_id").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"))).alias("b"))
    return got.filter(F.col("b.score") >= least).select("item_id", (-F.col("b.o")).alias("ord"), F.col("b.score").alias("score"))


def distortion() -> dict[str, Column]:
    """Level, tilt in degrees, and output size of an ordered quad."""
    least = F.least("w_ratio", "h_ratio")
    diff = 1 - least
    level = F.when(diff < 0.1, "low").when(diff < 0.3, "medium").when(diff < 0.5, "high").otherwise("extreme")
    side = lambda a, b: F.greatest(F.lit(100), F.when(diff > 0.15, F.greatest(a, b) * 0.85 + F.least(a, b) * 0.15).otherwise(F.greatest(a, b)).cast("int"))
    w, h = side("top", "bottom"), side("left", "right")
    shrink = F.when(F.greatest(w, h) > 4500, 4500 / F.greatest(w, h)).otherwise(1.0)
    return {"level": level, "tilt": F.degrees(F.acos(F.greatest(least, F.lit(0.01)))), "out_w": (w * shrink).cast("int"), "out_h": (h * shrink).cast("int")}
