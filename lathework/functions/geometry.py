"""Box geometry as column expressions; boxes are structs or four columns x1, y1, x2, y2."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Mapping[str, Column] | Column


def _side(box: Box, name: str) -> Column:
    return box[name]


def area(box: Box) -> Column:
    """Width by height, sides clamped at zero."""
    zero = F.lit(0.0)
    return F.greatest(_side(box, "x2") - _side(box, "x1"), zero) * F.greatest(_side(box, "y2") - _side(box, "y1"), zero)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    zero = F.lit(0.0)
    width = F.least(_side(a, "x2"), _side(b, "x2")) - F.greatest(_side(a, "x1"), _side(b, "x1"))
    height = F.least(_side(a, "y2"), _side(b, "y2")) - F.greatest(_side(a, "y1"), _side(b, "y1"))
    inter = F.greatest(width, zero) * F.greatest(height, zero)
    return F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), zero)


def xyxy(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    """Corners of a box given by its centre and size."""
    return {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}


def cxcywh(box: Box) -> dict[str, Column]:
    x1, y1, x2, y2 = (_side(box, n) for n in ("x1", "y1", "x2", "y2"))
    return {"cx": (x1 + x2) / 2, "cy": (y1 + y2) / 2, "w": x2 - x1, "h": y2 - y1}


def letterbox(width: Column, height: Column, size: int = 640, half_even: bool = True) -> dict[str, Column]:
    """Ratio, resized sides and pads of an image fitted into a square.

    Halves round to even, or away from zero with ``half_even=False``; pads are split with a
    tenth of a pixel to the left and top, so an odd rest goes to the right and bottom.
    """
    rounded = (lambda c: F.rint(c)) if half_even else (lambda c: F.round(c))
    ratio = F.least(F.lit(float(size)) / height, F.lit(float(size)) / width)
    new_w, new_h = rounded(width * ratio), rounded(height * ratio)
    dw, dh = (F.lit(float(size)) - new_w) / 2, (F.lit(float(size)) - new_h) / 2
    return {
        "ratio": ratio,
        "resized_w": new_w.cast("int"),
        "resized_h": new_h.cast("int"),
        "left": rounded(dw - 0.1).cast("int"),
        "top": rounded(dh - 0.1).cast("int"),
        "right": rounded(dw + 0.1).cast("int"),
        "bottom": rounded(dh + 0.1).cast("int"),
    }


def unletterbox(box: Box, fit: Mapping[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """A box of the square back in the image, then clamped to it."""
    out = {}
    for name, pad, most in (("x1", "left", width), ("y1", "top", height), ("x2", "left", width), ("y2", "top", height)):
        plain = (_side(box, name) - fit[pad]) / fit["ratio"]
        out[name] = F.greatest(F.lit(0.0), F.least(plain, most.cast("double")))
    return out


def size_by_pixels(pixels: Column) -> Column:
    """Three bins of a box's area in pixels of a 640 square."""
    return F.when(pixels < 32.0**2, "small").when(pixels < 96.0**2, "medium").otherwise("large")


def size_by_ratio(ratio: Column) -> Column:
    """Four half-open bins of a box's share of its image."""
    return (
        F.when(ratio < 0.0025, "tiny").when(ratio < 0.01, "small").when(ratio < 0.04, "medium").otherwise("large")
    )


def center_inside(child: Box, parent: Box) -> Column:
    """Whether the child's centre lies in the parent, edges included."""
    at = cxcywh(child)
    return at["cx"].between(parent["x1"], parent["x2"]) & at["cy"].between(parent["y1"], parent["y2"])


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def decode(scores: Column, cx: Column, cy: Column, w: Column, h: Column, fit, width: Column, height: Column, threshold: float, skip_nan: bool = True) -> dict[str, Column]:
    """Class, confidence and clamped box of a raw candidate, and whether it is kept.

    The best class is the first of equal ones. With ``skip_nan`` a NaN score of a later class
    is passed over and one of the first class rejects; else any NaN rejects.
    """
    usable = F.transform(scores, lambda s, i: F.when((i > 0) & F.isnan(s), F.lit(float("-inf"))).otherwise(s)) if skip_nan else scores
    best = F.array_max(usable)
    corners = xyxy(cx, cy, w, h)
    box = unletterbox(corners, fit, width, height)
    kept = (
        finite(best) & (best >= threshold) & finite(cx) & finite(cy) & finite(w) & finite(h) & (w > 0) & (h > 0)
        & (box["x2"] > box["x1"]) & (box["y2"] > box["y1"])
    )
    if skip_nan:
        kept = kept & ~F.isnan(F.get(scores, F.lit(0)))
    return {"class_id": (F.array_position(usable, best) - 1).cast("int"), "confidence": best, **box, "kept": F.coalesce(kept, F.lit(False))}
