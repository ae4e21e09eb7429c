"""Boxes as arrays of four numbers (left, top, right, bottom), in points from the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_OVERLAP = 0.75


def _four(box: Column) -> list[Column]:
    return [F.get(box, F.lit(i)).cast("double") for i in range(4)]


def _known(box: Column) -> Column:
    return F.coalesce(F.size(box) == 4, F.lit(False)) & ~F.exists(F.coalesce(box, F.array().cast("array<double>")), lambda v: v.isNull())


def is_span_box(box: Column) -> Column:
    """Four numbers, not negative, of positive size: no upper bound."""
    x0, y0, x1, y1 = _four(box)
    return _known(box) & F.coalesce((x0 >= 0) & (x0 < x1) & (y0 >= 0) & (y0 < y1), F.lit(False))


def is_page_box(box: Column, width: Column, height: Column) -> Column:
    """As is_span_box, and within the page."""
    _, _, x1, y1 = _four(box)
    return is_span_box(box) & F.coalesce((x1 <= width) & (y1 <= height), F.lit(False))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    ax0, ay0, ax1, ay1 = _four(a)
    bx0, by0, bx1, by1 = _four(b)
    inter = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def scaled_box(box: Column, width: Column, height: Column) -> Column:
    """A box in thousandths of the page to points; null unless it is one."""
    x0, y0, x1, y1 = _four(box)
    ok = is_span_box(box) & (x1 <= 1000) & (y1 <= 1000)
    return F.when(ok, F.array(x0 * width / 1000, y0 * height / 1000, x1 * width / 1000, y1 * height / 1000))


def can_crop(kind: Column, box: Column, width: Column, height: Column) -> Column:
    """Figures and tables whose box meets the page in a point each way at least."""
    x0, y0, x1, y1 = _four(box)
    wide = F.least(x1, width) - F.greatest(x0, F.lit(0.0))
    high = F.least(y1, height) - F.greatest(y0, F.lit(0.0))
    return kind.isin("figure", "table") & _known(box) & F.coalesce((wide >= 1) & (high >= 1), F.lit(False))
