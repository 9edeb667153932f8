"""Boxes of recognised text: pixels and shares of the page, polygons, widths of characters, confidence."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters and their share of a full width, the first that fits decides; capitals .70, others .66.
WIDTHS = [(" \t", 0.32), ("ilI'\".,:;!|/\\`", 0.32), ("jrtf-()[]{}1^", 0.40), ("mwMW@%&#", 0.95)]
LOW_CONFIDENCE = 0.60


def _fine(box: Column) -> Column:
    return (F.size(box) == 4) & F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (box[0] <= box[2]) & (box[1] <= box[3])


def to_shares(box: Column, width: Column, height: Column) -> Column:
    """A pixel box [x0, y0, x1, y1] as shares of the page, kept within 0 and 1; null for a senseless box or page."""
    clip = lambda v, n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / n))
    return F.when(_fine(box) & (width > 0) & (height > 0), F.array(clip(box[0], width), clip(box[1], height), clip(box[2], width), clip(box[3], height)))


def to_pixels(box: Column, width: Column, height: Column) -> Column:
    """Shares of the page as whole pixels, halves to the even one; null for a senseless box or page or one off the page."""
    inside = F.forall(box, lambda v: (v >= 0) & (v <= 1))
    return F.when(_fine(box) & inside & (width > 0) & (height > 0), F.array(*[F.bround(box[i] * n).cast("int") for i, n in enumerate((width, height, width, height))]))


def around(polygon: Column) -> Column:
    """The whole-pixel box around an array of points [x, y]; null without points or for a point of one coordinate."""
    at = lambda i: F.transform(polygon, lambda p: p[i])
    ok = (F.size(polygon) > 0) & F.forall(polygon, lambda p: F.size(p) >= 2)
    return F.when(ok, F.array(*[f(at(i)).cast("int") for f, i in ((F.array_min, 0), (F.array_min, 1), (F.array_max, 0), (F.array_max, 1))]))


def char_width(c: Column) -> Column:
    out = F.when(c.rlike(r"\A\p{Lu}"), 0.70).otherwise(0.66)
    for chars, width in reversed(WIDTHS):
        out = F.when(F.contains(F.lit(chars), c) & (c != ""), width).otherwise(out)
    return out


def text_width(text: Column) -> Column:
    """The widths of a text's characters, added up."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0.0), lambda a, c: a + char_width(c))


def span_box(text: Column, start: Column, end: Column, box: Column) -> Column:
    """The part of a line's pixel box under [start, end), by the widths of the characters."""
    whole = F.greatest(text_width(text), F.lit(1e-9))
    at = lambda n: box[0] + (box[2] - box[0]) * text_width(F.substring(text, F.lit(1), n)) / whole
    return F.array(at(start), box[1], at(end), box[3])


def padded(box: Column, width: Column, height: Column, padding: float = 5.0) -> Column:
    """A pixel box with a margin that grows with pages over 1020 by 1320, kept on the page."""
    px, py = padding * F.greatest(F.lit(1.0), width / 1020.0), padding * F.greatest(F.lit(1.0), height / 1320.0)
    return F.array(F.greatest(F.lit(0.0), box[0] - px), F.greatest(F.lit(0.0), box[1] - py), F.least(width.cast("double"), box[2] + px), F.least(height.cast("double"), box[3] + py))


def joined(boxes: Column, gap: float = 18.0) -> Column:
    """The boxes of a line from left to right, those less than `gap` pixels apart as one."""
    ranked = F.array_sort(boxes)
    first = F.array().cast("array<array<double>>")
    near = lambda a, b: (F.size(a) > 0) & (b[0] - F.element_at(F.element_at(a, -1), 3) < gap)
    both = lambda a, b: F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))
    step = lambda a, b: F.when(near(a, b), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(both(F.try_element_at(a, F.lit(-1)), b)))).otherwise(F.concat(a, F.array(b)))
    return F.aggregate(ranked, first, step)


def confidence(score: Column) -> Column:
    """A score within 0 and 1; null, NaN and what is no number count as 0."""
    x = F.coalesce(F.nanvl(score.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def page_confidence(text: Column, score: Column) -> Column:
    """struct(confidence, low): a page without text has 0 and is low, as is one at the threshold."""
    blank = ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))
    c = F.when(blank, 0.0).otherwise(confidence(score))
    return F.struct(c.alias("confidence"), (c <= LOW_CONFIDENCE).alias("low"))


def word_confidence(scores: Column) -> Column:
    """struct(confidence, low, n_low) of an array of words' scores; no words: 0, low."""
    each = F.transform(scores, confidence)
    n = F.size(F.filter(each, lambda c: c <= LOW_CONFIDENCE))
    mean = F.aggregate(each, F.lit(0.0), lambda a, c: a + c) / F.size(each)
    some = F.size(F.coalesce(each, F.array().cast("array<double>"))) > 0
    return F.struct(F.when(some, mean).otherwise(0.0).alias("confidence"), F.when(some, n > 0).otherwise(True).alias("low"), F.when(some, n).otherwise(0).alias("n_low"))
