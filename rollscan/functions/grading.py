"""Column expressions of grading: four-point bands, density, verdict, confidence, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grading standard: band tops in mm and their points, the length from which a defect is continuous,
# points per 100 square yards for points per square metre.
BANDS = ((75.0, 1), (150.0, 2), (230.0, 3))
CONTINUOUS_MM = 230.0
PER_100_YD2 = 83.61


def refuse(condition: Column, message: str, value: Column) -> Column:
    """value, or an error where the condition holds."""
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)


def counts_toward_score(status: Column, assertion: Column) -> Column:
    """Rejected events do not count, confirmed ones do, others where they are asserted."""
    return F.when(status == "rejected", False).when(status == "confirmed", True).otherwise(assertion == "asserted")


def points_by_band(length_mm: Column) -> Column:
    """Points of a length by its band (tops included)."""
    out = F.when(length_mm <= BANDS[0][0], F.lit(BANDS[0][1]))
    for top, points in BANDS[1:]:
        out = out.when(length_mm <= top, F.lit(points))
    return refuse(length_mm < 0, "a length is negative", out.otherwise(F.lit(4)))


def metres_of(length_mm: Column) -> Column:
    """Metres that a continuous defect is counted over."""
    return F.greatest(F.lit(1), F.ceil(length_mm / F.lit(1000.0))).cast("int")


def is_continuous(length_mm: Column) -> Column:
    return length_mm >= CONTINUOUS_MM


def points_of_event(length_mm: Column) -> Column:
    """4 points a metre from CONTINUOUS_MM on, else the band's. 230 mm is 3 by band and 4 here."""
    return F.when(is_continuous(length_mm), 4 * metres_of(length_mm)).otherwise(points_by_band(length_mm))


def density(points: Column, length_m: Column, width_m: Column) -> Column:
    """Points per 100 square yards."""
    return refuse((length_m * width_m) <= 0, "the inspected area is not positive", points * F.lit(PER_100_YD2) / (length_m * width_m))


def verdict(per_100_yd2: Column, hold_at: float = 20.0, reject_at: float = 40.0) -> Column:
    """P12."""
    return F.when(per_100_yd2 >= reject_at, "reject").when(per_100_yd2 >= hold_at, "hold").otherwise("pass")


def classify(score: Column, threshold: Column, abstain_low: Column) -> Column:
    """Asserted, uncertain, or null below abstain_low."""
    return F.when(score >= threshold, "asserted").when(score >= abstain_low, "uncertain")


def confidence(score: Column, threshold: Column, abstain_low: Column) -> Column:
    """0 at abstain_low, 0.5 at the threshold, then towards 1; a band of no width is a step."""
    band = threshold - abstain_low
    step = F.when(score >= threshold, F.lit(1.0)).otherwise(F.lit(0.0))
    rising = 0.5 * (score - abstain_low) / band
    above = 0.5 + 0.5 * (1 - F.exp(-(score - threshold) / band))
    return F.when(band <= 0, step).when(score <= abstain_low, F.lit(0.0)).when(score < threshold, rising).otherwise(above)


def achievable_fa_per_100m(n_tiles: Column, metres_per_tile: Column) -> Column:
    """The finest false-alarm rate that n clean tiles resolve; infinite without tiles or metres."""
    return F.when((n_tiles <= 0) | (metres_per_tile <= 0), F.lit(float("inf"))).otherwise(F.lit(100.0) / metres_per_tile / n_tiles)


def tiles_needed(budget: Column, metres_per_tile: Column, margin: int = 10) -> Column:
    """Clean tiles that a stable threshold for the budget needs."""
    return F.ceil(F.lit(float(margin)) / (budget * metres_per_tile / F.lit(100.0))).cast("long")


def resolution_mm(tile_px: Column, grid: Column, pool: Column, sigma: Column, mm_per_px: Column) -> Column:
    """The extent below which sizes mean nothing."""
    return (tile_px / grid * pool + 2 * sigma) * mm_per_px


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """P19."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of boxes (along0, along1, across0, across1); 0 where both are empty."""
    inter = interval_overlap(a[0], a[1], b[0], b[1]) * interval_overlap(a[2], a[3], b[2], b[3])
    union = (a[1] - a[0]) * (a[3] - a[2]) + (b[1] - b[0]) * (b[3] - b[2]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def continues(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column], iou_threshold: float = 0.3, join_mm: float = 50.0) -> Column:
    """P20: the same lane goes on: across overlap over the narrower width, and a gap along the roll of join_mm at most (less than nothing where they meet)."""
    narrow = F.least(a[3] - a[2], b[3] - b[2])
    lane = F.when(narrow > 0, interval_overlap(a[2], a[3], b[2], b[3]) / narrow)
    gap = F.greatest(a[0], b[0]) - F.least(a[1], b[1])
    return F.coalesce(lane >= iou_threshold, F.lit(False)) & (gap <= join_mm)


def machine_length(width_px: Column, height_px: Column, width_mm: Column, length_mm: Column) -> Column:
    """Of scanned strips the longer image axis runs along the roll."""
    return F.when(width_px >= height_px, width_mm).otherwise(length_mm)


def evidence_box(x: Column, y: Column, w: Column, h: Column, pad: int, frame_w: Column, frame_h: Column) -> Column:
    """A box padded and clipped to its frame; an empty one is an error."""
    x0, y0 = F.greatest(F.lit(0), x - pad), F.greatest(F.lit(0), y - pad)
    x1, y1 = F.least(frame_w, x + w + pad), F.least(frame_h, y + h + pad)
    return refuse((x1 <= x0) | (y1 <= y0), "the evidence box is empty", F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def marker_area(points: Column) -> Column:
    """Area of a defect's mark on the map, 28 to 260, full at 8 points."""
    return F.least(F.lit(260.0), F.greatest(F.lit(28.0), F.lit(260.0) * points / F.lit(8.0)))
