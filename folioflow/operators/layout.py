"""Page-layout algebra: where each clip of a source page goes, as rows.

Pages are rows (doc, page from 0, w, h). Clips come from a document's page 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(c.cast("double").alias(k) for c, k in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))


def with_first(pages: DataFrame) -> DataFrame:
    """Add page 0's size (w0, h0) and the number of pages (n)."""
    head = pages.groupBy("doc").agg(F.min_by("w", "page").alias("w0"), F.min_by("h", "page").alias("h0"), F.count("*").alias("n"))
    return pages.join(head, "doc")


def clips(w: Column, h: Column, dx: float, dy: float, ratio: float) -> tuple[Column, Column]:
    """The left and the right column with overlap dx / ratio and margins."""
    zero, gap = F.lit(float(dy)), F.lit(dx / ratio)
    return rect(F.lit(float(dx)), zero, w / 2 + gap, h - dy), rect(w / 2 - gap, zero, w - dx, h - dy)


def _placed(rows: DataFrame, places: list[tuple[Column, str, Column]]) -> DataFrame:
    """Explode (output page, side, clip) of each row."""
    each = F.array(*(F.struct(out.cast("int").alias("out"), F.lit(side).alias("side"), clip.alias("clip")) for out, side, clip in places))
    return rows.select("doc", "page", F.explode(each).alias("p")).select("doc", "page", "p.out", "p.side", "p.clip.*")


def single_cut(pages: DataFrame, dx: float = 10, dy: float = 20, ratio: float = 5) -> DataFrame:
    rows = with_first(pages)
    left, right = clips(F.col("w0"), F.col("h0"), dx, dy, ratio)
    return _placed(rows, [(2 * F.col("page"), "L", left), (2 * F.col("page") + 1, "R", right)])


def dual_cut(pages: DataFrame, dx: float = 10, dy: float = 20, ratio: float = 5) -> DataFrame:
    """Pairs of pages give both left columns, then both right ones; an odd last page goes."""
    rows = with_first(pages).where(F.col("page") < F.floor(F.col("n") / 2) * 2)
    left, right = clips(F.col("w0"), F.col("h0"), dx, dy, ratio)
    base = F.floor(F.col("page") / 2) * 4 + F.col("page") % 2
    return _placed(rows, [(base, "L", left), (base + 2, "R", right)])


def crop_compare(pages: DataFrame, dx: float = 10, dy: float = 20, ratio: float = 5) -> DataFrame:
    """Pairs give one wide page of left columns and one of right columns; an odd last page goes."""
    rows = with_first(pages).where(F.col("page") < F.floor(F.col("n") / 2) * 2)
    left, right = clips(F.col("w0"), F.col("h0"), dx, dy, ratio)
    base = F.floor(F.col("page") / 2) * 2
    out = _placed(rows, [(base, "L", left), (base + 1, "R", right)]).join(rows.select("doc", "page", "w0"), ["doc", "page"])
    second = F.col("page") % 2 == 1
    return out.select("doc", "page", "out", "side", "x0", "y0", "x1", "y1", F.when(second, F.col("w0") / 2).otherwise(0.0).alias("to_x0"), F.when(second, F.col("w0")).otherwise(F.col("w0") / 2).alias("to_x1"), (F.col("y1") - F.col("y0")).alias("to_h"))


def side_by_side(pages: DataFrame) -> DataFrame:
    """Merge pairs into one page: widths add, the larger height holds; an odd last page stands beside blank space."""
    after = pages.select("doc", (F.col("page") - 1).alias("page"), F.col("w").alias("w2"), F.col("h").alias("h2"))
    pairs = pages.where("page % 2 = 0").join(after, ["doc", "page"], "left")
    return pairs.select("doc", F.floor(F.col("page") / 2).cast("int").alias("out"), (F.col("w") + F.coalesce("w2", "w")).alias("w"), F.greatest("h", F.coalesce("h2", "h")).alias("h"), F.col("w2").isNull().alias("blank_right"))


def halves(pages: DataFrame) -> DataFrame:
    """Split each page at half the width of page 0 into two."""
    rows = with_first(pages)
    zero, mid = F.lit(0.0), F.col("w0") / 2
    return _placed(rows, [(2 * F.col("page"), "L", rect(zero, zero, mid, F.col("h0"))), (2 * F.col("page") + 1, "R", rect(mid, zero, F.col("w0"), F.col("h0")))])


def conversion(source: Column, target: Column) -> Column:
    """What turns one layout into another; null for an unknown pair."""
    a, b = F.upper(source), F.upper(target)
    known = a.isin("LR", "TB") & b.isin("LR", "TB")
    return F.when(known & (a == b), "copy").when(known & (a == "TB"), "merge").when(known, "split")


def outside(page: Column, clip: Column) -> Column:
    """Up to four rectangles of a page that lie outside a clip: above, below, left, right."""
    p, c = page, clip
    full = F.array(
        F.when(c["y0"] > p["y0"], rect(p["x0"], p["y0"], p["x1"], c["y0"])), F.when(c["y1"] < p["y1"], rect(p["x0"], c["y1"], p["x1"], p["y1"])),
        F.when(c["x0"] > p["x0"], rect(p["x0"], c["y0"], c["x0"], c["y1"])), F.when(c["x1"] < p["x1"], rect(c["x1"], c["y0"], p["x1"], c["y1"])),
    )
    return F.filter(full, lambda r: r.isNotNull())


def page_range(pages: Column, skip: Column) -> Column:
    """First to last page without the last ``skip``; no lower bound."""
    return F.concat(F.lit("1-"), (pages - skip).cast("string"))


def output_plan(mono: Column, dual: Column, mono_cut: Column, dual_cut: Column, compare: Column, crop: Column, no_mono: Column, no_dual: Column, layout: Column) -> Column:
    """Products of a request in order; a wanted product overrides what would leave it out. Null if nothing is made."""
    skip_mono = no_mono & ~(mono_cut | mono)
    skip_dual = no_dual & ~(dual | dual_cut | crop | compare)
    made = [(~skip_mono, "mono"), (~skip_dual & dual, "dual"), (mono_cut, "mono-cut"), (dual_cut, "dual-cut"), (crop, "crop-compare"), (compare, "compare")]
    items = F.filter(F.array(*(F.when(c, name) for c, name in made)), lambda x: x.isNotNull())
    step = F.when(~skip_dual & (layout == "LR") & (dual_cut | crop), "split")
    return F.when(~(skip_mono & skip_dual), F.struct(items.alias("products"), step.alias("step")))


def legacy_clips(w: Column, h: Column, ratio: float = 4.7) -> tuple[Column, Column]:
    """Each page by its own size: a twentieth of the width as margin, no vertical margin."""
    dx = w / 20
    return rect(dx, F.lit(0.0), w / 2 + dx / ratio, h), rect(w / 2 - dx / ratio, F.lit(0.0), w - dx, h)


def legacy_cut(pages: DataFrame) -> DataFrame:
    left, right = legacy_clips(F.col("w"), F.col("h"))
    return _placed(pages, [(2 * F.col("page"), "L", left), (2 * F.col("page") + 1, "R", right)])
