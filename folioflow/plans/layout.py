"""A5: page layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import layout as a

from .base import query

# Pages of a document: up to 7, sizes that differ, from arithmetic on keys.
_PAGES = "SELECT doc_id AS doc, CAST(page AS INT) AS page, CAST(600 + doc_id % 3 * 12 + page * 2 AS DOUBLE) AS w, CAST(800 + doc_id % 5 * 7 - page AS DOUBLE) AS h FROM {documents} CROSS JOIN (SELECT r_regionkey AS page FROM {region} UNION ALL SELECT 5 UNION ALL SELECT 6) AS p WHERE page < n_chars % 8"
_HEAD = "+ d AS (SELECT *, first_value(w) OVER (PARTITION BY doc ORDER BY page) AS w0, first_value(h) OVER (PARTITION BY doc ORDER BY page) AS h0, count(*) OVER (PARTITION BY doc) AS n FROM src), s AS (SELECT 'L' AS side, 0 AS k UNION ALL SELECT 'R', 1)"
_CLIP = "CASE side WHEN 'L' THEN 10.0::DOUBLE ELSE w0 / 2 - 2 END AS x0, 20.0::DOUBLE AS y0, CASE side WHEN 'L' THEN w0 / 2 + 2 ELSE w0 - 10 END AS x1, h0 - 20 AS y1"


@query("a5_01_02_single_cut", _PAGES, f"{_HEAD} SELECT doc, page, CAST(2 * page + k AS INT) AS out, side, {_CLIP} FROM d, s")
def single_cut(df: DataFrame) -> DataFrame:
    return a.single_cut(df)


@query("a5_03_dual_cut", _PAGES, f"{_HEAD} SELECT doc, page, CAST(page // 2 * 4 + page % 2 + 2 * k AS INT) AS out, side, {_CLIP} FROM d, s WHERE page < n // 2 * 2")
def dual_cut(df: DataFrame) -> DataFrame:
    return a.dual_cut(df)


@query("a5_04_crop_compare", _PAGES, f"{_HEAD} SELECT doc, page, CAST(page // 2 * 2 + k AS INT) AS out, side, {_CLIP}, CASE WHEN page % 2 = 1 THEN w0 / 2 ELSE 0.0 END AS to_x0, CASE WHEN page % 2 = 1 THEN w0 ELSE w0 / 2 END AS to_x1, h0 - 40 AS to_h FROM d, s WHERE page < n // 2 * 2")
def crop_compare(df: DataFrame) -> DataFrame:
    return a.crop_compare(df)


@query("a5_05_side_by_side", _PAGES, "SELECT x.doc, CAST(x.page // 2 AS INT) AS out, x.w + coalesce(y.w, x.w) AS w, greatest(x.h, coalesce(y.h, x.h)) AS h, y.w IS NULL AS blank_right FROM src x LEFT JOIN src y ON x.doc = y.doc AND y.page = x.page + 1 WHERE x.page % 2 = 0")
def side_by_side(df: DataFrame) -> DataFrame:
    return a.side_by_side(df)


@query("a5_06_halves", _PAGES, f"{_HEAD} SELECT doc, page, CAST(2 * page + k AS INT) AS out, side, CASE k WHEN 0 THEN 0.0 ELSE w0 / 2 END AS x0, 0.0::DOUBLE AS y0, CASE k WHEN 0 THEN w0 / 2 ELSE w0 END AS x1, h0 AS y1 FROM d, s")
def halves(df: DataFrame) -> DataFrame:
    return a.halves(df)


_MODES = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'LR' WHEN 1 THEN 'tb' ELSE 'x' END AS f, CASE o_orderkey % 2 WHEN 0 THEN 'LR' ELSE 'TB' END AS t, CAST(o_orderkey % 7 AS INT) AS pages, CAST(o_orderkey % 5 AS INT) AS skip, o_orderkey % 2 = 0 AS mono, o_orderkey % 3 = 0 AS dual, o_orderkey % 5 = 0 AS mono_cut, o_orderkey % 7 = 0 AS dual_cut, o_orderkey % 11 = 0 AS compare, o_orderkey % 13 = 0 AS crop, o_orderkey % 4 < 2 AS no_mono, o_orderkey % 8 < 4 AS no_dual FROM {orders}"


@query("a5_07_10_11_plans", _MODES, """
+ x AS (SELECT *, no_mono AND NOT (mono_cut OR mono) AS sm, no_dual AND NOT (dual OR dual_cut OR crop OR compare) AS sd FROM src)
SELECT id, CASE WHEN upper(f) NOT IN ('LR','TB') THEN NULL WHEN upper(f) = t THEN 'copy' WHEN upper(f) = 'TB' THEN 'merge' ELSE 'split' END AS conversion, '1-' || CAST(pages - skip AS STRING) AS page_range,
  CASE WHEN NOT (sm AND sd) THEN list_filter([CASE WHEN NOT sm THEN 'mono' END, CASE WHEN NOT sd AND dual THEN 'dual' END, CASE WHEN mono_cut THEN 'mono-cut' END, CASE WHEN dual_cut THEN 'dual-cut' END, CASE WHEN crop THEN 'crop-compare' END, CASE WHEN compare THEN 'compare' END], lambda v: v IS NOT NULL) END AS products,
  CASE WHEN NOT (sm AND sd) AND NOT sd AND t = 'LR' AND (dual_cut OR crop) THEN 'split' END AS step FROM x""")
def plans(df: DataFrame) -> DataFrame:
    c = {k: F.col(k) for k in df.columns}
    plan = a.output_plan(c["mono"], c["dual"], c["mono_cut"], c["dual_cut"], c["compare"], c["crop"], c["no_mono"], c["no_dual"], c["t"])
    return df.select("id", a.conversion(c["f"], c["t"]).alias("conversion"), a.page_range(c["pages"], c["skip"]).alias("page_range"), plan["products"].alias("products"), plan["step"].alias("step"))


@query("a5_08_outside", _PAGES, """
+ c AS (SELECT *, CASE WHEN page % 2 = 0 THEN 10.0::DOUBLE ELSE 0.0 END AS cx0, 20.0::DOUBLE AS cy0, w / 2 AS cx1, CASE WHEN page % 3 = 0 THEN h ELSE h - 20 END AS cy1 FROM src),
 r AS (SELECT doc, page, 0 AS k, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, w AS x1, cy0 AS y1 FROM c WHERE cy0 > 0 UNION ALL SELECT doc, page, 1, 0.0, cy1, w, h FROM c WHERE cy1 < h
   UNION ALL SELECT doc, page, 2, 0.0, cy0, cx0, cy1 FROM c WHERE cx0 > 0 UNION ALL SELECT doc, page, 3, cx1, cy0, w, cy1 FROM c WHERE cx1 < w) SELECT doc, page, x0, y0, x1, y1 FROM r""")
def outside(df: DataFrame) -> DataFrame:
    w, h, page = F.col("w"), F.col("h"), F.col("page")
    clip = a.rect(F.when(page % 2 == 0, 10.0).otherwise(0.0), F.lit(20.0), w / 2, F.when(page % 3 == 0, h).otherwise(h - 20))
    return df.select("doc", "page", F.explode(a.outside(a.rect(F.lit(0.0), F.lit(0.0), w, h), clip)).alias("r")).select("doc", "page", "r.*")


@query("a5_12_legacy_cut", _PAGES, "+ s AS (SELECT 'L' AS side, 0 AS k UNION ALL SELECT 'R', 1) SELECT doc, page, CAST(2 * page + k AS INT) AS out, side, CASE k WHEN 0 THEN w / 20 ELSE w / 2 - w / 20 / 4.7::DOUBLE END AS x0, 0.0::DOUBLE AS y0, CASE k WHEN 0 THEN w / 2 + w / 20 / 4.7::DOUBLE ELSE w - w / 20 END AS x1, h AS y1 FROM src, s")
def legacy_cut(df: DataFrame) -> DataFrame:
    return a.legacy_cut(df)
