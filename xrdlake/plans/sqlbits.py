"""SQL fragments for the reference statements (the views, stated independently)."""

PTS = """
pts AS (
  SELECT vec_id AS curve_id, vec_id // 3 AS sample_base,
         CASE vec_id % 3 WHEN 0 THEN 'natural' WHEN 1 THEN 'glicolado' ELSE 'calcinado' END AS preparation,
         CAST(pos - 1 AS INTEGER) AS idx,
         3.0e0 + 0.4e0 * CAST(pos - 1 AS DOUBLE) AS tt,
         greatest(0e0, (CAST(v AS DOUBLE) + 0.6e0) * 1000e0) AS y
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings))
"""


def bragg_d(tt: str) -> str:
    return f"(CASE WHEN sin(radians(({tt}) / 2)) > 0 THEN 1.5406e0 / (2 * sin(radians(({tt}) / 2))) END)"


def bragg_tt(d: str) -> str:
    return (f"(CASE WHEN ({d}) > 0 AND 1.5406e0 / (2 * ({d})) <= 1 "
            f"THEN degrees(2 * asin(1.5406e0 / (2 * ({d})))) END)")


# smoothed (5-point quadratic kernel), minus 10th percentile, scaled to the maximum
PROCESSED = PTS + """,
sm AS (
  SELECT *, CASE WHEN idx >= 2 AND idx <= n - 3
       THEN greatest(0e0, (-3e0 * a + 12e0 * b + 17e0 * y + 12e0 * c - 3e0 * e) / 35e0)
       ELSE ma END AS ys
  FROM (SELECT *, count(*) OVER (PARTITION BY curve_id) AS n,
          lag(y, 2) OVER w AS a, lag(y, 1) OVER w AS b, lead(y, 1) OVER w AS c, lead(y, 2) OVER w AS e,
          avg(y) OVER (PARTITION BY curve_id ORDER BY tt ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ma
        FROM pts WINDOW w AS (PARTITION BY curve_id ORDER BY tt))),
cor AS (
  SELECT s.*, greatest(0e0, ys - q) AS yc
  FROM sm s JOIN (SELECT curve_id, quantile_cont(ys, 0.1) AS q FROM sm GROUP BY 1) USING (curve_id)),
nrm AS (
  SELECT *, CASE WHEN mx > 0 THEN yc / mx ELSE 0e0 END AS yn
  FROM (SELECT *, max(yc) OVER (PARTITION BY curve_id) AS mx FROM cor))
"""

# local maxima of the scaled curve, strongest first
MAXIMA = PROCESSED + """,
mxm AS (
  SELECT curve_id, sample_base, preparation, idx, tt, yc, yn
  FROM (SELECT *, lag(yn) OVER w AS lf, lead(yn) OVER w AS rt FROM nrm
        WINDOW w AS (PARTITION BY curve_id ORDER BY tt))
  WHERE lf IS NOT NULL AND rt IS NOT NULL AND tt >= 4 AND yn >= 0.02 AND yn >= lf AND yn >= rt)
"""

PEAKS = MAXIMA + f""",
pk AS (
  SELECT curve_id, sample_base, preparation, idx,
         row_number() OVER (PARTITION BY curve_id ORDER BY yn DESC, tt) AS peak_index,
         tt AS two_theta, {bragg_d('tt')} AS d, yc AS intensity, 100 * yn AS relative_intensity
  FROM mxm)
"""

CANDS = """
cand AS (
  SELECT l_orderkey AS curve_id, l_linenumber AS line_no, l_partkey AS part_id, p_brand AS mineral, p_type AS grp,
         p_name AS label, round(l_discount * 10, 4) AS score, l_quantity AS lines,
         CASE l_returnflag WHEN 'N' THEN 'natural' WHEN 'R' THEN 'glicolado' ELSE 'calcinado' END AS treatment
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""

GEO = """
geo AS (
  SELECT l_orderkey AS record_id, l_linenumber AS row_no, p_brand AS mineral, p_type AS grp,
         o_orderpriority AS rock, o_orderstatus AS era, l_linestatus AS environment,
         l_quantity AS SiO2, l_discount AS Al2O3, l_tax AS Fe2O3, l_extendedprice AS MgO
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
"""
