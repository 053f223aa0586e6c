"""Treatment rules over the samples of the curve view."""

from __future__ import annotations

from pyspark.sql import functions as F

from xrdlake.functions import series as S
from xrdlake.functions.geometry import bragg_d as bragg
from xrdlake.operators import curves as C, matching as M, ngc as N, rule_tables as R
from xrdlake.plans.match import found, peaks, r
from xrdlake.plans.registry import query
from xrdlake.plans.sqlbits import MAXIMA, PEAKS, PTS, bragg_d, bragg_tt
from xrdlake.plans.views import curves, table

c = F.col


def trios(spark, d):
    return N.trios(N.window_map(found(spark, d)))


def interval_trios(spark, d):
    return N.trios(N.window_map(found(spark, d), windows=N.INTERVAL_WINDOWS, widths=False))


def context(spark, d):
    """Laboratory context per sample: d060 and flags, from parts."""
    k = c("p_partkey")
    return table(spark, d, "part").select(
        k.alias("sample_base"), F.round(F.lit(1.4601) + c("p_size") * 0.002, 6).alias("d060"), (k % 3 == 0).alias("mg_context"), (k % 6 == 0).alias("evaporitic_context"))


# --- the same wide row, stated in SQL -------------------------------------------------
_PREP = {"n": "natural", "g": "glicolado", "c": "calcinado"}


def _cols():
    out = []
    for k, prep in _PREP.items():
        out.append(f"bool_or(preparation = '{prep}') AS has_{k}")
        for w, (lo, hi) in N.WINDOWS.items():
            cond = f"FILTER (preparation = '{prep}' AND d BETWEEN {lo} AND {hi})"
            out.append(f"arg_max(d, (intensity, d)) {cond} AS {k}_{w}_d, max(intensity) {cond} AS {k}_{w}_i")
    return ",\n  ".join(out)


WIDE = PEAKS + f"""
, fe AS (SELECT m.curve_id, m.idx, m.yc, coalesce(max(CASE WHEN n.idx < m.idx AND n.yc <= m.yc * 0.5e0 THEN n.idx END), 0) AS l, coalesce(min(CASE WHEN n.idx > m.idx AND n.yc <= m.yc * 0.5e0 THEN n.idx END), max(n.idx)) AS r
   FROM mxm m JOIN nrm n USING (curve_id) GROUP BY ALL),
fx AS (SELECT e.curve_id, e.idx, e.yc, a.tt AS x0, a.yc AS y0, b.tt AS x1, b.yc AS y1, q.tt AS x2, q.yc AS y2, z.tt AS x3, z.yc AS y3 FROM fe e
  JOIN nrm a ON a.curve_id = e.curve_id AND a.idx = e.l JOIN nrm b ON b.curve_id = e.curve_id AND b.idx = e.l + 1
  JOIN nrm q ON q.curve_id = e.curve_id AND q.idx = e.r - 1 JOIN nrm z ON z.curve_id = e.curve_id AND z.idx = e.r),
fw AS (SELECT curve_id, idx, nullif(greatest(0, (CASE WHEN abs(y3 - y2) < 1e-12 THEN x2 ELSE x2 + (x3 - x2) * (yc / 2 - y2) / (y3 - y2) END) - (CASE WHEN abs(y1 - y0) < 1e-12 THEN x0 ELSE x0 + (x1 - x0) * (yc / 2 - y0) / (y1 - y0) END)), 0) AS fwhm FROM fx),
wd AS (SELECT sample_base, count(*) AS n_peaks, count(DISTINCT preparation) AS treatments, bool_or(coalesce(fwhm > 0.5, false)) AS broad, bool_or(coalesce(fwhm >= 0.8 AND d BETWEEN 9 AND 18.6, false)) AS broad_basal,
  {_cols()}
  FROM pk LEFT JOIN fw USING (curve_id, idx) GROUP BY sample_base),
cx AS (SELECT p_partkey AS sample_base, round(1.4601e0 + p_size * 0.002e0, 6) AS d060, p_partkey % 3 = 0 AS mg, p_partkey % 6 = 0 AS evap FROM part)
"""


def has(k, *ws):
    if k == "rep":
        return "(CASE WHEN has_n THEN {} WHEN has_g THEN {} ELSE {} END)".format(*[has(x, *ws) for x in "ngc"])
    return "(" + " AND ".join(f"{k}_{w}_d IS NOT NULL" for w in ws) + ")"


def inten(k, w):
    return f"coalesce({k}_{w}_i, 0)"


def gap(a, wa, z, wz):
    return f"({z}_{wz}_d - {a}_{wa}_d)"


def anyw(w):
    return f"({has('n', w)} OR {has('g', w)} OR {has('c', w)})"


def lst(**conds):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in conds.items()) + ")"


def num(cond, v):
    return f"(CASE WHEN {cond} THEN {v}e0 ELSE 0e0 END)"


ILL = " AND ".join(has(k, f"illite_10a_{k}") for k in "ngc")
SME = " AND ".join(has(k, f"smectite_{k}") for k in "ngc")
QTZ = " AND ".join(has(k, f"quartz_101_{k}") for k in "ngc")
CHL = f"({has('n', 'chlorite_14a_n')} AND {has('c', 'chlorite_14a_c')})"
KAO = f"({has('n', 'kaolinite_7a_n')} AND {has('g', 'kaolinite_7a_g')} AND {inten('c', 'kaolinite_7a_c_check')} < 0.1e0 * {inten('n', 'kaolinite_7a_n')})"
MIN_SQL = lst(Caulinita=KAO, Clorita=CHL, Esmectita=SME, Ilita=ILL, Quartzo=QTZ)
hits = lambda stem: "(" + " + ".join(f"{has(k, f'{stem}_{k}')}::INT" for k in "ngc") + ")"


@query("h1_interval_diagnosis", f"""
WITH {WIDE}, m AS (SELECT *, {MIN_SQL} AS minerals FROM wd)
SELECT sample_base, minerals, CASE WHEN minerals <> '' THEN 'diagnosed' ELSE 'inconclusive' END AS status,
  CASE WHEN {CHL} THEN CASE WHEN {inten('c', 'chlorite_14a_c')} > {inten('n', 'chlorite_14a_n')} THEN 'intensificado' ELSE 'preservado' END END AS chlorite_state,
  {QTZ} AND {has('n', 'quartz_100')} AS quartz_100 FROM m""")
def h1(spark, d):
    return N.interval_diagnosis(interval_trios(spark, d)).select("sample_base", F.array_join("minerals", ",").alias("minerals"), "status", "chlorite_state", "quartz_100")


@query("h2_group_classification", f"""
WITH {WIDE}, m AS (SELECT sample_base, has_n AND has_g AND has_c AS complete, unnest(string_split({MIN_SQL}, ',')) AS mineral FROM wd)
SELECT sample_base, mineral, CASE mineral WHEN 'Clorita' THEN 0.9e0 WHEN 'Esmectita' THEN 0.88e0 WHEN 'Quartzo' THEN 0.65e0 ELSE 0.82e0 END AS score,
  CASE WHEN mineral = 'Quartzo' THEN 'possible_by_rules' ELSE 'confirmed_by_rules' END AS role, CASE WHEN complete THEN 'complete' ELSE 'incomplete' END AS trio_status FROM m WHERE mineral <> ''""")
def h2(spark, d):
    return N.group_classification(N.interval_diagnosis(interval_trios(spark, d))).select("sample_base", "mineral", "score", "role", "trio_status")


@query("h3_companion_behaviour", f"""
WITH {WIDE} SELECT sample_base, CASE WHEN {SME} THEN 'complete' ELSE 'partial' END AS smectite_expansion, CASE WHEN {ILL} THEN 'stable' ELSE 'partial' END AS illite_stability,
  CASE WHEN {has('n', 'kaolinite_7a_n')} AND NOT {has('c', 'kaolinite_7a_c_check')} THEN 'destroyed' ELSE 'partial_or_persistent' END AS kaolinite_heating_loss, CASE WHEN {CHL} THEN 'preserved' ELSE 'partial' END AS chlorite_heating_resistance,
  {lst(partial_expansion=f"{hits('smectite')} BETWEEN 1 AND 2", persistent_7a_with_14a=f"{has('n', 'kaolinite_7a_n')} AND {has('c', 'kaolinite_7a_c_check')} AND {has('n', 'chlorite_14a_n')}",
       unstable_14a=f"{has('n', 'chlorite_14a_n')} AND NOT {has('c', 'chlorite_14a_c')}", illite_quartz_overlap=f"{has('rep', 'illite_3_33a')} AND {has('rep', 'quartz_101')}")} AS warnings FROM wd""")
def h3(spark, d):
    return N.companion_behaviour(trios(spark, d)).withColumn("warnings", F.array_join("warnings", ","))


_CLANY = f"({has('n', 'chlorite_14a_n')} OR {has('c', 'chlorite_14a_c')} OR {has('n', 'chlorite_3_53a')})"


@query("h4_targeted_screening", f"""
WITH {WIDE}, s AS (SELECT sample_base, {hits('smectite')} AS sh, {hits('illite_10a')} AS ih, {CHL} AS cl, {_CLANY} AS ca, {KAO} AS ka, {has('n', 'kaolinite_7a_n')} OR {has('g', 'kaolinite_7a_g')} AS kp FROM wd)
SELECT sample_base, 'Esmectita' AS mineral, CASE WHEN sh = 3 AND NOT cl THEN 'detected' WHEN sh >= 2 THEN 'mixed_layer_suspected' WHEN sh = 1 THEN 'possible' ELSE 'not_observed' END AS status,
  CASE WHEN sh = 3 AND cl THEN 0.62e0 WHEN sh = 3 THEN 0.88e0 WHEN sh = 2 THEN 0.64e0 WHEN sh = 1 THEN 0.48e0 ELSE 0e0 END AS score FROM s
UNION ALL SELECT sample_base, 'Clorita', CASE WHEN cl THEN 'detected' WHEN ca THEN 'possible' ELSE 'not_observed' END, CASE WHEN cl THEN 0.86e0 WHEN ca THEN 0.48e0 ELSE 0e0 END FROM s
UNION ALL SELECT sample_base, 'Caulinita', CASE WHEN ka THEN 'detected' WHEN kp THEN 'possible' ELSE 'not_observed' END, CASE WHEN ka THEN 0.82e0 WHEN kp THEN 0.45e0 ELSE 0e0 END FROM s
UNION ALL SELECT sample_base, 'Ilita', CASE WHEN ih = 3 THEN 'detected' WHEN ih > 0 THEN 'possible' ELSE 'not_observed' END, CASE WHEN ih = 3 THEN 0.78e0 WHEN ih > 0 THEN 0.42e0 ELSE 0e0 END FROM s""")
def h4(spark, d):
    return N.targeted_screening(trios(spark, d))


@query("h5_group_candidates", f"""
WITH {WIDE}, s AS (SELECT sample_base, has_n AND has_g AND has_c AS complete, {CHL} AS det, {_CLANY} AS ca, {has('g', 'smectite_g')} AS s1, {has('c', 'smectite_c')} AS s2, {has('rep', 'chlorite_14a')} AS c14, {has('rep', 'chlorite_7a')} AS c7, {has('rep', 'chlorite_3_53a')} AS c35,
   {has('rep', 'kaolinite_7a')} AS k7, {has('rep', 'kaolinite_3_57a')} AS k35, has_n, has_c, {" + ".join(f"{has(k, 'illite_10a')}::INT" for k in "ngc")} AS ih FROM wd),
t AS (SELECT *, (k7 OR c7) AND NOT c14 AND NOT has_c AS ov, c14 OR (c7 AND c35) AS cm, {num('s1', 0.52)} + {num('s2', 0.24)} + {num('has_n', 0.14)} AS sm, {num('c14', 0.42)} + {num('c7', 0.24)} + {num('c35', 0.18)} AS cl, {num('k7', 0.38)} + {num('k35', 0.38)} + {num('has_c', 0.08)} AS ka FROM s),
u AS (SELECT sample_base, complete, 'esmectita expansiva' AS mineral, CASE WHEN det AND sm > 0 THEN least(sm, 0.74e0) ELSE sm END AS score FROM t WHERE s1 OR s2
 UNION ALL SELECT sample_base, complete, 'clorita/vermiculita', CASE WHEN det THEN greatest(cl, 0.92e0) ELSE cl END FROM t WHERE cm AND NOT ov
 UNION ALL SELECT sample_base, complete, 'clorita', CASE WHEN det THEN 0.86e0 ELSE 0.48e0 END FROM t WHERE NOT cm AND ca AND NOT ov
 UNION ALL SELECT sample_base, complete, 'caulinita', ka FROM t WHERE (k7 OR k35) AND NOT ov UNION ALL SELECT sample_base, complete, 'inconclusivo: sobreposição 7 Å clorita/caulinita', 0.52e0 FROM t WHERE ov
 UNION ALL SELECT sample_base, complete, 'ilita/mica', least(0.86e0, 0.24e0 + 0.22e0 * ih) FROM t WHERE ih > 0)
SELECT sample_base, mineral, round(score, 4) AS score, CASE WHEN round(score, 4) >= 0.78 AND complete THEN 'alta' WHEN round(score, 4) >= 0.58 THEN 'media' WHEN round(score, 4) >= 0.35 THEN 'baixa/media' ELSE 'baixa' END AS confidence FROM u""")
def h5(spark, d):
    return N.group_candidates(trios(spark, d))


def _hypothesis(name, score, plus, minus):
    return f"SELECT sample_base, {name} AS candidate_id, {score} AS v, missing, {plus} AS evidence_for, {minus} AS evidence_against FROM mi"


_HYPOTHESES = "\nUNION ALL ".join([
    _hypothesis("'kaolin_group'", "ka", lst(natural_7a="n7 > 0", glycolated_7a="g7 > 0", stable_7a="n7 > 0 AND g7 > 0 AND kst", lost_by_heating="lost", line_3_57a="k357"),
                lst(kept_by_heating="n7 > 0 AND c7 >= 0.5e0 * n7", full_chlorite_series="fullset")),
    _hypothesis("'chlorite_group'", "cl", lst(line_14a="n14 OR g14 OR c14", line_7a="ch7", line_4_72a="ch472", line_3_53a="ch353", no_expansion="n14 AND NOT sg", heat_resistant_14a="n14 AND c14"), lst(expanded_17a="sg")),
    _hypothesis("'smectite_group'", "sm", lst(natural_basal="sn", glycolated_basal="sg", calcined_basal="sc", shift_over_1_2a="sn AND sg AND ex"), lst(chlorite_without_expansion="NOT sg AND fullset")),
    _hypothesis("'illite_mica'", "il", lst(line_10a_everywhere="ih = 3", line_10a_somewhere="ih BETWEEN 1 AND 2", no_expansion=f"{has('n', 'illite_10a_n')} AND NOT sg", calcined_10a=has('c', 'illite_10a_c'), line_5a="i5", line_3_33a="i333"),
                lst(quartz_at_3_33a="i333 AND q101 AND ih < 2")),
    _hypothesis("'vermiculite_group'", "ve", lst(no_expansion="n14 AND NOT sg", collapse_of_14a="n14 AND NOT c14"), lst(full_chlorite_series="fullset")),
    _hypothesis("CASE WHEN unres THEN 'kaolin_chlorite_overlap_7a' ELSE 'mixed_layer' END", "CASE WHEN unres THEN greatest(mx1, 0.52e0) ELSE mx1 END",
                lst(partial_smectite_series="sn::INT + sg::INT + sc::INT BETWEEN 1 AND 2", illite_with_expansion="ih > 0 AND sg", broad_basal="broad_basal"), "''")])


@query("h6_clay_interpretation", f"""
WITH {WIDE}, o AS (SELECT *, {inten('n', 'kaolinite_7a_n')} AS n7, {inten('g', 'kaolinite_7a_g')} AS g7, {inten('c', 'kaolinite_7a_c_check')} AS c7, {has('rep', 'kaolinite_3_57a')} AS k357, {has('rep', 'chlorite_7a')} AS ch7, {has('rep', 'chlorite_4_72a')} AS ch472,
  {has('rep', 'chlorite_3_53a')} AS ch353, {has('n', 'chlorite_14a_n')} AS n14, {has('g', 'chlorite_14a_g')} AS g14, {has('c', 'chlorite_14a_c')} AS c14, {has('n', 'smectite_n')} AS sn, {has('g', 'smectite_g')} AS sg, {has('c', 'smectite_c')} AS sc,
  {hits('illite_10a')} AS ih, {has('rep', 'illite_3_33a')} AS i333, {has('rep', 'illite_5a')} AS i5, {has('rep', 'quartz_101')} AS q101, coalesce({gap('n', 'smectite_n', 'g', 'smectite_g')} > 1.2, false) AS ex,
  coalesce(abs(n_kaolinite_7a_n_d - g_kaolinite_7a_g_d) <= 0.25, false) AS kst FROM wd),
f AS (SELECT *, n14 AND ch7 AND ch472 AND ch353 AS fullset, has_c AND n7 > 0 AND c7 < 0.25e0 * n7 AS lost, (n14 OR g14 OR c14) AND (ch472 OR ch353 OR c14) AS disc FROM o),
s AS (SELECT *, {num('n7 > 0', 0.25)} + {num('g7 > 0', 0.2)} + {num('n7 > 0 AND g7 > 0 AND kst', 0.2)} + {num('lost', 0.25)} + {num('k357', 0.1)} + {num('n7 > 0 AND c7 >= 0.5e0 * n7', -0.25)} + {num('fullset', -0.2)} AS ka0,
  {num('n14 OR g14 OR c14', 0.3)} + {num('ch7', 0.2)} + {num('ch472', 0.15)} + {num('ch353', 0.15)} + {num('n14 AND NOT sg', 0.2)} + {num('n14 AND c14', 0.2)} + {num('sg', -0.3)} AS cl0,
  {num('sn', 0.3)} + {num('sg', 0.4)} + {num('sc', 0.25)} + {num('sn AND sg AND ex', 0.15)} + {num('NOT sg AND fullset', -0.25)} AS sm,
  CASE WHEN ih = 3 THEN 0.35e0 WHEN ih > 0 THEN 0.18e0 ELSE 0e0 END + {num(f"{has('n', 'illite_10a_n')} AND NOT sg", 0.2)} + {num(has('c', 'illite_10a_c'), 0.15)} + {num('i5', 0.15)} + {num('i333', 0.1)} + {num('i333 AND q101 AND ih < 2', -0.15)} AS il,
  {num('n14 AND NOT sg', 0.3)} + {num('n14 AND NOT c14', 0.2)} + {num('fullset', -0.2)} AS ve,
  {num('sn::INT + sg::INT + sc::INT BETWEEN 1 AND 2', 0.3)} + {num('ih > 0 AND sg', 0.3)} + {num('broad_basal', 0.2)} AS mx0, (n7 > 0 OR g7 > 0 OR ch7) AND NOT lost AND NOT disc AS unres FROM f),
z AS (SELECT *, CASE WHEN (n7 > 0 OR g7 > 0) AND NOT lost THEN least(ka0, CASE WHEN k357 THEN 0.38e0 ELSE 0.32e0 END) ELSE ka0 END AS ka, CASE WHEN ch7 AND NOT disc THEN least(cl0, 0.34e0) ELSE cl0 END AS cl FROM s),
y AS (SELECT *, CASE WHEN cl >= 0.6 AND ka >= 0.4 AND c7 > 0 THEN greatest(mx0, 0.55e0) ELSE mx0 END AS mx1 FROM z),
mi AS (SELECT *, concat_ws(',', CASE WHEN NOT has_n THEN 'natural' END, CASE WHEN NOT has_g THEN 'glicolado' END, CASE WHEN NOT has_c THEN 'calcinado' END) AS missing FROM y),
u AS ({_HYPOTHESES}),
q AS (SELECT sample_base, candidate_id, round(least(greatest(v, 0), 1) + 1e-9, 4) AS score, missing, evidence_for, evidence_against FROM u)
SELECT *, CASE WHEN candidate_id = 'kaolin_chlorite_overlap_7a' OR (candidate_id = 'mixed_layer' AND score >= 0.4) THEN 'ambíguo' WHEN candidate_id = 'vermiculite_group' AND score >= 0.4 THEN 'provisório' WHEN candidate_id = 'vermiculite_group' THEN 'possível'
  WHEN score >= 0.6 THEN 'provável' WHEN score >= 0.4 THEN 'possível' ELSE 'descartado' END AS status FROM q""")
def h6(spark, d):
    return N.clay_interpretation(trios(spark, d))


_W5 = N.STABLE_WINDOWS
_OR = lambda f: "(" + " OR ".join(f(w) for w in _W5) + ")"
_EXP = f"coalesce({has('n', 'smectite_n')} AND {has('g', 'smectite_g')} AND {gap('n', 'smectite_n', 'g', 'smectite_g')} >= 0.8, false)"
_N29 = f"{has('n', 'corrensite_n_29a')} AND {has('g', 'corrensite_g_31a')}"
BEHAV = lst(
    appears_after_heating=has("c", "corrensite_c_24a"), broad_or_shoulder="broad", collapses_after_heating=f"{has('g', 'smectite_g')} AND {has('c', 'smectite_c')}",
    disappears_after_heating=_OR(lambda w: f"({has('n', w)} AND NOT {has('c', w)})"), expands_with_glycol=_EXP,
    increases_intensity_after_heating=f"{has('n', 'chlorite_14a')} AND {has('c', 'chlorite_14a')} AND c_chlorite_14a_i >= 1.2e0 * n_chlorite_14a_i", ordered_chlorite_smectite=_N29,
    partial_expansion_with_glycol=f"{has('n', 'smectite_n')} AND {has('g', 'smectite_g')} AND NOT {_EXP}", persists_after_heating=_OR(lambda w: f"({has('n', w)} AND {has('c', w)})"),
    quartz_internal_standard_pattern=f"{anyw('quartz_100')} AND {anyw('quartz_101')}", rational_sequence=_N29, stable_after_glycol=_OR(lambda w: f"({has('n', w)} AND {has('g', w)})"),
    strongly_reduced_after_heating=f"{has('n', 'kaolinite_7a')} AND {has('c', 'kaolinite_7a')} AND c_kaolinite_7a_i <= 0.3e0 * n_kaolinite_7a_i")


@query("h7_treatment_behaviours", f"WITH {WIDE} SELECT sample_base, {BEHAV} AS behaviours, treatments, n_peaks FROM wd")
def h7(spark, d):
    return N.behaviours(trios(spark, d)).select("sample_base", F.array_join("behaviours", ",").alias("behaviours"), c("treatments").cast("long").alias("treatments"), c("n_peaks").cast("long").alias("n_peaks"))


def _ps(fam):
    ws = N.PEAK_SET_WINDOWS[fam]
    return "((" + " + ".join(f"{anyw(w)}::INT" for w in ws) + f") / {len(ws)}e0)"


AMB = lst(**{w: anyw(w) for w in N.AMBIGUITY_WINDOWS})
_LAYERS = WIDE + f"""
, ly AS (SELECT wd.*, {BEHAV} AS b, {AMB} AS amb, coalesce(mg, false) AS mgc, coalesce(evap, false) AS evc,
  CASE WHEN d060 BETWEEN 1.475 AND 1.515 THEN 'dioctahedral' WHEN d060 BETWEEN 1.505 AND 1.535 THEN 'intermediate' WHEN d060 BETWEEN 1.525 AND 1.555 THEN 'trioctahedral' ELSE 'unknown' END AS octa
  FROM wd LEFT JOIN cx USING (sample_base)),
l2 AS (SELECT *, contains(b, 'expands_with_glycol') AND NOT contains(b, 'partial_expansion') AND contains(b, 'collapses_after_heating') AS smec, octa IN ('trioctahedral', 'intermediate') OR mgc AS mgx FROM ly),
"""


def _cand(cond, label, beh, ps, d060, thermal, prox, comp=False):
    ps = _ps(ps) if isinstance(ps, str) else f"{ps}e0"
    label = label if label.startswith("CASE") else f"'{label}'"
    num_ = lambda v: v if isinstance(v, str) else f"{v}e0"
    return f"SELECT sample_base, treatments, has_n, has_g, n_peaks, amb, {label} AS label, {num_(beh)} AS behaviour, {ps} AS peak_set, {num_(d060)} AS d060, {num_(thermal)} AS thermal, {num_(prox)} AS proximity, {comp} AS companions FROM l2 WHERE {cond}"


_tri, _di, _kn = "octa = 'trioctahedral'", "octa = 'dioctahedral'", "octa <> 'unknown'"
_pk = lambda cond, a, z: f"CASE WHEN {cond} THEN {a}e0 ELSE {z}e0 END"
_chl3 = f"{has('n', 'chlorite_14a_n')} AND {has('g', 'chlorite_14a_g')} AND {has('c', 'chlorite_14a_c')}"
_ill3 = " AND ".join(has(k, "illite_10a") for k in "ngc")
CANDIDATE_SQL = _LAYERS + "cnd AS (" + "\nUNION ALL ".join([
    _cand("smec", "smectite_group", 1.0, "smectite_group", _pk(_kn, 0.5, 0.0), 1.0, 0.8),
    _cand("smec AND mgx", "CASE WHEN evc THEN 'stevensite' ELSE 'saponite' END", 0.9, "smectite_group", _pk(_tri, 1.0, 0.5), 0.8, 0.7),
    _cand(f"smec AND NOT mgx AND {_di}", "montmorillonite_or_nontronite", 0.85, "smectite_group", 1.0, 0.8, 0.6),
    _cand(_chl3, "chlorite", 0.85, "chlorite_group", _pk(_tri, 1.0, 0.3), 0.9, 0.8, True),
    _cand(f"{_chl3} AND {_di}", "dioctahedral_chlorite", 0.75, "chlorite_group", 1.0, 0.8, 0.7),
    _cand(f"{has('n', 'vermiculite_14a')} AND {has('g', 'vermiculite_14a')} AND {has('c', 'vermiculite_collapse')}", "vermiculite", 0.75, 0.35, 0.3, 0.8, 0.6),
    _cand(_ill3, "illite_mica", 0.85, "illite_mica", _pk(_kn, 0.6, 0.0), 0.8, 0.8, True), _cand(f"{_ill3} AND {_tri}", "biotite", 0.55, "illite_mica", 1.0, 0.6, 0.5),
    _cand(f"{has('n', 'kaolinite_7a_n')} AND {has('g', 'kaolinite_7a_g')} AND (NOT {has('c', 'kaolinite_7a_c_check')} OR contains(b, 'strongly_reduced_after_heating'))", "kaolin_group", 0.85, "kaolin_group", _pk(_di, 0.7, 0.2), 1.0, 0.8, True),
    _cand(f"{has('n', 'kerolite_9_4a')} AND {has('g', 'kerolite_9_4a')} AND NOT {has('g', 'smectite_g')}", "kerolite", 0.75, "kerolite_talc", _pk(_tri, 0.8, 0.2), 0.5, 0.7),
    _cand(f"{has('n', 'sepiolite_12a')} AND {has('g', 'sepiolite_12a')}", "sepiolite", 0.65, "sepiolite", 0.2, 0.5, 0.6),
    _cand(f"{has('n', 'palygorskite_10_5a')} AND {has('g', 'palygorskite_10_5a')}", "palygorskite", 0.65, "palygorskite", 0.2, 0.5, 0.6),
    _cand(" AND ".join(has(k, "chlorite_7a") for k in "ngc") + f" AND {_tri}", "serpentine", 0.55, 0.2, 1.0, 0.4, 0.5)]) + ")\n"
SCORE_SQL = CANDIDATE_SQL + """
, r0 AS (SELECT *, 40 * least(behaviour, 1) + 25 * least(peak_set, 1) + 15 * least(d060, 1) + 10 * least(thermal, 1) + 5 * least(proximity, 1) + CASE WHEN amb = '' THEN 5 ELSE 0 END AS raw FROM cnd),
r1 AS (SELECT *, round(least(raw, CASE WHEN treatments < 2 OR n_peaks <= 1 THEN 40 ELSE 100 END, CASE WHEN NOT has_n OR NOT has_g OR (amb <> '' AND companions AND peak_set < 0.5) THEN 70 ELSE 100 END) + 1e-9, 2) AS score FROM r0)
"""


def layered(spark, d):
    return N.ambiguities(N.behaviours(N.with_context(trios(spark, d), context(spark, d))))


@query("h8_candidate_rules", f"WITH {CANDIDATE_SQL} SELECT sample_base, label, behaviour, round(peak_set, 6) AS peak_set, d060, thermal, proximity, companions FROM cnd")
def h8(spark, d):
    return N.candidates(layered(spark, d)).select("sample_base", "label", "behaviour", r(c("peak_set")).alias("peak_set"), "d060", "thermal", "proximity", "companions")


@query("h9_candidate_score", f"WITH {SCORE_SQL} SELECT sample_base, label, score, CASE WHEN score <= 40 THEN 'possible_by_rules' WHEN score <= 70 THEN 'probable_by_rules' ELSE 'confirmed_by_rules' END AS level FROM r1")
def h9(spark, d):
    return N.score_candidates(N.candidates(layered(spark, d))).select("sample_base", "label", "score", "level")


@query("h10_mixed_layers", f"""
WITH {_LAYERS} m AS (SELECT sample_base, 'corrensite' AS hypothesis, 'R1' AS ordering, CASE WHEN {has('c', 'corrensite_c_24a')} THEN 'high' ELSE 'medium' END AS confidence FROM l2 WHERE {_N29}
 UNION ALL SELECT sample_base, 'illite_smectite_or_random_mixed_layer', 'R0|unknown', 'medium' FROM l2 WHERE contains(b, 'partial_expansion_with_glycol') OR contains(b, 'broad_or_shoulder')
 UNION ALL SELECT sample_base, 'chlorite_smectite', 'R0|unknown', 'medium' FROM l2 WHERE {has('n', 'mix_14a')} AND {has('g', 'mix_17a')}
 UNION ALL SELECT sample_base, 'kerolite_stevensite_mixed_layer', 'unknown', 'medium' FROM l2 WHERE {has('n', 'mix_9_10a')} AND ({has('g', 'mix_17a')} OR mgc)
 UNION ALL SELECT sample_base, 'talc_smectite', 'unknown', 'medium' FROM l2 WHERE {has('n', 'mix_9_4a')} AND {has('g', 'mix_17a')}) SELECT * FROM m""")
def h10(spark, d):
    return N.mixed_layers(layered(spark, d))


@query("h11_ambiguity_windows", f"WITH {WIDE} SELECT sample_base, {AMB} AS ambiguities FROM wd")
def h11(spark, d):
    return N.ambiguities(trios(spark, d)).select("sample_base", F.array_join("ambiguities", ",").alias("ambiguities"))


@query("h12_recommended_tests", f"""
WITH {CANDIDATE_SQL}, lb AS (SELECT sample_base, string_agg(label, ',') AS labels FROM cnd GROUP BY 1)
SELECT sample_base, {lst(ftir='true', random_powder='true', heating_400_550="contains(amb, 'amb_7a') OR contains(amb, 'amb_14a')", glycerol_potassium="contains(amb, 'amb_14a')",
    quartz_pattern="contains(amb, 'amb_3_33a') OR contains(amb, 'amb_1_54a')", chlorite_003_004="contains(amb, 'amb_7a')", refine_060="octa = 'unknown'",
    mg_chemistry="regexp_matches(labels, 'stevensite|saponite|kerolite')", morphology="regexp_matches(labels, 'sepiolite|palygorskite|serpentine')")} AS tests FROM l2 LEFT JOIN lb USING (sample_base)""")
def h12(spark, d):
    t = layered(spark, d)
    lab = N.candidates(t).groupBy("sample_base").agg(F.collect_set("label").alias("labels"))
    return N.recommended_tests(t, lab).select("sample_base", F.array_join("tests", ",").alias("tests"))


def _edge(cond, s, t, kind, w, delta="NULL"):
    return f"SELECT sample_base, '{s}' AS source, '{t}' AS target, '{kind}' AS relation, {w}e0 AS weight, round({delta}, 5) AS delta_d FROM wd WHERE {cond}"


_EDGES = [_edge(_EXP, "N:smectite_n", "G:smectite_g", "expands_to", 0.4, gap("n", "smectite_n", "g", "smectite_g")),
          _edge(f"{has('g', 'smectite_g')} AND {has('c', 'smectite_c')}", "G:smectite_g", "C:smectite_c", "collapses_to", 0.4, gap("g", "smectite_g", "c", "smectite_c")),
          _edge(_N29, "N:corrensite_n_29a", "G:corrensite_g_31a", "expands_to", 0.45, gap("n", "corrensite_n_29a", "g", "corrensite_g_31a"))]
for _w in _W5:
    _EDGES += [_edge(f"{has('n', _w)} AND {has('g', _w)}", f"N:{_w}", f"G:{_w}", "persists_as", 0.15, gap("n", _w, "g", _w)),
               _edge(f"{has('n', _w)} AND {has('c', _w)}", f"N:{_w}", f"C:{_w}", "persists_as", 0.15, gap("n", _w, "c", _w)),
               _edge(f"{has('n', _w)} AND NOT {has('c', _w)}", f"N:{_w}", "C:absent", "disappears", 0.2)]


@query("h15_relation_edges", f"WITH {WIDE} " + "\nUNION ALL ".join(_EDGES))
def h15(spark, d):
    return N.relation_edges(trios(spark, d)).withColumn("delta_d", r(c("delta_d"), 5))


_MIXED = [(_N29, "corrensite", f"CASE WHEN {has('c', 'corrensite_c_24a')} THEN 0.8e0 ELSE 0.6e0 END"),
          ("contains(b, 'partial_expansion_with_glycol') OR contains(b, 'broad_or_shoulder')", "illite_smectite_or_random_mixed_layer", 0.6), (f"{has('n', 'mix_14a')} AND {has('g', 'mix_17a')}", "chlorite_smectite", 0.6),
          (f"{has('n', 'mix_9_10a')} AND ({has('g', 'mix_17a')} OR mgc)", "kerolite_stevensite_mixed_layer", 0.6), (f"{has('n', 'mix_9_4a')} AND {has('g', 'mix_17a')}", "talc_smectite", 0.6)]
MIXED_SCORE_SQL = SCORE_SQL.replace(CANDIDATE_SQL, CANDIDATE_SQL.rstrip()[:-1] + "\nUNION ALL " + "\nUNION ALL ".join(_cand(k, n, beh, 0.5, 0.4, 0.5, 0.6) for k, n, beh in _MIXED) + ")\n")


@query("h16_full_interpretation", f"""
WITH {MIXED_SCORE_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY sample_base ORDER BY score DESC, label) AS rank FROM r1)
SELECT sample_base, rank, label, score, amb AS ambiguities FROM k""")
def h16(spark, d):
    return N.interpret(trios(spark, d), context(spark, d)).select("sample_base", "rank", "label", "score", F.array_join("ambiguities", ",").alias("ambiguities"))


@query("h18_incoming_preclassification", """
WITH p AS (SELECT l_orderkey, round(1.46e0 + l_discount, 6) AS d, l_quantity AS i, round(least(abs(1.46e0 + l_discount - 1.5e0), abs(1.46e0 + l_discount - 1.52e0), abs(1.46e0 + l_discount - 1.54e0)), 6) AS dist FROM lineitem),
b AS (SELECT l_orderkey, arg_min(d, (dist, -i, d)) AS d060 FROM p WHERE d BETWEEN 1.485 AND 1.555 GROUP BY 1)
SELECT l_orderkey, d060, CASE WHEN d060 BETWEEN 1.475 AND 1.515 THEN 'dioctahedral' WHEN d060 BETWEEN 1.505 AND 1.535 THEN 'intermediate' ELSE 'trioctahedral' END AS octahedral FROM b""")
def h18(spark, d):
    from xrdlake.functions.geometry import D060_WINDOW, d060_distance, octahedral_class

    dv = c("l_discount") + 1.46
    p = table(spark, d, "lineitem").select("l_orderkey", F.round(dv, 6).alias("d"), c("l_quantity").alias("i"), F.round(d060_distance(dv), 6).alias("dist"))
    b = p.where(c("d").between(*D060_WINDOW)).groupBy("l_orderkey").agg(F.min_by("d", F.struct("dist", -c("i"), "d")).alias("d060"))
    return b.withColumn("octahedral", octahedral_class("d060"))


@query("h19_peak_geometry", f"""
WITH {PEAKS}, ax AS (SELECT CAST(i AS BIGINT) AS i FROM range(0, 7) t(i)), ln AS (SELECT DISTINCT 9.0e0 / sqrt(h.i*h.i + k.i*k.i + l.i*l.i) AS ld FROM ax h, ax k, ax l WHERE h.i + k.i + l.i > 0), lt AS (SELECT {bragg_tt('ld')} AS t FROM ln),
n AS (SELECT curve_id, peak_index, count(t) FILTER (abs(two_theta - t) <= 0.2) AS lines FROM pk CROSS JOIN lt GROUP BY ALL)
SELECT curve_id, peak_index, round(two_theta / 2, 6) AS theta, round(d, 5) AS d, 1.5406e0 < 2 * d AS observable, lines > 0 AS has_lattice_line FROM pk JOIN n USING (curve_id, peak_index)""")
def h19(spark, d):
    p = peaks(spark, d)
    cells = R.literal_table(spark, [(1, "cubic", 9.0, 9.0)], ("cell_id", "crystal_system", "a", "c"))
    idx = M.index_peaks(p, cells).select("curve_id", "peak_index").distinct().withColumn("hit", F.lit(True))
    return p.join(idx, ["curve_id", "peak_index"], "left").select("curve_id", "peak_index", r(c("two_theta") / 2).alias("theta"), r(c("d"), 5).alias("d"),
                                                                  (F.lit(1.5406) < c("d") * 2).alias("observable"), F.coalesce("hit", F.lit(False)).alias("has_lattice_line"))


@query("e15_peak_sets", f"WITH {WIDE}, u AS (" + " UNION ALL ".join(f"SELECT sample_base, '{f}' AS family, {_ps(f)} AS score, {lst(**{w: anyw(w) for w in ws})} AS matched FROM wd" for f, ws in N.PEAK_SET_WINDOWS.items()) + ") SELECT sample_base, family, round(score, 6) AS score, matched FROM u WHERE score > 0")
def e15(spark, d):
    return N.peak_sets(trios(spark, d)).select("sample_base", "family", r(c("score")).alias("score"), F.array_join("matched", ",").alias("matched"))


@query("e16_completeness", f"WITH {WIDE} SELECT sample_base, treatments, n_peaks, CASE WHEN treatments = 3 AND n_peaks >= 6 THEN 'completa' WHEN treatments >= 2 AND n_peaks >= 3 THEN 'parcial' WHEN n_peaks < 3 THEN 'fraca' ELSE 'revisar' END AS status, {lst(MISSING_NATURAL='NOT has_n', MISSING_GLYCOLATED='NOT has_g', MISSING_CALCINED='NOT has_c')} AS flags FROM wd")
def e16(spark, d):
    return N.completeness(trios(spark, d)).select("sample_base", c("treatments").cast("long").alias("treatments"), c("n_peaks").cast("long").alias("n_peaks"), "status", F.array_join("flags", ",").alias("flags"))


def _first(k, *ws):
    return "coalesce(" + ", ".join(f"{k}_{w}_d" for w in ws) + ")"


_in = lambda col, w: f"coalesce({col} BETWEEN {R.NAMED_RANGES[w][0]} AND {R.NAMED_RANGES[w][1]}, false)"
_cnt = lambda w: "(" + " + ".join(f"{_in(x, w)}::INT" for x in ("dn", "dg", "dc")) + ")"


@query("e17_basal_trajectory", f"""
WITH {WIDE}, t AS (SELECT sample_base, has_c, {_first('n', 'smectite_n', 'chlorite_14a_n', 'illite_10a_n')} AS dn, {_first('g', 'smectite_g', 'chlorite_14a_g', 'illite_10a_g')} AS dg, {_first('c', 'smectite_c', 'chlorite_14a_c', 'kaolinite_7a_c_check')} AS dc FROM wd),
z AS (SELECT *, CASE WHEN dn IS NOT NULL AND {_in('dg', 'smectite_g')} AND {_in('dc', 'smectite_c')} THEN 'expansive' WHEN {_in('dg', 'smectite_g')} THEN 'expansive_incomplete' WHEN {_cnt('illite_10a')} >= 2 THEN 'illite_mica' WHEN {_cnt('chlorite_14a')} >= 2 THEN 'chlorite_vermiculite' ELSE 'insufficient' END AS reading FROM t)
SELECT sample_base, round(dn, 5) AS dn, round(dg, 5) AS dg, round(dc, 5) AS dc, round(dg - dn, 5) AS shift_ng, round(dc - dg, 5) AS shift_gc, reading, CASE WHEN reading = 'expansive' THEN 'alta' WHEN reading = 'insufficient' OR (reading = 'expansive_incomplete' AND NOT has_c) THEN 'baixa' ELSE 'média' END AS confidence FROM z""")
def e17(spark, d):
    return N.basal_trajectory(trios(spark, d)).select("sample_base", *[r(c(k), 5).alias(k) for k in ("dn", "dg", "dc", "shift_ng", "shift_gc")], "reading", "confidence")


def _stab(stem, cc):
    h = f"({has('n', stem + '_n')}::INT + {has('g', stem + '_g')}::INT + {has('c', cc)}::INT)"
    return f"CASE {h} WHEN 3 THEN 1e0 WHEN 2 THEN 0.75e0 WHEN 1 THEN 0.35e0 ELSE 0e0 END"


@query("e18_trajectory_score", f"""
WITH {WIDE}, t AS (SELECT sample_base, treatments / 3e0 AS cp, CASE WHEN {has('n', 'smectite_n')} AND {has('g', 'smectite_g')} AND {gap('n', 'smectite_n', 'g', 'smectite_g')} >= 1 THEN 1e0 WHEN {has('g', 'smectite_g')} THEN 0.65e0 ELSE 0e0 END AS ex,
  CASE WHEN {has('g', 'smectite_g')} AND {has('c', 'smectite_c')} AND {gap('g', 'smectite_g', 'c', 'smectite_c')} <= -5 THEN 1e0 WHEN {has('c', 'smectite_c')} AND ({has('n', 'smectite_n')} OR {has('g', 'smectite_g')}) THEN 0.55e0 ELSE 0e0 END AS co,
  greatest({_stab('illite_10a', 'illite_10a_c')}, {_stab('chlorite_14a', 'chlorite_14a_c')}, {_stab('kaolinite_7a', 'kaolinite_7a_c_check')}) AS st FROM wd)
SELECT sample_base, ex AS expansion, co AS collapse, st AS stability, round(0.2e0 * cp + 0.25e0 * ex + 0.2e0 * co + 0.2e0 * st + 0.15e0 * greatest(ex, co, st) + 1e-9, 6) AS score FROM t""")
def e18(spark, d):
    return N.trajectory_score(trios(spark, d)).select("sample_base", "expansion", "collapse", "stability", F.round(c("score") + 1e-9, 6).alias("score"))


def _confirm():
    return ", ".join(f"('{m}', '{rf}', {lo}e0, {hi}e0, '{need}')" for m, rf, _t, lo, hi, need in R.CONFIRMATORY_REFLECTIONS)


_CONF = f"""
, rr(mineral, reflection, lo, hi, need) AS (VALUES {_confirm()}), sp AS (SELECT DISTINCT sample_base FROM pk),
cf AS (SELECT s.sample_base, rr.mineral, rr.reflection, count(DISTINCT p.preparation) AS matches FROM sp s CROSS JOIN rr LEFT JOIN pk p ON p.sample_base = s.sample_base AND p.d BETWEEN lo AND hi AND (need = '' OR need = p.preparation) GROUP BY ALL)
"""


@query("e19_confirmatory_reflections", f"WITH {PEAKS} {_CONF} SELECT *, CASE WHEN matches >= 2 THEN 'evidência de suporte' WHEN matches = 1 THEN 'observação isolada' ELSE 'não observado' END AS status FROM cf")
def e19(spark, d):
    return N.confirmatory_reflections(peaks(spark, d))


@query("e19_confirmatory_minerals", f"""
WITH {PEAKS} {_CONF}, g AS (SELECT sample_base, mineral, count(*) FILTER (matches > 0) AS observed, count(*) FILTER (matches = 0) AS absent, bool_or(matches > 0 AND reflection = '001 em EG') AS eg, bool_or(matches > 0 AND reflection = 'colapso aquecido') AS h,
  bool_or(matches > 0 AND reflection = '001 natural') AS n, bool_or(matches > 0 AND reflection = 'sem expansão em EG') AS x FROM cf GROUP BY ALL)
SELECT sample_base, mineral, observed, absent, CASE WHEN mineral LIKE 'Esmectita%' THEN CASE WHEN eg AND h THEN 'compatível' WHEN eg THEN 'parcial' ELSE 'não conclusivo' END WHEN mineral = 'Vermiculita' THEN CASE WHEN n AND x AND h THEN 'compatível' WHEN n AND x THEN 'parcial' ELSE 'não conclusivo' END
  WHEN observed >= 2 THEN 'compatível' WHEN observed = 1 THEN 'parcial' ELSE 'não conclusivo' END AS status FROM g""")
def e19b(spark, d):
    return N.confirmatory_minerals(N.confirmatory_reflections(peaks(spark, d)))


_b = lambda x: f"contains(b, '{x}')"
_EXTRA = f"({anyw('ool_7')}::INT + {anyw('ool_4_74')}::INT + {anyw('ool_3_55')}::INT)"
_MICA = f"{has('n', 'mica_10')} AND {has('g', 'mica_10')} AND {has('c', 'mica_10c')}"
_LOSS = f"coalesce(({has('n', 'heat_7')} AND {has('g', 'heat_7')} AND NOT {has('c', 'heat_7')}) OR coalesce(coalesce(c_heat_7_i, 0) / n_heat_7_i <= 0.25, false) OR contains(b, 'strongly_reduced_after_heating'), false)"


@query("h13_heat_ratio_rules", f"""
WITH {_LAYERS} u AS (
SELECT sample_base, 'chlorite' AS label, least(0.82e0 + least(0.12e0, 0.03e0 * ({_EXTRA} - 1)) + CASE WHEN c_ool_14c_i / n_ool_14_i >= 0.75 THEN 0.04e0 ELSE 0 END, 0.98e0) AS score, 'confirmed_by_rules' AS level FROM l2
  WHERE {has('n', 'ool_14')} AND {has('g', 'ool_14')} AND {has('c', 'ool_14c')} AND {_EXTRA} >= 1 AND NOT {_EXP}
UNION ALL SELECT sample_base, 'kaolin_group', 0.84e0 + CASE WHEN {has('n', 'heat_3_57')} OR {has('g', 'heat_3_57')} THEN 0.08e0 ELSE 0 END, 'confirmed_by_rules' FROM l2 WHERE {has('n', 'heat_7')} AND {has('g', 'heat_7')} AND {_LOSS} AND NOT {has('n', 'ool_14')}
UNION ALL SELECT sample_base, 'smectite_group', 0.95e0, 'confirmed_by_rules' FROM l2 WHERE {has('n', 'exp_n')} AND {has('g', 'exp_g')} AND {has('c', 'exp_c')}
UNION ALL SELECT sample_base, 'illite_mica', least(0.76e0 + {num(anyw('mica_5'), 0.08)} + {num(anyw('mica_3_33'), 0.04)}, 0.92e0), CASE WHEN {anyw('mica_5')} THEN 'confirmed_by_rules' ELSE 'probable_by_rules' END FROM l2 WHERE {_MICA}
UNION ALL SELECT sample_base, 'vermiculite', 0.78e0, 'probable_by_rules' FROM l2 WHERE {has('n', 'op_14_5')} AND {has('g', 'op_14_5')} AND {has('c', 'op_10_12')} AND NOT {has('g', 'exp_g')} AND NOT {has('c', 'ool_14c')}
UNION ALL SELECT sample_base, 'sepiolite', 0.68e0, 'possible_by_rules' FROM l2 WHERE {has('n', 'fib_12')} AND {has('g', 'fib_12')} AND NOT {has('g', 'exp_g')}
UNION ALL SELECT sample_base, 'palygorskite', 0.66e0, 'possible_by_rules' FROM l2 WHERE {has('n', 'fib_10_4')} AND {has('g', 'fib_10_4')} AND NOT ({_MICA}))
SELECT sample_base, label, round(score + 1e-9, 3) AS score, level FROM u""")
def h13(spark, d):
    return N.heat_ratio_rules(N.behaviours(trios(spark, d)))


_ML = f"""
, mf AS (SELECT sample_base, {has('c', 'ml_10')} AS f1, {has('g', 'ml_17')} AS f2, {has('n', 'ml_24')} OR {has('g', 'ml_29')} OR {has('c', 'ml_24')} AS f3, {has('n', 'ml_14n')} AND {has('g', 'ml_14g')} AND {has('c', 'ml_14c')} AS f4,
  {lst(**{w: anyw(w) for w in ('ss_24', 'ss_29', 'ss_31', 'ss_12')})} AS ss FROM wd)
"""


@query("h14_mixed_layer_features", f"""
WITH {WIDE} {_ML} SELECT sample_base, concat_ws(',', CASE WHEN f1 THEN 'collapses_or_returns_to_10a' END, CASE WHEN f2 THEN 'expands_with_eg_to_17a' END, CASE WHEN f3 THEN 'long_period_candidate' END, CASE WHEN f4 THEN 'persistent_14a_component' END) AS features,
  ss AS superstructures, CASE WHEN ss <> '' THEN 'R1' ELSE 'unknown' END AS ordering, CASE WHEN ss <> '' AND (f1 OR f2) THEN 'supports_interstratification' ELSE 'ambiguous' END AS mixture FROM mf""")
def h14(spark, d):
    m = N.mixed_layer_features(trios(spark, d))
    return m.select("sample_base", F.array_join("features", ",").alias("features"), F.array_join("superstructures", ",").alias("superstructures"), "ordering", "mixture")


@query("h14_mixed_layer_candidates", f"""
WITH {WIDE} {_ML}, u AS (SELECT sample_base, ss, 'illite/smectite_or_smectitic_mixed_layer' AS candidate, 0.68e0 AS confidence FROM mf WHERE f1 AND f2 UNION ALL SELECT sample_base, ss, 'chlorite/smectite', 0.7e0 FROM mf WHERE f4 AND f2
  UNION ALL SELECT sample_base, ss, 'corrensite_or_ordered_mixed_layer', 0.78e0 FROM mf WHERE ss <> '' AND f3 UNION ALL SELECT sample_base, ss, 'mixed_layer_evidence_insufficient', 0.25e0 FROM mf WHERE NOT (f1 AND f2) AND NOT (f4 AND f2) AND NOT (ss <> '' AND f3))
SELECT sample_base, candidate, confidence, row_number() OVER (PARTITION BY sample_base ORDER BY confidence DESC, candidate) AS rank, CASE WHEN confidence >= 0.6 THEN 'possible' ELSE 'ambiguous' END AS status, CASE WHEN ss <> '' THEN 'R1' ELSE 'unknown' END AS ordering FROM u""")
def h14b(spark, d):
    return N.mixed_layer_candidates(N.mixed_layer_features(trios(spark, d)))


_PK = f"({has('n', 'kaolinite_7a_n')} AND {has('g', 'kaolinite_7a_g')} AND (NOT {has('c', 'kaolinite_7a_c_check')} OR {inten('c', 'kaolinite_7a_c_check')} < 0.1e0 * {inten('n', 'kaolinite_7a_n')}))"
_CN, _CG, _CC = has("n", "chlorite_14a_n"), has("g", "chlorite_14a_g"), has("c", "chlorite_14a_c")


@query("h17_panel_diagnosis", f"""
WITH {WIDE}, z AS (SELECT *, {ILL} AS i, {SME} AS s, {_PK} AS k, ({_CC} OR ({_CN} AND {_CG})) AS ch, {QTZ} AS q FROM wd)
SELECT sample_base, 'Ilita' AS mineral, 'alta' AS confidence FROM z WHERE i UNION ALL SELECT sample_base, 'Esmectita', 'alta' FROM z WHERE s UNION ALL SELECT sample_base, 'Caulinita', 'alta' FROM z WHERE k
UNION ALL SELECT sample_base, 'Clorita', CASE WHEN {_CC} AND {_CN} THEN 'alta' WHEN {_CC} AND {_CG} THEN 'média/alta' ELSE 'média' END FROM z WHERE ch
UNION ALL SELECT sample_base, 'Quartzo', CASE WHEN {has('n', 'quartz_100')} THEN 'alta' ELSE 'média/alta' END FROM z WHERE q UNION ALL SELECT sample_base, 'Inconclusivo', 'baixa' FROM z WHERE NOT (i OR s OR k OR ch OR q)""")
def h17(spark, d):
    return N.panel_diagnosis(trios(spark, d))


@query("e27_explanations", f"""
WITH {SCORE_SQL} SELECT sample_base, label, score, {lst(**{k: f'{k} >= 0.5' for k in ('behaviour', 'peak_set', 'd060', 'thermal', 'proximity')})} AS evidence_for, {lst(**{k: f'{k} < 0.5' for k in ('behaviour', 'peak_set', 'd060', 'thermal', 'proximity')})} AS missing,
  CASE WHEN score >= 70 THEN '' ELSE 'full_pattern_all_treatments' END AS follow_up FROM r1""")
def e27(spark, d):
    e = N.explanations(N.score_candidates(N.candidates(layered(spark, d))))
    return e.select("sample_base", "label", "score", *[F.array_join(k, ",").alias(k) for k in ("evidence_for", "missing", "follow_up")])


GREEDY = """
f AS (SELECT g, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ue, CAST([] AS BIGINT[]) AS uo, 0e0 AS s FROM (SELECT DISTINCT g FROM od)
  UNION ALL SELECT f.g, od.k, CASE WHEN list_contains(ue, e) OR list_contains(uo, o) THEN ue ELSE list_append(ue, e) END, CASE WHEN list_contains(ue, e) OR list_contains(uo, o) THEN uo ELSE list_append(uo, o) END,
    CASE WHEN list_contains(ue, e) OR list_contains(uo, o) THEN s ELSE s + score END FROM f JOIN od ON od.g = f.g AND od.k = f.k + 1),
gm AS (SELECT g, arg_max(len(ue), k) AS matched, arg_max(s, k) AS total FROM f GROUP BY 1)
"""


@query("d5_peak_set_similarity", "WITH RECURSIVE " + WIDE.split(",\nwd AS")[0] + f"""
, p AS (SELECT sample_base, preparation, peak_index, two_theta AS t, d, relative_intensity AS i, fwhm AS w FROM pk LEFT JOIN fw USING (curve_id, idx)),
q AS (SELECT a.sample_base AS g, a.peak_index AS e, b.peak_index AS o, abs(a.t - b.t) AS dt, abs(a.d - b.d) AS dd, abs(a.i - b.i) / greatest(a.i, b.i, 1) AS ri, abs(a.w - b.w) / CASE WHEN a.w IS NOT NULL AND b.w IS NOT NULL THEN greatest(a.w, b.w, 1) END AS rw
  FROM p a JOIN p b ON a.sample_base = b.sample_base AND a.preparation = 'natural' AND b.preparation = 'glicolado' WHERE abs(a.t - b.t) <= 0.15 OR abs(a.d - b.d) <= 0.1),
sc AS (SELECT g, e, o, (0.6e0 * greatest(CASE WHEN dt <= 0.15 THEN 1 - dt / 0.15e0 ELSE -1 END, CASE WHEN dd <= 0.1 THEN 1 - dd / 0.1e0 ELSE -1 END) + 0.25e0 * greatest(0, 1 - ri / 0.5e0) + CASE WHEN rw IS NULL THEN 0 ELSE 0.1e0 * greatest(0, 1 - rw / 0.75e0) END)
   / (0.85e0 + CASE WHEN rw IS NULL THEN 0 ELSE 0.1e0 END) AS score FROM q),
od AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY e, score DESC, o) AS k FROM sc), {GREEDY},
n AS (SELECT sample_base AS g, count(*) FILTER (preparation = 'natural') AS l, count(*) FILTER (preparation = 'glicolado') AS r FROM pk GROUP BY 1)
SELECT n.g AS sample_base, l AS left_peaks, r AS right_peaks, coalesce(matched, 0) AS matched, coalesce(round(matched / CAST(l AS DOUBLE) * (total / matched), 4), 0) AS score FROM n LEFT JOIN gm USING (g) WHERE l > 0 AND r > 0""")
def d5(spark, d):
    f = S.with_shapes(found(spark, d))
    a = f.where("preparation = 'natural'").select("sample_base", M.peak_set(f).alias("l"))
    b = f.where("preparation = 'glicolado'").select("sample_base", M.peak_set(f).alias("r"))
    j = a.join(b, "sample_base").withColumn("s", M.peak_set_similarity(F.col("l"), F.col("r")))
    return j.select("sample_base", F.size("l").alias("left_peaks"), F.size("r").alias("right_peaks"), "s.matched", "s.score")
