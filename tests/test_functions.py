import math

import pytest
from pyspark.sql import functions as F

from xrdlake.functions import geochem, geometry as G, minerals as M, text as T, values as V


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_bragg_round_trip(spark):
    for d in (1.5, 3.34, 7.15, 14.2):
        assert one(spark, G.bragg_d(G.bragg_two_theta(F.lit(d)))) == pytest.approx(d, abs=1e-9)
    assert one(spark, G.bragg_two_theta(F.lit(0.5))) is None
    assert one(spark, G.bragg_two_theta(F.lit(0.0))) is None
    assert one(spark, G.bragg_d(F.lit(0.0))) is None


def test_lattice_spacing(spark):
    assert one(spark, G.cubic_d(F.lit(4.0), F.lit(2), F.lit(0), F.lit(0))) == 2.0
    assert one(spark, G.cubic_d(F.lit(4.0), F.lit(0), F.lit(0), F.lit(0))) is None
    assert one(spark, G.tetragonal_d(F.lit(4.0), F.lit(6.0), F.lit(0), F.lit(0), F.lit(2))) == pytest.approx(3.0)


def test_scherrer(spark):
    expected = 0.9 * 0.15406 / (math.radians(0.2) * math.cos(math.radians(13.0)))
    assert one(spark, G.scherrer_nm(F.lit(0.2), F.lit(26.0))) == pytest.approx(expected)
    assert one(spark, G.scherrer_nm(F.lit(0.0), F.lit(26.0))) is None


@pytest.mark.parametrize("name,kind", [
    ("S1 (N).RAW", "natural"), ("S1-G.raw", "glicolado"), ("S1_C", "calcinado"), ("S1 550", "calcinado"), ("S1", "indeterminado"), ("sampleg", "glicolado")])
def test_treatment_from_name(spark, name, kind):
    assert one(spark, T.infer_treatment(F.lit(name))["treatment"]) == kind


@pytest.mark.parametrize("name,base", [("lab/S1 (N).RAW", "S1"), ("S2-G.raw", "S2"), ("C:\\x\\S3 calcinada.dat", "S3"), ("S4.xy", "S4"), ("N.raw", "N")])
def test_sample_base(spark, name, base):
    assert one(spark, T.sample_base(F.lit(name))) == base


def test_keys(spark):
    assert one(spark, T.lookup_key(F.lit("  Óxido--de Ferro ß "))) == "oxido de ferro ss"
    assert one(spark, T.ascii_key(F.lit("æon Água"))) == "on agua"
    assert one(spark, T.lookup_key(F.lit("---"))) is None
    assert one(spark, T.mineral_slug(F.lit("Montmorillonite-(Na)'s"))) == "montmorillonite_na_s"


@pytest.mark.parametrize("text,value", [("1,5 %", 1.5), ("abc", None), ("", None), ("NaN", None), ("-3", -3.0), ("1e400", None)])
def test_parse_number(spark, text, value):
    assert one(spark, T.parse_number(F.lit(text))) == value


def test_oxides(spark):
    m = one(spark, geochem.oxides_from_text(F.lit("SiO2: 45,2 %; al2o3 = 12.0; K2O -1; sio2 99")))
    assert m == {"SiO2": 45.2, "Al2O3": 12.0, "K2O": -1.0}
    m = one(spark, geochem.oxides(F.create_map(F.lit("SiO2"), F.lit(10.0), F.lit("other"), F.lit(3.0)), F.lit("MgO 4")))
    assert m == {"SiO2": 10.0}


def test_terms_and_overlap(spark):
    assert one(spark, T.split_terms(F.lit("b; Á ,a|c\n\n;"))) == ["Á", "b", "c"]
    a, b = T.tokens(F.lit("red clay red")), T.tokens(F.lit("clay of lake"))
    assert one(spark, T.jaccard(a, b)) == round(1 / 3, 4)
    assert one(spark, T.jaccard(a, T.tokens(F.lit("")))) == 0.0


def test_formula(spark):
    assert one(spark, T.formula_elements(F.lit("Al2Si2O5(OH)4"))) == ["Al", "H", "O", "Si"]
    assert one(spark, T.formula_compatible(F.lit("SiO2"), F.lit("SiAlO4"))) is True
    assert one(spark, T.formula_compatible(F.lit("SiO2"), F.lit(""))) is None


def test_validators(spark):
    assert one(spark, T.is_iso_date(F.lit("2024-02-30"))) is False
    assert one(spark, T.is_iso_date(F.lit("2024-02-29"))) is True
    assert one(spark, T.is_doi(F.lit("10.1/x"))) is True and one(spark, T.is_doi(F.lit("x"))) is False


def test_similarity_and_bands(spark):
    assert one(spark, V.numeric_similarity(F.lit(1.0), F.lit(1.0))) == 1.0
    assert one(spark, V.numeric_similarity(F.lit(None).cast("double"), F.lit(1.0))) == 0.0
    assert [one(spark, V.confidence_class(F.lit(x))) for x in (0.75, 0.5, 0.49)] == ["alta", "media", "baixa"]
    assert [one(spark, V.rule_level(F.lit(x))) for x in (40.0, 70.0, 71.0)] == ["possible_by_rules", "probable_by_rules", "confirmed_by_rules"]


def test_octahedral(spark):
    assert [one(spark, G.octahedral_class(F.lit(x))) for x in (1.495, 1.52, 1.545, 1.6)] == ["dioctahedral", "intermediate", "trioctahedral", "unknown"]


def test_description(spark):
    text = one(spark, M.short_description(F.lit("Ilita"), F.lit("2:1"), F.lit("KAl2"), F.lit("Monoclinic"), F.lit("Grupo da mica")))
    assert text == "Ilita: classe 2:1; fórmula KAl2; sistema cristalino monoclinico; grupo da mica."
    long = one(spark, M.long_description(F.lit("Ilita"), {"uses": F.lit("cerâmica"), "formula": F.lit("KAl2"), "origin": F.lit(" ")}, F.lit("Lab")))
    assert long == "Ilita: fórmula KAl2; usos cerâmica (Lab)."
    assert one(spark, M.short_description(F.lit("Ilita"))) is None


def test_oxides_of_several_texts(spark):
    from xrdlake.functions import geochem

    rows = [("SiO2 50; MgO 2", "MgO 3,5 CaO: 1", None), ("SiO2 1 MgO 2 CaO 3", "SiO2 9", None), (None, None, None), ("", "SiO2 -4", None), ("SiO2 5", "SiO2 6", {"MgO": 7.0})]
    df = spark.createDataFrame(rows, "a string, b string, m map<string,double>")
    got = [x["o"] for x in df.select(geochem.oxides("m", "a", "b").alias("o")).collect()]
    assert got == [{"SiO2": 50.0, "MgO": 3.5, "CaO": 1.0}, {"SiO2": 1.0, "MgO": 2.0, "CaO": 3.0}, {}, {}, {"MgO": 7.0}]
