"""Oxide lists and composition text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from xrdlake.functions.series import let
from xrdlake.functions.text import parse_number

# Oxides of a composition, in reporting order.
OXIDES = ("SiO2", "Al2O3", "Fe2O3", "FeO", "TiO2", "MgO", "CaO", "Na2O", "K2O", "P2O5", "MnO", "LOI", "PF")
MIN_OXIDES = 3


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# Fixed value: an oxide label and the number after it.
NUMBER_AFTER_LABEL = r"(?i)\b(" + "|".join(OXIDES) + r")\b\s*[:=]?\s*(-?\d+(?:[.,]\d+)?)"


def oxides_from_text(text) -> Column:
    """Map oxide -> percent: the first number that follows each oxide named in the text."""
    labels = F.regexp_extract_all(_c(text), F.lit(NUMBER_AFTER_LABEL), 1)
    numbers = F.regexp_extract_all(_c(text), F.lit(NUMBER_AFTER_LABEL), 2)
    pairs = F.zip_with(labels, numbers, lambda k, v: F.struct(F.lower(k).alias("k"), parse_number(v).alias("v")))

    def build(found):
        def first(oxide):
            return F.get(F.filter(found, lambda p: p["k"] == oxide.lower()), F.lit(0))["v"]
        entries = [F.struct(F.lit(ox).alias("key"), first(ox).alias("value")) for ox in OXIDES]
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
    return let(pairs, build)


def oxides(structured, *texts) -> Column:
    """Structured percentages if there are any, else those of the texts; negatives dropped.

    The texts are read one after the other until ``MIN_OXIDES`` oxides are known; what a later one says of an oxide stands.
    """
    structured = _c(structured)
    has = structured.isNotNull() & (F.size(F.map_keys(structured)) > 0)

    def merge(first, second):
        entries = [F.struct(F.lit(ox).alias("key"), F.coalesce(F.try_element_at(second, F.lit(ox)), F.try_element_at(first, F.lit(ox))).alias("value")) for ox in OXIDES]
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))

    known = lambda text: F.coalesce(oxides_from_text(text), F.expr("cast(map() as map<string,double>)"))
    read = known(texts[0])
    for text in texts[1:]:
        more = known(text)
        read = let(read, lambda m: F.when(F.size(F.map_keys(m)) >= MIN_OXIDES, m).otherwise(let(more, lambda s: merge(m, s))))  # noqa: B023
    pick = F.when(has, F.map_filter(structured, lambda k, v: k.isin(*OXIDES) & v.isNotNull() & ~F.isnan(v))).otherwise(read)
    return F.map_filter(pick, lambda k, v: v >= 0)
