"""Numeric helpers, bands and hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def rounded(value, digits: int) -> Column:
    """``F.round`` of a double; what is not negative and has its digits to spare is rounded in doubles, without a decimal number per row."""
    v, scale = _c(value), 10.0 ** digits
    return F.when((v >= 0) & (v < 2.0 ** 50 / scale), F.floor(v * scale + 0.5) / scale).otherwise(F.round(v, digits))


def numeric_similarity(left, right, scale=None, digits=4) -> Column:
    """1 - |a-b|/scale, floored at 0; 0 when a value is missing."""
    a, b = _c(left).cast("double"), _c(right).cast("double")
    span = F.lit(abs(float(scale))) if scale else F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    sim = F.round(F.lit(1.0) - F.least(F.abs(a - b) / span, F.lit(1.0)), digits)
    return F.coalesce(sim, F.lit(0.0))


def relative_delta(left, right) -> Column:
    """|a-b| over the larger magnitude; null without two values, 0 for two zeros."""
    a, b = _c(left).cast("double"), _c(right).cast("double")
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(top == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.abs(a - b), top))


def clamp01(value) -> Column:
    v = _c(value).cast("double")
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def to_percent_of(value, maximum) -> Column:
    v, m = _c(value).cast("double"), _c(maximum).cast("double")
    return F.when(m > 0, F.greatest(v, F.lit(0.0)) / m * 100).otherwise(F.lit(0.0))


def band(value, steps, otherwise) -> Column:
    """First label whose lower bound the value reaches; steps ordered high to low."""
    v, out = _c(value), None
    for lower, label in steps:
        out = F.when(v >= lower, label) if out is None else out.when(v >= lower, label)
    return out.otherwise(otherwise)


# Score bands.
CONFIDENCE_CLASS = ((0.75, "alta"), (0.5, "media"))
CURATION_STATUS = ((0.80, "accepted"), (0.60, "provisional"), (0.40, "needs_review"))
MIXED_LAYER_STATUS = ((0.8, "probable"), (0.6, "possible"))


def confidence_class(value) -> Column:
    return band(value, CONFIDENCE_CLASS, "baixa")


def curation_status(score) -> Column:
    return band(score, CURATION_STATUS, "rejected")


def mixed_layer_status(score) -> Column:
    return F.when(_c(score) <= 0, "rejected").otherwise(band(score, MIXED_LAYER_STATUS, "ambiguous"))


def rule_level(score) -> Column:
    """Level of a 0-100 rule score."""
    s = _c(score)
    return F.when(s <= 40, "possible_by_rules").when(s <= 70, "probable_by_rules").otherwise("confirmed_by_rules")


def group_confidence(score, complete_trio) -> Column:
    s = _c(score)
    return (F.when((s >= 0.78) & _c(complete_trio), "alta").when(s >= 0.58, "media")
            .when(s >= 0.35, "baixa/media").otherwise("baixa"))


def candidate_status(score, provisional=None, ambiguous=None) -> Column:
    s = _c(score)
    prov = F.lit(False) if provisional is None else _c(provisional)
    amb = F.lit(False) if ambiguous is None else _c(ambiguous)
    return (F.when(amb, "ambíguo")
            .when(prov & (s >= 0.4), "provisório").when(prov, "possível")
            .when(s >= 0.60, "provável").when(s >= 0.40, "possível").otherwise("descartado"))


def analogy_class(score_total, confidence, supported) -> Column:
    s, c, n = _c(score_total), _c(confidence), _c(supported)
    return (F.when((s >= 0.72) & (c >= 0.72) & (n >= 3), "confirmada")
            .when((s >= 0.5) & (c >= 0.5) & (n >= 2), "provavel")
            .otherwise("exploratoria"))


def abundance_class(score, treatments) -> Column:
    s = _c(score)
    return (F.when((s >= 0.75) & (_c(treatments) >= 2), "dominante/maior").when(s >= 0.55, "maior")
            .when(s >= 0.30, "subordinado").when(s.isNotNull(), "traço").otherwise("indeterminado"))


def payload_hash(*columns) -> Column:
    """SHA-256 of the JSON of the columns, in the order given."""
    return F.sha2(F.to_json(F.struct(*[_c(c) for c in columns])), 256)


def stable_hash(*columns) -> Column:
    """SHA-256 of the texts of the columns joined by ``|`` (nulls as empty text)."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in columns]), 256)
