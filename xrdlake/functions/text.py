"""Text normalisation, names, keys and validators as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_map() -> tuple[str, str]:
    """Latin letters whose decomposition starts with one ASCII letter."""
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(code))
        plain = "".join(ch for ch in base if not unicodedata.combining(ch))
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            src.append(chr(code))
            dst.append(plain)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_map()
COMBINING_MARKS = r"[̀-ͯ]"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def three_digits(value) -> Column:
    """Text of a number from 0 below 2^53 with three digits, as C's ``%.3f`` has it: rounded from the exact binary value, exact halves to even.

    ``format_string`` rounds the shortest decimal text of the number and puts its halves up.
    """
    from xrdlake.functions.series import let

    v = _c(value)
    whole = F.floor(v)
    # the fraction in units of 2^-63, times 1000, as two words of 64 and 32 bits
    units = ((v - whole) * float(2 ** 63)).cast("long")
    words = let(units, lambda n: let(F.struct((F.shiftright(n, 32) * 1000 + F.shiftright(n.bitwiseAND(F.lit(0xFFFFFFFF)) * 1000, 32)).alias("high"), (n.bitwiseAND(F.lit(0xFFFFFFFF)) * 1000).bitwiseAND(F.lit(0xFFFFFFFF)).alias("low")), lambda w: F.struct(
        F.shiftright(w["high"], 31).alias("q"), F.shiftleft(w["high"].bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(w["low"]).alias("rest"))))
    half = F.lit(2 ** 62)
    up = lambda w: (w["rest"] > half) | ((w["rest"] == half) & (w["q"] % 2 == 1))
    return let(let(words, lambda w: whole * 1000 + w["q"] + F.when(up(w), 1).otherwise(0)), lambda k: F.concat(
        F.floor(k / 1000).cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0")))


def blank_to_null(text) -> Column:
    return F.nullif(F.trim(_c(text)), F.lit(""))


def fold_accents(text) -> Column:
    return F.regexp_replace(F.translate(_c(text), ACCENTED, PLAIN), COMBINING_MARKS, "")


def lookup_key(text, folded: bool = False) -> Column:
    """Accent-free lower-case words separated by one space; null when empty. ``folded``: accents are gone already."""
    t = F.lower(_c(text) if folded else fold_accents(text))
    t = F.replace(t, F.lit("ß"), F.lit("ss"))
    return blank_to_null(F.regexp_replace(t, "[^a-z0-9]+", " "))


def ascii_key(text, folded: bool = False) -> Column:
    """Like :func:`lookup_key`, but letters outside ASCII vanish instead of splitting words."""
    t = F.regexp_replace(_c(text) if folded else fold_accents(text), r"[^\x00-\x7F]", "")
    return blank_to_null(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))


def mineral_name_key(text, folded: bool = False) -> Column:
    """Name key that keeps ``+`` and drops apostrophes without splitting."""
    t = F.regexp_replace(_c(text) if folded else fold_accents(text), r"[^\x00-\x7F]", "")
    t = F.regexp_replace(t, "['`]", "")
    t = F.regexp_replace(t, "[^A-Za-z0-9+]+", " ")
    return blank_to_null(F.lower(t))


def mineral_slug(text, folded: bool = False) -> Column:
    return F.replace(mineral_name_key(text, folded), F.lit(" "), F.lit("_"))


def url_slug(text) -> Column:
    t = F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "-")
    return F.regexp_replace(t, "^-+|-+$", "")


def parse_number(text) -> Column:
    """Lenient number: percent sign dropped, decimal comma read, anything else null."""
    t = F.replace(F.replace(F.trim(_c(text)), F.lit("%"), F.lit("")), F.lit(","), F.lit("."))
    v = t.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def finite(value) -> Column:
    v = _c(value).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


# Characters around a number of a text curve that are no part of it.
NUMBER_QUOTES = "[\\uFEFF\"']"
NUMBER_STRAYS = r"[^0-9eE+\-.]"


def curve_number(token) -> Column:
    """Number of a text curve: a decimal comma counts unless the token has a point too; null where none is left."""
    bare = F.regexp_replace(F.trim(_c(token)), NUMBER_QUOTES, "")
    pointed = F.when(F.instr(bare, ".") > 0, bare).otherwise(F.translate(bare, ",", "."))
    return finite(F.regexp_replace(pointed, NUMBER_STRAYS, "").try_cast("double"))


# Ordered name patterns that tell the treatment of a measurement; the code says what kind of mark was seen.
TREATMENT_PATTERNS = (
    (r"\(\s*N\s*\)(?:\.RAW)?(?:$|[\s._-])", "natural", "bracketed_letter"),
    (r"\(\s*G\s*\)(?:\.RAW)?(?:$|[\s._-])", "glicolado", "bracketed_letter"),
    (r"\(\s*C\s*\)(?:\.RAW)?(?:$|[\s._-])", "calcinado", "bracketed_letter"),
    (r"(?:^|[\s._-])N(?:\.RAW)?(?:$|[\s._-])", "natural", "separate_letter"),
    (r"(?:^|[\s._-])G(?:\.RAW)?(?:$|[\s._-])", "glicolado", "separate_letter"),
    (r"(?:^|[\s._-])C(?:\.RAW)?(?:$|[\s._-])", "calcinado", "separate_letter"),
    (r"(?:CAL|CALC|CALCIN|AQUEC|HEAT|550|500|350|300)", "calcinado", "heating_word"),
    (r"N(?:\.RAW)?$", "natural", "last_letter"),
    (r"G(?:\.RAW)?$", "glicolado", "last_letter"),
    (r"C(?:\.RAW)?$", "calcinado", "last_letter"),
)


def infer_treatment(*names) -> Column:
    """Struct(treatment, confidence, evidence) from file names and sample codes."""
    text = F.upper(F.concat_ws(" ", *[F.trim(_c(n)) for n in names]))

    def answer(treatment, confidence, why):
        return F.struct(F.lit(treatment).alias("treatment"), F.lit(confidence).alias("confidence"), F.lit(why).alias("evidence"))
    out = None
    for pattern, treatment, why in TREATMENT_PATTERNS:
        row = answer(treatment, "alta", why)
        out = F.when(text.rlike(pattern), row) if out is None else out.when(text.rlike(pattern), row)
    return out.otherwise(answer("indeterminado", "baixa", "none"))


# Treatment words that may end a sample name.
TREATMENT_SUFFIX = r"(?i)[\s._-]*\(?\b(N|G|C|NAT|NATURAL|GLY|GLICOL|GLICOLADA|CAL|CALC|CALCINADA)\b\)?$"


def basename(path) -> Column:
    return F.element_at(F.split(F.replace(_c(path), F.lit("\\"), F.lit("/")), "/"), -1)


def stem(path) -> Column:
    return F.regexp_replace(basename(path), r"\.[A-Za-z0-9]+$", "")


def sample_base(*names) -> Column:
    """Sample name without folder, extension and treatment suffix."""
    raw = F.coalesce(*[blank_to_null(stem(n)) for n in names], F.lit(""))
    base = F.trim(F.regexp_replace(F.regexp_replace(raw, TREATMENT_SUFFIX, ""), r"\s+", " "))
    return F.when(base != "", base).otherwise(raw)


def path_key(path) -> Column:
    t = F.replace(F.lower(F.trim(_c(path))), F.lit("\\"), F.lit("/"))
    t = F.regexp_replace(t, "^[a-z]:/", "")
    t = F.regexp_replace(t, r"\.(raw|csv|dat|json)$", "")
    return blank_to_null(F.regexp_replace(t, "[^a-z0-9]+", " "))


# Folder names after which the rest of a path identifies a curve.
PATH_MARKERS = ("raw-classificados", "raw", "data")


def lookup_variants(path) -> Column:
    """Distinct keys under which a path or name may be found."""
    p = F.replace(F.trim(_c(path)), F.lit("\\"), F.lit("/"))
    suffixes = [path_key(F.regexp_extract(p, f"(?:^|/){m}/(.+)$", 1)) for m in PATH_MARKERS]
    return F.array_distinct(F.array_compact(F.array(path_key(p), path_key(basename(p)), *suffixes)))


def tokens(text, min_length=3) -> Column:
    """Distinct words of the key of at least ``min_length`` letters."""
    words = F.split(F.coalesce(ascii_key(text), F.lit("")), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= min_length))


def jaccard(left, right, digits=4) -> Column:
    """Shared over all elements of two arrays; 0 when either is empty."""
    left, right = _c(left), _c(right)
    shared = F.size(F.array_intersect(left, right))
    union = F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        F.round(shared / union, digits))


def split_terms(text, separators=r"[;,/|\n]+") -> Column:
    """Distinct list items, first spelling per key, ordered by key."""
    parts = F.transform(F.split(_c(text), separators), lambda p: F.struct(
        ascii_key(p).alias("k"), F.trim(p).alias("v")))
    parts = F.filter(parts, lambda p: p["k"].isNotNull())
    first = F.aggregate(
        parts, F.expr("cast(array() as array<struct<k:string,v:string>>)"),
        lambda acc, p: F.when(F.exists(acc, lambda a: a["k"] == p["k"]), acc).otherwise(
            F.array_append(acc, p)))
    return F.transform(F.array_sort(first), lambda p: p["v"])


def unique_texts(values) -> Column:
    """First spelling per folded key, in order of appearance."""
    parts = F.transform(_c(values), lambda v: F.struct(lookup_key(v).alias("k"), F.trim(v).alias("v")))
    parts = F.filter(parts, lambda p: p["k"].isNotNull())
    kept = F.aggregate(
        parts, F.expr("cast(array() as array<struct<k:string,v:string>>)"),
        lambda acc, p: F.when(F.exists(acc, lambda a: a["k"] == p["k"]), acc).otherwise(
            F.array_append(acc, p)))
    return F.transform(kept, lambda p: p["v"])


def formula_elements(formula) -> Column:
    """Distinct element symbols of a formula, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(formula), F.lit("([A-Z][a-z]?)"), 1)))


def formula_compatible(left, right) -> Column:
    """Shared elements are at least 60 % of the longer list; null when one is empty."""
    l, r = formula_elements(left), formula_elements(right)
    longer = F.greatest(F.size(l), F.size(r))
    return F.when((F.size(l) > 0) & (F.size(r) > 0), F.size(F.array_intersect(l, r)) / longer >= 0.6)


def is_iso_date(text) -> Column:
    """Blank or a real calendar date written YYYY-MM-DD."""
    t = _c(text)
    return (t.isNull() | (t == "")
            | (t.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(t, "yyyy-MM-dd").isNotNull()))


def is_year(text) -> Column:
    t = _c(text)
    return t.isNull() | (t == "") | F.trim(t).rlike(r"^\d{4}$")


def is_url(text) -> Column:
    return F.coalesce(F.trim(_c(text)).rlike("^https?://"), F.lit(False))


def is_doi(text) -> Column:
    return F.coalesce(F.trim(_c(text)).rlike(r"^10\.\S+/\S+$"), F.lit(False))


def is_numeric_id(text) -> Column:
    return F.coalesce(_c(text).rlike(r"^[0-9]+$"), F.lit(False))


def external_uri(external_id, prefix, suffix=".html") -> Column:
    return F.when(blank_to_null(external_id).isNotNull(), F.concat(F.lit(prefix), F.trim(_c(external_id)), F.lit(suffix)))


def external_id_of(uri, pattern) -> Column:
    return blank_to_null(F.regexp_extract(F.trim(_c(uri)), pattern, 1))


def flatten_texts(values, separator="\n\n") -> Column:
    """Join the non-blank members of an array of text."""
    return F.array_join(F.filter(_c(values), lambda v: F.trim(v) != ""), separator)


def strip_markup(html) -> Column:
    t = F.regexp_replace(_c(html), r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))
