"""Readers: text curves, inventories, JSON documents, reference lines, patterns, pages.

Text curves and structure files are read whole, one row per file, because a
file is one bounded measurement and the order of its lines matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xrdlake.functions import series as S
from xrdlake.functions.geometry import bragg_d, bragg_two_theta
from xrdlake.functions.text import blank_to_null, curve_number, infer_treatment, lookup_key, mineral_slug, sample_base
from xrdlake.operators.curves import MIN_POINTS

CURVE_GLOB = "*.{csv,txt,xy,dat}"
SNAPSHOT_PREFIX = "snapshot:"


def parse_text_curves(files: DataFrame, text: str = "value") -> DataFrame:
    """Curve arrays and metadata of text files (one row per file).

    The first two numbers of a line are a point; comment lines and lines with
    fewer numbers count as skipped. A file with fewer than ten points or an axis
    that does not rise gets ``status = 'erro'`` and a reason instead of failing.
    """
    lines = F.split(F.regexp_replace(F.rtrim(F.col(text)), r"[\r\n]+$", ""), "\r\n|\n|\r")

    def point(line):
        nums = F.filter(F.transform(F.split(F.trim(line), "[;\t, ]+"), curve_number), lambda v: v.isNotNull())
        skip = F.trim(line).rlike("^(#|//|;)")
        return F.struct(F.when(~skip, F.get(nums, 0)).alias("x"), F.when(~skip, F.get(nums, 1)).alias("y"))
    f = files.withColumn("_all", F.transform(lines, point)).withColumn("_p", F.filter("_all", lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    x = F.transform("_p", lambda p: F.round(p["x"], 6))
    f = f.withColumn("two_theta", x).withColumn("intensity", F.transform("_p", lambda p: F.round(p["y"], 6)))
    rising = F.forall(S.indices(F.col("two_theta")), lambda i: (i == 0) | (S.at(F.col("two_theta"), i - 1) < S.at(F.col("two_theta"), i)))
    error = F.when(F.size("_p") < MIN_POINTS, "too_few_points").when(~rising, "axis_not_increasing")
    steps = S.let(F.array_sort(S.differences(F.col("two_theta"))), lambda s: S.at(s, F.floor(F.size(s) / 2).cast("int")))
    f = f.withColumn("points", F.size("_p")).withColumn("skipped_rows", F.size("_all") - F.size("_p")).withColumn("error", error)
    f = f.withColumn("status", F.when(F.col("error").isNull(), "importado").otherwise("erro"))
    return f.withColumn("step", F.round(steps, 8)).withColumn("two_theta_start", F.get("two_theta", 0)).withColumn(
        "two_theta_end", S.at(F.col("two_theta"), F.size("two_theta") - 1)).drop("_all", "_p")


def read_text_curves(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Text curve files below ``path``: file name, arrays, metadata, status."""
    r = spark.read
    r = r.option("pathGlobFilter", glob) if glob else r
    return parse_text_curves(r.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.col("_metadata.file_path")))


#: Columns of a container of small files (``sinks.pack_files``).
CONTAINER = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


#: Bytes of text that one task parses, on average.
PARSED_BYTES = 16 << 20


def raw_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, length, content`` of single files below ``path``, to be packed."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    r = r.option("pathGlobFilter", glob) if glob else r
    return r.load(path).select(*CONTAINER.fieldNames())


def packed_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, content`` of all files in containers; a filter on ``path`` is pushed to their footers."""
    return spark.read.schema(CONTAINER).parquet(path)


def read_packed_curves(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_text_curves``, from containers."""
    files = packed_files(spark, path)
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # a container is a split or two: its files are dealt out, so that parsing uses all cores
    files = files.repartition(max(spark.sparkContext.defaultParallelism, -(-total // PARSED_BYTES)))
    return parse_text_curves(files.select("path", F.col("content").cast("string").alias("value")))


def snapshot_id(path: Column) -> Column:
    """Stable id of a path."""
    return F.concat(F.lit(SNAPSHOT_PREFIX), F.substring(F.sha2(path, 256), 1, 20))


def file_inventory(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Path, size, hash, stable id, treatment and sample base of every file."""
    return inventory(raw_files(spark, path, glob))


def inventory(files: DataFrame) -> DataFrame:
    """The inventory of ``path, length, content`` rows, single files or packed ones."""
    f = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    return f.withColumn("file_id", snapshot_id(F.col("path"))).withColumn("treatment", infer_treatment("path")["treatment"]).withColumn("sample_base", sample_base("path"))


def read_documents(spark: SparkSession, path: str, schema: T.StructType, items: str, multiline: bool = False) -> DataFrame:
    """JSON documents that hold an array of rows, exploded (snapshots, manifests)."""
    docs = spark.read.schema(schema).option("multiLine", multiline).json(path)
    keep = [f.name for f in schema.fields if f.name != items]
    return docs.select(*keep, F.explode_outer(items).alias("item")).select(*keep, "item.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; lines that do not parse are dropped."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(full).option("mode", "PERMISSIVE").json(path)
    return raw.where("_corrupt_record IS NULL").drop("_corrupt_record")


def reference_lines(texts: DataFrame, key: str, text: str, limit: int | None = None, wavelength: float = 1.5406) -> DataFrame:
    """Lines of reference patterns: a first number of 20 or more is an angle, else a spacing."""
    rows = F.transform(F.split(F.col(text), "\r\n|\n"), lambda ln: S.let(
        F.filter(F.transform(F.split(F.trim(ln), "[;\t, ]+"), curve_number), lambda v: v.isNotNull()), lambda n: F.struct(
            F.get(n, 0).alias("v"), F.get(n, 1).alias("i"), F.trim(ln).rlike("^(#|//|;)").alias("skip"))))
    rows = F.filter(rows, lambda p: p["v"].isNotNull() & (p["v"] > 0) & p["i"].isNotNull() & ~p["skip"])
    rows = rows if limit is None else F.slice(rows, 1, limit)
    p = S.unnest_pos(texts, (key,), rows, "line_index", "p")
    angle = F.col("p.v") >= 20
    return p.select(
        key, "line_index", F.when(angle, F.col("p.v")).otherwise(bragg_two_theta("p.v", wavelength)).alias("two_theta"),
        F.when(angle, bragg_d("p.v", wavelength)).otherwise(F.col("p.v")).alias("d"), F.col("p.i").alias("intensity"))


def open_patterns(sources: dict[str, DataFrame], vocabulary: DataFrame) -> DataFrame:
    """Patterns of several sources under one contract, joined to the vocabulary by slug.

    Every source: external_id, file_name or mineral, data_kind. A name that is
    only in the file name is its part before the first double underscore.
    """
    parts = None
    for name, df in sources.items():
        named = df if "mineral" in df.columns else df.withColumn("mineral", F.replace(F.regexp_extract(F.element_at(F.split("file_name", "/"), -1), r"^(.*?)__", 1), F.lit("_"), F.lit(" ")))
        one = named.select("external_id", "mineral", "data_kind", F.lit(name).alias("source"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.withColumn("slug", mineral_slug("mineral")).join(vocabulary.select("slug", "term_id"), "slug", "left")


# Fields of a structure file.
STRUCTURE_FIELDS = {
    "mineral": r"(?m)^_chemical_name_mineral\s+'?([^'\n]+?)'?\s*$", "formula": r"(?m)^_chemical_formula_sum\s+'?([^'\n]+?)'?\s*$",
    "space_group": r"(?m)^_(?:symmetry_)?space_group_name_H-M(?:_alt)?\s+'?([^'\n]+?)'?\s*$", "cell_a": r"(?m)^_cell_length_a\s+([0-9.]+)",
    "cell_c": r"(?m)^_cell_length_c\s+([0-9.]+)", "database_code": r"(?m)^_cod_database_code\s+(\d+)",
}


def structure_metadata(files: DataFrame, text: str = "value") -> DataFrame:
    """Name, formula, space group, cell and database code of structure files."""
    out = files
    for name, pattern in STRUCTURE_FIELDS.items():
        v = blank_to_null(F.regexp_extract(F.col(text), pattern, 1))
        out = out.withColumn(name, v.try_cast("double") if name.startswith("cell") else v)
    return out.drop(text)


def reference_index(manifests: dict[str, DataFrame], caps: dict[str, int] | None = None) -> DataFrame:
    """Reference lines of several manifests, rescaled to 0-100 and ranked per pattern, with a search key.

    ``caps`` may name a number of lines per pattern and source; all stay without it.
    Patterns are small, so the window runs inside one pattern.
    """
    from pyspark.sql import Window as W

    u = None
    for name, df in manifests.items():
        one = df.select("reference_id", "mineral", "line_index", "two_theta", "intensity", F.lit(name).alias("source"), F.lit((caps or {}).get(name)).cast("int").alias("cap"))
        u = one if u is None else u.unionByName(one)
    w = W.partitionBy("source", "reference_id")
    u = u.withColumn("top", F.max("intensity").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("intensity"), "line_index")))
    u = u.where("cap IS NULL OR rank <= cap").withColumn("relative_intensity", F.when(F.col("top") > 0, F.col("intensity") / F.col("top") * 100).otherwise(F.lit(0.0)))
    return u.withColumn("search_key", lookup_key(F.concat_ws(" ", "source", "mineral"))).drop("top", "cap")


def page_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Language, title, heading and number of links of web pages."""
    get = lambda p: blank_to_null(F.regexp_extract(F.col(html), p, 1))
    return pages.select(
        "page_id", get(r'(?is)<html[^>]*\blang="([a-z]+)"').alias("lang"), get(r"(?is)<title>([^<]*)</title>").alias("title"), get(r"(?is)<h1>([^<]*)</h1>").alias("heading"),
        F.size(F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\s+href="), 0)).alias("links"))


def label_facts(pages: DataFrame, labels: dict[str, str], lists: tuple[str, ...] = (), key: str = "page_id", html: str = "html") -> DataFrame:
    """What pages say after the given labels, the first mention of each; ``labels`` maps column names to label texts.

    A label is followed by a colon, a dash or the end of its element, then perhaps by tags, and its value runs to the next tag or line.
    All labels are found in one pass over the page. Columns in ``lists`` are cut at commas and semicolons.
    """
    pattern = F.lit(r"(?i)\b(" + "|".join(labels.values()) + r")\s*(?:[:\-]|</[^>]+>)[\s:\-]*(?:<[^>]+>\s*)*([^<\r\n]+)")
    found = pages.select(key, F.arrays_zip(F.transform(F.regexp_extract_all(html, pattern, 1), lambda x: F.lower(x)).alias("label"), F.regexp_extract_all(html, pattern, 2).alias("value")).alias("f"))

    def value(label):
        return blank_to_null(F.get(F.filter("f", lambda p: p["label"] == label.lower()), 0)["value"])

    def members(v):
        return F.array_distinct(F.filter(F.transform(F.split(v, "[;,]"), lambda x: F.trim(x)), lambda x: x != ""))
    return found.select(key, *[(members(value(text)) if name in lists else value(text)).alias(name) for name, text in labels.items()])


GEOJSON = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.StructType([T.StructField("process", T.StringType()), T.StructField("mineral", T.StringType())])),
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))]))])))])


def area_features(docs: DataFrame, text: str, areas: DataFrame) -> DataFrame:
    """Features of GeoJSON documents joined to the areas by process, one per process and mineral."""
    f = docs.select(F.explode(F.from_json(F.col(text), GEOJSON)["features"]).alias("f"))
    f = f.select(F.col("f.properties.process").alias("process"), lookup_key("f.properties.mineral").alias("mineral_key"), F.to_json("f.geometry").alias("geometry"))
    one = f.groupBy("process", "mineral_key").agg(F.min("geometry").alias("geometry"))
    return one.join(areas, "process")


def upload_manifest(files: DataFrame, analyses: DataFrame, extensions: str = "raw|csv|txt|xy|dat") -> DataFrame:
    """Curve files of a record joined to its declared diffraction analyses by file name."""
    f = files.where(F.lower("file_name").rlike(rf"\.({extensions})$"))
    a = analyses.where(F.lower("method").rlike("xrd|drx|difra")).select("record_id", "file_name", "analysis_id", "sample_code")
    j = f.join(a, ["record_id", "file_name"], "left")
    return j.withColumn("preparation", infer_treatment("file_name")["treatment"]).withColumn("sample_code", F.coalesce("sample_code", sample_base("file_name")))


def import_log(parsed: DataFrame) -> DataFrame:
    """One row per imported curve, or per failed import with its reason."""
    ok = F.col("status") == "importado"
    return parsed.select(
        "path", "status", "error", F.when(ok, F.col("points")).alias("points"), F.when(ok, F.col("two_theta_start")).alias("two_theta_start"),
        F.when(ok, F.col("two_theta_end")).alias("two_theta_end"), F.sha2("value", 256).alias("sha256"))


def load_vocabulary(manifest: DataFrame, extra: DataFrame) -> DataFrame:
    """Terms of two reads under one contract with one row per query name.

    Both: term_id, title, aliases, display_only. Display-only labels give no
    query name; the first spelling per folded key stays.
    """
    u = manifest.unionByName(extra)
    names = u.select("term_id", "display_only", F.posexplode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "name"))
    names = names.where(~F.coalesce("display_only", F.lit(False)) | (F.col("pos") > 0)).withColumn("key", lookup_key("name")).where("key IS NOT NULL")
    return names.groupBy("term_id", "key").agg(F.min_by("name", "pos").alias("name"))
