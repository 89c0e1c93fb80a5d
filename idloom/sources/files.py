"""File sources and sinks: templates with precedence, manifests, images, profiles, and the streams they arrive as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idloom.sources.sinks import Files, VersionedTable, save_file

TEMPLATE = "id string, document_kind string, version int, width int, height int, updated_at string, zones array<struct<id:string,label:string,role:string,content:string,x:double,y:double,w:double,h:double>>, ignored array<struct<x:double,y:double,w:double,h:double>>, parameters map<string,double>"
EXPORT = "id string, width int, height int, descriptors struct<rows:int,cols:int,data:array<int>>, keypoints array<struct<x:double,y:double>>, zones array<struct<id:string,label:string,x:double,y:double,w:double,h:double>>"
CASE = "id string, document_kind string, image string, expected string, fields map<string,string>"


def templates(spark: SparkSession, *folders: str) -> DataFrame:
    """One row for each template name found in the folders' JSON files; an earlier folder wins. An exported template of
    the first version, which has neither kind nor version, is read as version 1 of its id's document."""
    parts = [spark.read.schema(TEMPLATE).option("multiLine", True).option("pathGlobFilter", "*.json").json(f).withColumn("_rank", F.lit(i)) for i, f in enumerate(folders)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumns({"document_kind": F.coalesce("document_kind", F.regexp_replace("id", "-(front|back|single)$", "")), "version": F.coalesce("version", F.lit(1))})
    return _first_folder(rows.where("id IS NOT NULL"), "id")


def _first_folder(rows: DataFrame, key: str) -> DataFrame:
    best = Window.partitionBy(key).orderBy("_rank")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_rank")


def delete_templates(saved: DataFrame, bundled: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(saved templates that remain, ids that are refused): bundled templates can't be deleted, only what was saved over
    them."""
    return saved.join(ids.select("id"), "id", "left_anti"), ids.select("id").join(saved.select("id"), "id", "left_anti").join(bundled.select("id"), "id", "left_semi")


def variants(rows: DataFrame, base: str) -> DataFrame:
    """The template itself and those named after it."""
    return rows.where((F.col("id") == base) | F.col("id").startswith(f"{base}-"))


def template_list(rows: DataFrame) -> DataFrame:
    """A summary of each template, the last changed first."""
    return rows.select("id", "document_kind", "version", F.size("zones").alias("zones"), F.size("ignored").alias("ignored"), *([F.size("keypoints").alias("keypoints")] if "keypoints" in rows.columns else []), "updated_at").orderBy(F.col("updated_at").desc_nulls_last(), "id")


def import_exports(exports: DataFrame) -> DataFrame:
    """Exported templates with what is wrong with them: the descriptors' size, keypoints that don't match, zones out of
    bounds or named twice. The document's kind is the id without its side."""
    d = F.col("descriptors")
    inside = F.forall("zones", lambda z: (z["x"] >= 0) & (z["y"] >= 0) & (z["w"] > 0) & (z["h"] > 0) & (z["x"] + z["w"] <= 1) & (z["y"] + z["h"] <= 1))
    ids, labels = F.transform("zones", lambda z: z["id"]), F.array_compact(F.transform("zones", lambda z: z["label"]))
    checks = {"descriptor_size": d["rows"] * d["cols"] != F.size(d["data"]), "keypoints": d["rows"] != F.size("keypoints"), "byte_range": ~F.forall(d["data"], lambda b: b.between(0, 255)), "zone_bounds": ~inside, "zone_names": (F.size(F.array_distinct(ids)) != F.size(ids)) | (F.size(F.array_distinct(labels)) != F.size(labels))}
    problems = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(True)), F.lit(k)) for k, v in checks.items()]))
    return exports.withColumns({"document_kind": F.regexp_replace("id", "-(front|back|single)$", ""), "problems": problems})


def descriptors(exports: DataFrame) -> DataFrame:
    """(template_id, idx, x, y, descriptor) of each keypoint of valid exports."""
    ok = import_exports(exports).where(F.size("problems") == 0)
    each = ok.select(F.col("id").alias("template_id"), "descriptors", F.posexplode("keypoints").alias("idx", "k"))
    cols = F.col("descriptors.cols")
    own = F.slice("descriptors.data", F.col("idx") * cols + 1, cols)
    return each.select("template_id", "idx", "k.x", "k.y", F.unhex(F.array_join(F.transform(own, lambda b: F.lpad(F.hex(b.cast("long")), 2, "0")), "")).alias("descriptor"))


def benchmark_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, ids that occur more than once) of a JSON list."""
    cases = spark.read.schema(CASE).option("multiLine", True).json(path)
    return cases, cases.groupBy("id").count().where("count > 1").select("id")


def images(spark: SparkSession, *folders: str, glob: str = "*") -> DataFrame:
    """(name, modified, bytes) of stored objects; of equal names the first folder's counts."""
    parts = [spark.read.format("binaryFile").option("pathGlobFilter", glob).load(f).withColumn("_rank", F.lit(i)) for i, f in enumerate(folders)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("modificationTime").alias("modified"), F.col("content").alias("bytes"), "_rank")
    return rows.drop("_rank") if len(folders) == 1 else _first_folder(rows, "name")


def require_object(objects: DataFrame, name: str) -> DataFrame:
    """The row of one stored object; reading it raises an error if there is none."""
    found = objects.where(F.col("name") == name).agg(F.count("*").alias("n"), F.min(F.struct("name", "modified", "bytes")).alias("o"))
    there = F.when(F.col("n") > 0, F.col("o")).otherwise(F.raise_error(F.lit(f"no object {name}")))
    return found.select(there.alias("o")).select("o.*")


# The first bytes of images, as hexadecimal digits (any digit where a dot stands).
_SIGNATURES = {"image/jpeg": "^FFD8FF", "image/png": "^89504E470D0A1A0A", "image/webp": "^52494646.{8}57454250", "image/heic": "^.{8}66747970(68656963|68656978|6D696631)"}


def media_type(content: Column) -> Column:
    """The type of an image by its first bytes, or null."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for kind, pattern in _SIGNATURES.items():
        out = F.when(head.rlike(pattern), kind).otherwise(out)
    return out


def uploads(spark: SparkSession, folder: str, max_bytes: int = 12 << 20) -> DataFrame:
    """A stream of dropped files with their type by content, and whether each is an image of an allowed size."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    kind = media_type(F.col("content"))
    return rows.select("path", "length", "content", kind.alias("media_type"), (kind.isNotNull() & (F.col("length") <= max_bytes)).alias("accepted"))


def json_stream(spark: SparkSession, folder: str, schema: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)


def ranked_profile(*profiles: DataFrame | None) -> DataFrame:
    """The first of the one-row profiles that has a row: a saved file, then the environment, then the shipped one."""
    parts = [p.withColumn("_rank", F.lit(i)) for i, p in enumerate(profiles) if p is not None]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.orderBy("_rank").limit(1).drop("_rank")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def save_profile(profiles: DataFrame, path: str, column: str = "profile") -> None:
    """Save a one-row table with a profile's JSON text: refused with its faults if it isn't valid; else written beside the
    old one and put in its place by one rename, so readers see one or the other."""
    _refuse_faults(profiles.select(column), column)
    save_file(profiles, path)


def load_profile(spark: SparkSession, path: str, shipped: DataFrame, column: str = "profile") -> DataFrame:
    """The saved profile, refused with its faults if it isn't valid; ``shipped`` where none was saved."""
    files = Files(spark, path)
    rows = spark.read.schema(shipped.schema).parquet(path) if files.files.exists(files.root) else shipped
    _refuse_faults(rows.select(column), column)
    return rows


def _refuse_faults(profiles: DataFrame, column: str) -> None:
    from idloom.operators.quality import profile_faults

    found = profiles.select(profile_faults(F.col(column)).alias("faults")).first()
    if found is None or found["faults"]:
        raise ValueError(f"invalid profile: {', '.join(found['faults']) if found else 'no row'}")


def replace_table(rows: DataFrame, path: str) -> int:
    """Put ``rows`` in the place of a table's, as its next version (see ``sinks``)."""
    return VersionedTable(rows.sparkSession, path).replace(rows)
