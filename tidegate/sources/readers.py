"""Reading and writing tables: declared types over text, per-site headers, inventories, key files, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from tidegate.operators.disclose import aggregate_only


def scan(df: DataFrame, columns: list[str], ids: DataFrame | None = None, key: str = "entity_id") -> DataFrame:
    """Some columns, of some entities if ids are given. Spark picks the join by the ids' size."""
    out = df.select(*columns)
    return out if ids is None else out.join(ids.select(key).distinct(), key, "left_semi")


def matching(df: DataFrame, text: str, pattern: str, code: str, codes: list) -> DataFrame:
    """Rows whose text matches or whose code is listed; a table that lacks one of the two columns keeps what the other keeps."""
    found = F.lit(False)
    if text in df.columns:
        found = found | F.coalesce(F.col(text).rlike(pattern), F.lit(False))
    if code in df.columns:
        found = found | F.coalesce(F.col(code).isin(codes), F.lit(False))
    return df.filter(found)


def coerced(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text cells as declared types, unreadable ones as null; columns that aren't there stay away."""
    return df.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema.fields if f.name in df.columns])


def read_sites(spark: SparkSession, paths: dict[str, str], names: dict[str, dict[str, str | None]], schema: T.StructType, site: str = "site") -> DataFrame:
    """CSV files of several sites under one schema: headers renamed per site, those mapped to None never read, all as text first."""
    out = None
    for place, path in sorted(paths.items()):
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
        mapping = names.get(place, {})
        kept = [F.col(f"`{c}`").alias(mapping.get(c, c)) for c in raw.columns if mapping.get(c, c) is not None]
        one = coerced(raw.select(*kept), schema).withColumn(site, F.lit(place))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def conformance(df: DataFrame, expected: list[str], table: str) -> DataFrame:
    """table, column, status (present, missing, unlisted)."""
    rows = [(table, c, "present" if c in df.columns else "missing") for c in expected] + [(table, c, "unlisted") for c in df.columns if c not in expected]
    return df.sparkSession.createDataFrame(rows, "table string, column string, status string")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, extension of all files below a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.select("path", F.col("length").alias("bytes"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"))


def key_values(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files of 'Key: value' lines, a row for each."""
    raw = spark.read.text(path, wholetext=True)
    pairs = F.str_to_map(F.regexp_replace("value", r"[ \t]*:[ \t]*", ":"), F.lit("\r?\n"), F.lit(":"))
    return coerced(raw.select(pairs.alias("m")).select(*[F.col("m")[f.name].alias(f.name) for f in schema.fields]), schema)


def first_existing(rows: DataFrame, key: str, candidates: list[str], names: DataFrame) -> DataFrame:
    """key, found, at: the first of a row's candidate columns that the inventory (name) has."""
    tried = rows.select(key, F.posexplode(F.array(*candidates)).alias("at", "name"))
    return rows.select(key).join(tried.join(names.select("name").distinct(), "name").groupBy(key).agg(F.min_by("name", "at").alias("found"), F.min("at").alias("at")), key, "left")


def unfinished(rows: DataFrame, key: str, ledger: DataFrame, retry: list[str]) -> DataFrame:
    """Rows that the ledger (key, reason; a null reason means done) doesn't have as done or failed for good."""
    return rows.join(ledger.filter(F.col("reason").isNull() | ~F.col("reason").isin(retry)).select(key), key, "left_anti")


def write_report(report: DataFrame, path: str, known_ids: DataFrame | None = None) -> None:
    """Aggregates only: raises before anything is written if the report holds rows about single entities."""
    aggregate_only(report, known_ids).write.mode("overwrite").parquet(path)


def write_records(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def object_key(site: Column, folder: Column, session: Column, task: Column) -> Column:
    """Where a recording lies, from its row alone: folders that lack their prefix get it, sites have their own tree."""
    sub = F.when(F.lower(folder).startswith("sub-"), folder).otherwise(F.concat(F.lit("sub-"), folder))
    name = F.format_string("%s_ses-%s_task-%s.edf", sub, session, task)
    return F.when(site.isNotNull() & folder.isNotNull(), F.concat_ws("/", site, sub, F.concat(F.lit("ses-"), session), name))


def primary_parts(parts: DataFrame, window: str, ids: DataFrame, passed: str) -> DataFrame:
    """One row for each wanted recording (rec_id) of a window: one that passed its checks before others, then the last part."""
    wanted = parts.filter(F.col("window") == window).join(ids.select("rec_id").distinct(), "rec_id", "left_semi")
    row = F.struct(*[c for c in wanted.columns if c != "rec_id"])
    best = wanted.groupBy("rec_id").agg(F.max_by(row, F.struct(F.coalesce(F.expr(passed), F.lit(False)), "part")).alias("r"))
    return best.select("rec_id", "r.*")


def long_ratings(export: DataFrame, case: str, form: str, columns: dict[str, str], codes: dict[str, int]) -> DataFrame:
    """case, label, value of a flat export: the last form of a case holds, blank ids fall out, unknown codes are null."""
    kept = export.filter(F.col(case).isNotNull() & (F.trim(F.col(case).cast("string")) != ""))
    last = kept.groupBy(case).agg(F.max_by(F.struct(*columns), F.col(form)).alias("r")).select(case, *[F.col(f"r.{c}").cast("string").alias(n) for c, n in columns.items()])
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return last.unpivot(case, list(columns.values()), "label", "code").select(case, "label", known[F.col("code")].alias("value"))


def listed_ids(lists: DataFrame, columns: list[str], split: str, pattern: str) -> DataFrame:
    """id, splits, n: every id in any of the path-like columns, and the lists' splits that name it."""
    cells = lists.select(split, F.explode(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns])).alias("cell"))
    ids = cells.select(split, F.explode(F.regexp_extract_all("cell", F.lit(pattern), F.lit(0))).alias("id"))
    return ids.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set(split)), ",").alias("splits"), F.count("*").alias("n"))
