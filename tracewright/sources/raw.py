"""Raw recordings: inventory, headers, and rows in canonical form.

Files are read once, by byte ranges, line by line without a change of a byte (so that row order, hashes and encodings are exact), and everything else is expressions. The fields of a row are an array; a map
from role to position, made from the file's own header, picks them, so all header variants are read by one plan. A quoted field may hold commas, but no end of line.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from .. import schema as S
from ..functions import flags as FL
from ..functions import geodesy as G
from ..functions import text as TX
from ..operators import ordered, timeline
from ..operators.store import Tables
from . import sinks


def _files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").split("://")[-1].replace("file:", "")
    return df.withColumn("source_file", F.element_at(F.split(F.col("path"), F.lit(base.rsplit("/", 1)[-1] + "/"), 2), -1))


def pointer(content) -> tuple:
    """(oid, size) of a large-file pointer stub in the first bytes of a file, else nulls."""
    head = F.decode(F.substring(content, 1, P.POINTER_PROBE_BYTES), "ISO-8859-1")
    is_stub = head.startswith("version https://git-lfs.github.com/spec/v1")
    oid = F.nullif(F.regexp_extract(head, r"(?m)^oid sha256:([0-9a-f]{64})\s*$", 1), F.lit(""))
    size = F.nullif(F.regexp_extract(head, r"(?m)^size (\d+)\s*$", 1), F.lit("")).cast("long")
    return F.when(is_stub, oid), F.when(is_stub, size)


def encoding(content) -> tuple:
    """(encoding, warning): valid UTF-8 or not in the first bytes, and whether valid text looks decoded twice."""
    head = F.substring(content, 1, P.HEADER_PROBE_BYTES)
    ok = F.is_valid_utf8(head)
    twice = F.when(ok, F.decode(head, "UTF-8").contains("Â") | F.decode(head, "UTF-8").contains("Î¼")).otherwise(False)
    return F.when(ok, "utf-8").otherwise("cp1252"), ~ok | twice


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """A row per file: path, size, family, stream, session, driver, category, pointer and SHA-256 (up to HASH_SIZE_LIMIT_BYTES)."""
    f = _files(spark, root)
    name = F.element_at(F.split("source_file", "/"), -1)
    stream, session = TX.stream_and_session(name)
    driver, category = TX.driver_and_category(F.col("source_file"))
    oid, size = pointer(F.col("content"))
    small = F.col("length") <= P.HASH_SIZE_LIMIT_BYTES
    return f.select(
        "source_file", F.col("length").alias("size_bytes"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"), TX.family(F.col("source_file")).alias("dataset_family"), stream.alias("stream"), session.alias("session_id"),
        driver.alias("driver"), category.alias("category"), oid.isNotNull().alias("is_pointer"), oid.alias("pointer_oid"), size.alias("pointer_size"),
        F.when(small, F.sha2("content", 256)).alias("sha256"), F.when(~small, f"omitted (>{P.HASH_SIZE_LIMIT_BYTES} bytes)").alias("hash_note"),
    )


def folders(files: DataFrame) -> DataFrame:
    """A row per folder that holds a file at any depth, in the columns of inventory() and is_directory; empty folders have no file to be seen by."""
    parts = F.split("source_file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    at = files.where(F.size(parts) > 1).select(F.explode(above).alias("source_file")).distinct()
    known = {"size_bytes": F.lit(0), "extension": F.lit(""), "dataset_family": TX.family(F.col("source_file")), "is_pointer": F.lit(False), "hash_note": F.lit("not applicable to a folder")}
    driver, category = TX.driver_and_category(F.col("source_file"))
    known |= {"driver": driver, "category": category}
    return at.select(*[F.col(f.name) if f.name == "source_file" else known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in files.schema], F.lit(True).alias("is_directory"))


def _lines(files: DataFrame) -> DataFrame:
    # ISO-8859-1 keeps every byte, so hashes and non-UTF-8 headers survive; the signs that matter in units are the same in Windows-1252.
    text = F.decode("content", "ISO-8859-1")
    return files.withColumn("text", text).withColumn("header", F.rtrim(F.substring_index("text", "\n", 1), F.lit("\r")))


def _name(path, root: str):
    """Path below the root of a file's URI."""
    base = root.rstrip("/").split("://")[-1].replace("file:", "")
    plain = F.when(path.contains("%"), F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)
    return F.element_at(F.split(plain, F.lit(re.escape(base.rsplit("/", 1)[-1]) + "/"), 2), -1)


def lines(spark: SparkSession, root: str, glob: str = "*.csv", tables: Tables | None = None) -> DataFrame:
    """(source_file, line_no, line, size_bytes): the lines of all files, in ISO-8859-1 so that every byte survives, with their numbers from 0.

    Files are cut into byte ranges as the reader packs them, whatever their size, and read once: a line is stored with its range and its place in it, and its number is that place plus the lines of the ranges before, by prefix sums over a table of one row per range.
    """
    tables = tables or Tables(spark, "lines")
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    read = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size_bytes"), F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"), F.monotonically_increasing_id().alias("at"))
    kept, _ = tables.keep(read)
    ranges = kept.groupBy("path", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ranges = ranges.withColumn("before", F.sum("n").over(W.partitionBy("path").orderBy("start")) - F.col("n")).select("path", "start", (F.col("before") - F.col("first")).alias("shift"))
    met = kept.join(ranges, ["path", "start"])
    return met.select(_name(F.col("path"), root).alias("source_file"), (F.col("at") + F.col("shift")).alias("line_no"), "line", "size_bytes")


def digests(rows: DataFrame) -> DataFrame:
    """(source_file, file_hash, payload_hash): SHA-256 of each file and of what follows its first line, from its lines. A file's lines pass one task in order and none is held there, so files of any size have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, whole, rest, length, size = None, hashlib.sha256(), hashlib.sha256(), 0, 0

        def ended() -> tuple[str, str, str]:
            if length == size:  # the last line has an end too
                whole.update(b"\n")
                if several:
                    rest.update(b"\n")
            return at, whole.hexdigest(), rest.hexdigest()

        several = False
        for b in batches:
            out = []
            for name, number, line, bytes_ in zip(*(b.column(c).to_pylist() for c in ("source_file", "line_no", "line", "size_bytes")), strict=True):
                if name != at:
                    if at is not None:
                        out.append(ended())
                    at, whole, rest, length, size, several = name, hashlib.sha256(), hashlib.sha256(), 0, bytes_, False
                raw = line.encode("iso-8859-1")
                whole.update(raw if number == 0 else b"\n" + raw)
                if number:
                    rest.update(raw if number == 1 else b"\n" + raw)
                    several = True
                length += len(raw) + 1
            yield _three(out)
        if at is not None:
            yield _three([ended()])

    ordered_ = rows.repartition("source_file").sortWithinPartitions("source_file", "line_no")
    return ordered_.select("source_file", "line_no", "line", "size_bytes").mapInArrow(run, "source_file string, file_hash string, payload_hash string")


def _three(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["source_file", "file_hash", "payload_hash"])


def fields(line) -> Column:
    """Fields of a line: what stands between commas, but for those in double quotes; quotes around a field go, doubled ones inside are one."""
    plain = F.split(line, ",")
    parts = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    bare = lambda x: F.when(F.trim(x).rlike('^".*"$'), F.replace(F.regexp_replace(F.trim(x), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.when(F.instr(line, F.lit('"')) > 0, F.transform(parts, bare)).otherwise(plain)


def headers(files: DataFrame) -> DataFrame:
    """(source_file, i, raw, name, unit, role) of every column."""
    files = files if "header" in files.columns else _lines(files)
    cols = files.select("source_file", F.posexplode(fields(F.col("header"))).alias("i", "raw"))
    named = TX.normalized(F.col("raw"))
    role = TX.role(F.col("raw"))
    for pattern, value in S.ALIASES:
        role = F.when(named.rlike(pattern), value).otherwise(role)
    return cols.select("source_file", "i", "raw", TX.without_unit(F.col("raw")).alias("name"), TX.unit_of(F.col("raw")).alias("unit"), role.alias("role"))


def schema_ids(columns: DataFrame) -> DataFrame:
    """(source_file, schema_id, n_columns): the same id for files with the same names in the same order."""
    by = columns.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("i", TX.normalized(F.col("name")).alias("n")))).alias("c"))
    return by.select("source_file", F.substring(F.sha2(F.array_join(F.transform("c", lambda x: x["n"]), "|"), 256), 1, 12).alias("schema_id"), F.size("c").alias("n_columns"))


def canonical(spark: SparkSession, root: str, glob: str = "*.csv", gap_multiple: float = P.SEGMENT_GAP_MULTIPLE) -> DataFrame:
    """Rows of all recordings below root in the columns of both canonical schemas, with row_idx, segments, freshness and quality flags. No row is dropped.

    row_idx is a row's position: that of the file, but for segments with a step back in time, whose rows are sorted by time.
    """
    tables = Tables(spark, "canonical")
    every = lines(spark, root, glob, tables)
    head = every.where("line_no < 512").groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("top"))
    head = head.select("source_file", F.rtrim(F.get("top", F.lit(0))["line"], F.lit("\r")).alias("header"), F.encode(F.substring(F.array_join(F.transform("top", lambda x: x["line"]), "\n"), 1, P.HEADER_PROBE_BYTES), "ISO-8859-1").alias("probe"))
    head, _ = tables.keep(head)
    stream, session = TX.stream_and_session(F.element_at(F.split("source_file", "/"), -1))
    enc, warned = encoding(F.col("probe"))
    hashes, _ = tables.keep(digests(every))
    base = head.select("source_file", TX.family(F.col("source_file")).alias("dataset_family"), stream.alias("stream"), session.alias("session_id"), warned.alias("encoding_warning"), F.filter(fields(F.col("header")), lambda x: F.trim(x) != "").alias("names"))
    base = base.join(hashes, "source_file")
    # The first header with a role stands for it; one small map per file.
    cat = headers(head)
    maps = cat.groupBy("source_file", "role").agg(F.min(F.struct("i", "unit")).alias("m")).groupBy("source_file").agg(F.map_from_entries(F.collect_list(F.struct("role", "m"))).alias("roles"))
    facts, _ = tables.keep(base.join(maps, "source_file"))
    rows = every.where("line_no > 0").select("source_file", "line_no", F.rtrim("line", F.lit("\r")).alias("line")).where(F.trim("line") != "").join(facts, "source_file")
    rows = rows.withColumn("row_idx", F.col("line_no") - 1).withColumn("f", fields(F.col("line"))).drop("line", "line_no")
    # A column too many, one certain column always empty and something in the last one: the values are shifted from there on.
    at = P.SHIFT_INDEX
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    sign = rows.groupBy("source_file").agg(
        (F.bool_and(F.size("f") == F.size("names") + 1) & F.bool_and(blank(F.get("f", F.lit(at)))) & F.bool_or(~blank(F.element_at("f", -1)))).alias("shifted")
    )
    rows = rows.join(sign, "source_file")
    rows = rows.withColumn("f", F.when(F.col("shifted"), F.concat(F.slice("f", 1, at), F.slice("f", at + 2, F.size("f")))).otherwise(F.col("f")))
    raw = lambda role: F.get("f", F.col("roles")[role]["i"])
    num = lambda role, k=1.0: TX.number(raw(role), k)
    day_s, stamp = TX.colon_millis(F.coalesce(raw("datetime_string"), F.lit("")))
    in_use, in_view = TX.ratio(raw("gnss_satellites"))
    km = F.upper(F.coalesce(F.col("roles")["altitude"]["unit"], F.lit(""))) == "KM"
    mapped = {field: num(role, k) for role, field, k in S.ROLE_FIELDS}
    out = rows.select(
        *["source_file", "dataset_family", "stream", "session_id", "file_hash", "payload_hash", "row_idx", "encoding_warning", "shifted"], *[c.alias(n) for n, c in mapped.items()],
        F.coalesce(num("gnss_altitude"), F.when(km, num("altitude", P.KM_TO_M)).otherwise(num("altitude"))).alias("altitude_m"), raw("gnss_satellites").alias("gnss_satellites_raw"),
        in_use.alias("gnss_satellites_in_use"), in_view.alias("gnss_satellites_in_view"), F.coalesce(num("time_since_start_ms", 1e-3), num("time_of_day_s")).alias("source_time_s"),
        F.coalesce(day_s, num("time_of_day_s")).alias("time_of_day_s"), stamp.alias("timestamp_utc"), day_s.alias("__wall"), num("time_of_day_s").alias("__tod"), num("time_since_start_ms", 1e-3).alias("__elapsed"),
        F.map_keys("roles").alias("__roles"),
    )
    # One clock for a whole file: wall clock, else time of day, else elapsed.
    have = out.groupBy("source_file").agg(F.count("__wall").alias("__nw"), F.count("__tod").alias("__nt"))
    out = out.join(have, "source_file")
    wall = F.unix_micros(F.col("timestamp_utc").cast("timestamp")) / 1e6
    out = out.withColumn("analysis_time_source", F.when(F.col("__nw") > 0, "wall_clock").when(F.col("__nt") > 0, "time_of_day").otherwise("elapsed"))
    out = out.withColumn("analysis_time_s", F.when(F.col("__nw") > 0, wall).when(F.col("__nt") > 0, F.col("__tod")).otherwise(F.col("__elapsed")))
    out = out.withColumn("t_us", F.round(F.col("analysis_time_s") * 1e6).cast("long"))
    order, key = ["row_idx"], ["source_file"]
    out = timeline.arrange(timeline.segment(out, key, order, "t_us", gap_multiple), key, order, "t_us")
    out = timeline.duplicate_times(out, key, "t_us").withColumn("row_idx", F.col("position"))
    fix = G.is_fix(F.col("latitude"), F.col("longitude"))
    out = ordered.freshness(out, key, order, "t_us", ["latitude", "longitude"], fix)
    missing = ~F.forall(F.array(*[F.lit(x) for x in S.NEEDED]), lambda x: F.array_contains("__roles", x))
    q = F.lit(0)
    for cond, name in (
        (missing, "MISSING_SENSOR"), (F.col("analysis_time_s").isNull(), "INVALID_TIMESTAMP"), (F.col("duplicate"), "DUPLICATE_TIMESTAMP"), (F.col("backward"), "NON_MONOTONIC_TIMESTAMP"), (F.col("encoding_warning"), "ENCODING_WARNING"),
        (F.col("shifted"), "SCHEMA_REPAIR"), (F.col("stale"), "GNSS_STALE"), (F.col("boundary"), "SEGMENT_BOUNDARY"),
    ):
        q = FL.set_if(q, F.coalesce(cond, F.lit(False)), FL.QUALITY[name])
    out = out.withColumn("quality_flags", q.cast("int")).withColumn("gnss_fix_available", fix).withColumn("gnss_position_fresh", F.col("fresh")).withColumn("gnss_stale_duration_s", F.col("held_s"))
    out = out.withColumn("segment_id", timeline.segment_id(F.col("payload_hash"), F.col("segment_no"))).withColumn("elapsed_s", F.col("elapsed_us") / 1e6)
    names = list(dict.fromkeys([f.name for s in ("smartphone", "vehicle") for f in S.canonical(s)]))
    return out.select("row_idx", *names)


def availability(rows: DataFrame) -> DataFrame:
    """Per segment, whether each sensor has values in all its columns."""
    aggs = [F.bool_or(sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)) == len(cols)).alias(name) for name, cols in S.AVAILABILITY.items()]
    return rows.groupBy("segment_id").agg(F.first("stream").alias("stream"), F.count("*").alias("n"), *aggs)


def load_segments(spark: SparkSession, path: str, stream: str | None = None) -> DataFrame:
    """Canonical rows written by sinks.write_canonical; the stream is a partition, so others aren't read."""
    df = spark.read.parquet(path).drop("bucket")
    return df if stream is None else df.where(F.col("stream") == stream)


def load_segment(spark: SparkSession, path: str, segment: str) -> DataFrame:
    """One segment's rows: only its bucket is read, and of it only row groups that may hold the segment."""
    number = spark.range(1).select(sinks.bucket(F.lit(segment))).first()[0]
    return spark.read.parquet(path).where((F.col("bucket") == number) & (F.col("segment_id") == segment)).drop("bucket")


def list_segments(spark: SparkSession, path: str) -> DataFrame:
    """(stream, segment_id, source_file, n) of all segments."""
    return spark.read.parquet(path).groupBy("stream", "segment_id", "source_file").agg(F.count("*").alias("n"))


def available(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(source_file, has): what a file has by its manifest (field_mapping) and by its data, whichever is stricter; a flag that the manifest doesn't give is the data's. found: source_file and has_* columns."""
    flags = [c for c in found.columns if c.startswith("has_")]
    met = found.join(manifest, "source_file", "left")
    both = [F.struct(F.lit(c).alias("key"), (F.coalesce(F.col("has")[c], F.lit(True)) & F.coalesce(F.col(c), F.lit(False))).alias("value")) for c in flags]
    return met.select("source_file", F.map_from_entries(F.array(*both)).alias("has"))


def field_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, has): a map of what each file has, from a manifest {"per_file": [{"source_file": ..., "has_*": ...}]}; entries without a file's name are left out, and a flag that isn't given is null in the map."""
    entries = spark.read.option("multiLine", "true").json(path).select(F.explode("per_file").alias("e")).select("e.*")
    flags = [c for c in entries.columns if c.startswith("has_")]
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("boolean").alias("value")) for c in flags])) if flags else F.lit(None).cast("map<string,boolean>")
    return entries.where("source_file IS NOT NULL").select("source_file", pairs.alias("has"))


def optional(df: DataFrame, name: str, kind: str = "double"):
    """A column as a type, null where the table hasn't got it."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind).alias(name)


def conform(df: DataFrame, stream: str) -> DataFrame:
    """Rows in the columns and types of a stream's canonical schema; what is absent is null, but flags are 0."""
    cols = []
    for f in S.canonical(stream):
        c = optional(df, f.name, f.dataType.simpleString())
        cols.append(F.coalesce(c, F.lit(0)).alias(f.name) if f.name == "quality_flags" else c)
    return df.select(*cols)
