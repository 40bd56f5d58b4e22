from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright.functions import flags as FL
from tracewright.functions import text as TX
from tracewright.plans import forensics, views
from tracewright.sources import raw, sinks

PHONE = "GPS LATITUDE (degrees), GPS LONGITUDE (degrees), GPS ALTITUDE (m), GPS SPEED (Kmh), GPS ACCURACY (m), GPS ORIENTATION (deg), GPS SATELLITES IN RANGE, TIME SINCE START (ms), DATE (YYYY-MO-DD HH-MI-SS_SSS), ACCELEROMETER X (m/s²), ACCELEROMETER Y (m/s²), ACCELEROMETER Z (m/s²), GYROSCOPE {} (rad/s), GYROSCOPE {} (rad/s), GYROSCOPE {} (rad/s)"
CAR = "No of GPS Satellites Available, Time Since Start of Day (seconds), Latitude (degrees), Longitude (degrees), Velocity (km/hr), Heading (degrees), Height (km)"


def phone_row(i, at=None, lat=None):
    s = 36469.0 + (i * 0.1 if at is None else at)
    clock = f"2019-09-08 {int(s // 3600):02d}:{int(s // 60 % 60):02d}:{int(s % 60):02d}:{int(round(s % 1 * 1000)) % 1000:03d}"
    return f"{52.4 + i * 1e-5 if lat is None else lat},-1.5,147.5,36.0,3,241.6,27 / 28,{i * 100},{clock},0.1,1.5,9.8,0.01,-0.02,0.03"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("raw")
    town = top / "Synchronised V abd S datasets/Categorised Dataset/S (Driver A)/S1"
    town.mkdir(parents=True)
    lines = [PHONE.format("Yaw", "Pitch", "Roll")] + [phone_row(i) for i in range(60)]
    (town / "S-S1.csv").write_bytes("\n".join(lines).encode("cp1252") + b"\n")
    (town / "V-S1.csv").write_text("\n".join([CAR] + [f"11.0,{36469 + i * 0.1:.4f},52.4,-1.5,{36 + i / 10},241.7,0.110" for i in range(60)]) + "\n")
    other = top / "Unsynchronised V and S Dataset/Uncategorised (V and S) Dataset"
    other.mkdir(parents=True)
    gap = [phone_row(i, i * 0.1 if i < 30 else 600 + i * 0.1, 52.4 if i < 25 else None) for i in range(60)]
    (other / "S-G1.csv").write_text("\n".join([PHONE.format("X", "Y", "Z"), *gap]) + "\n")
    (other / "S-G2.csv").write_text("\n".join([PHONE.format("Yaw", "Pitch", "Roll"), *gap]) + "\n")  # the same rows under other names
    shifted = [",".join([*(p := phone_row(i).split(","))[:6], "", *p[6:]]) for i in range(20)]
    (other / "S-A4.csv").write_text("\n".join([PHONE.format("X", "Y", "Z"), *shifted]) + "\n")
    (other / "S-E.csv").write_text(PHONE.format("X", "Y", "Z") + "\n")
    (top / "readme.md").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:" + "a" * 64 + "\nsize 77\n")
    return top


def test_inventory(spark, root):
    got = {r.source_file.rsplit("/", 1)[-1]: r for r in raw.inventory(spark, str(root)).collect()}
    s1 = got["S-S1.csv"]
    assert (s1.dataset_family, s1.stream, s1.session_id, s1.driver, s1.category, s1.is_pointer) == ("synchronized_categorized", "smartphone", "S1", "A", "S", False)
    assert s1.sha256 == hashlib.sha256((root / s1.source_file).read_bytes()).hexdigest()
    assert got["S-G1.csv"].dataset_family == "unsynchronized_uncategorized" and got["V-S1.csv"].stream == "vehicle"
    assert (got["readme.md"].pointer_oid, got["readme.md"].pointer_size, got["readme.md"].dataset_family) == ("a" * 64, 77, "documentation")


def test_headers(spark, root):
    cat = raw.headers(raw._files(spark, str(root), "S-G*.csv")).collect()
    roles = {(r.source_file[-8:], r.i): r.role for r in cat}
    assert roles["S-G1.csv", 12] == roles["S-G2.csv", 12] == "gyro_yaw" and roles["S-G1.csv", 6] == "gnss_satellites"
    ids = {r.source_file[-8:]: r.schema_id for r in raw.schema_ids(raw.headers(raw._files(spark, str(root), "S-*.csv"))).collect()}
    assert ids["S-G1.csv"] == ids["S-A4.csv"] != ids["S-G2.csv"]


@pytest.fixture(scope="module")
def rows(spark, root):
    return raw.canonical(spark, str(root)).cache()


def test_canonical(spark, root, rows):
    by = {r[0]: r[1:] for r in rows.groupBy(F.substring_index("source_file", "/", -1)).agg(F.count("*"), F.countDistinct("segment_id"), F.bit_or("quality_flags"), F.max("ref_speed_mps"), F.avg("accel_z"), F.max("altitude_m"), F.max("gnss_satellites_in_view")).collect()}
    assert {k: v[0] for k, v in by.items()} == {"S-S1.csv": 60, "V-S1.csv": 60, "S-G1.csv": 60, "S-G2.csv": 60, "S-A4.csv": 20}
    assert by["S-G1.csv"][1] == 2 and by["S-S1.csv"][1] == 1
    assert by["S-S1.csv"][2] & FL.QUALITY["ENCODING_WARNING"] and not by["V-S1.csv"][2] & FL.QUALITY["ENCODING_WARNING"]
    assert by["S-A4.csv"][2] & FL.QUALITY["SCHEMA_REPAIR"] and by["S-A4.csv"][4] == pytest.approx(9.8) and by["S-A4.csv"][6] == 28
    assert by["V-S1.csv"][3] == pytest.approx(41.9 / 3.6) and by["V-S1.csv"][5] == pytest.approx(110.0)
    same = rows.where("source_file LIKE '%S-G_.csv'").select("payload_hash", "segment_id").distinct().count()
    assert same == 2  # both files have the same rows
    assert by["V-S1.csv"][2] & FL.QUALITY["MISSING_SENSOR"] and by["S-S1.csv"][2] & FL.QUALITY["MISSING_SENSOR"]  # neither has a magnetometer
    stale = rows.where("source_file LIKE '%S-G1.csv'").where(F.col("gnss_stale_duration_s") > 2).count()
    assert stale > 0


def test_views_and_sinks(spark, rows, tmp_path):
    sinks.write_canonical(rows, str(tmp_path / "c"))
    back = raw.load_segments(spark, str(tmp_path / "c"))
    assert back.count() == rows.count() and raw.load_segments(spark, str(tmp_path / "c"), "vehicle").count() == 60
    assert back.where("is_canonical_copy").count() == rows.count() - 60
    one = back.select("segment_id").first()[0]
    assert raw.load_segment(spark, str(tmp_path / "c"), one).count() == back.where(F.col("segment_id") == one).count() > 0
    assert raw.list_segments(spark, str(tmp_path / "c")).agg(F.sum("n")).first()[0] == rows.count() and "bucket" not in back.columns
    v = views.ingest_views(back)
    assert v["outages"].count() == 0 and v["windows"].where("n > 1").count() >= 0 and {x.label_source for x in v["label_speeds"].collect()} <= {"TIER_3_SMARTPHONE_GNSS"}
    assert v["leakage"].count() == 0
    overlap = v["overlap"].first()
    assert overlap.overlap_s == pytest.approx(5.9) and overlap.offset_start_s == pytest.approx(0)
    assert v["sync"].first().status == "UNRESOLVED" and v["label_coverage"].count() == 4  # six seconds in common are too few
    assert {r.paired for r in v["pairs"].where("session_id = 'S1'").collect()} == {True}
    assigned = v["splits"].collect()
    assert len({r.split for r in assigned if r.source_file.endswith(("S-G1.csv", "S-G2.csv"))}) == 1
    assert "S1" in sinks.splits_json(v["splits"], segment="session_id").first().json
    a = {r.segment_id: r for r in v["availability"].collect()}
    assert all(r.has_accel != (r.stream == "vehicle") and not r.has_mag for r in a.values())
    views.register(v, "v_")
    assert spark.sql("SELECT count(*) FROM v_segments").first()[0] == len(assigned)


def test_manifest_and_absent_columns(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"per_file": [\n{"source_file": "a.csv", "has_gyro": true, "n": 1},\n{"source_file": "b.csv", "has_mag": false},\n{"has_gyro": true}]}')
    got = {r.source_file: r["has"] for r in raw.field_mapping(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"a.csv": {"has_gyro": True, "has_mag": None}, "b.csv": {"has_gyro": None, "has_mag": False}}
    data = spark.createDataFrame([("a.csv", True, True), ("b.csv", True, True), ("c.csv", None, True)], "source_file string, has_gyro boolean, has_mag boolean")
    stricter = {r.source_file: r["has"] for r in raw.available(raw.field_mapping(spark, str(tmp_path / "m.json")), data).collect()}
    assert stricter == {"a.csv": {"has_gyro": True, "has_mag": True}, "b.csv": {"has_gyro": True, "has_mag": False}, "c.csv": {"has_gyro": False, "has_mag": True}}
    df = spark.createDataFrame([("1.5", "x")], "latitude string, other string")
    (r,) = raw.conform(df, "vehicle").collect()
    assert (r.latitude, r.ref_speed_mps, r.gnss_fix_available, r.quality_flags) == (1.5, None, None, 0) and "other" not in r


def test_a_file_of_several_ranges(spark, tmp_path):
    """Ranges of 4 kB give the same lines, numbers, digests and rows as one range; ends of line of both kinds, none at the end, blank lines and quoted fields."""
    top = tmp_path / "long"
    top.mkdir()
    body = [phone_row(i) for i in range(900)]
    body[7], body[400] = "", body[400].replace("3,", '"3",', 1)
    texts = {"S-L1.csv": "\r\n".join([PHONE.format("X", "Y", "Z"), *body]), "S-L2.csv": "\n".join([PHONE.format("X", "Y", "Z"), *body]) + "\n", "S-L3.csv": PHONE.format("X", "Y", "Z") + "\n"}
    for name, text in texts.items():
        (top / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = raw.canonical(spark, str(top)).toPandas()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = raw.lines(spark, str(top))
        assert found.select("source_file", "line_no").distinct().count() == found.count()
        got = {r.source_file: r["ls"] for r in found.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls")).collect()}
        assert spark.read.text(str(top)).rdd.getNumPartitions() > 10
        for name, text in texts.items():
            want = text.encode().decode("iso-8859-1").removesuffix("\n").split("\n")
            assert [r.line_no for r in got[name]] == list(range(len(want))) and [r.line for r in got[name]] == want
        for r in raw.digests(found).collect():
            data = texts[r.source_file].encode()
            assert (r.file_hash, r.payload_hash) == (hashlib.sha256(data).hexdigest(), hashlib.sha256(data.split(b"\n", 1)[1]).hexdigest())
        parts = raw.canonical(spark, str(top)).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    key = ["source_file", "row_idx"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (whole, parts))
    assert len(a) == 2 * 899 and a.astype(str).equals(b.astype(str)) and a["gnss_accuracy_m"].tolist() == [3.0] * len(a)


def test_families(spark):
    paths = {
        "Synchronised V/Categorised/S-1.csv": "synchronized_categorized", "Synchronised V/S-1.csv": "synchronized_uncategorized", "Unsynchronised V/Uncategorised x/S-1.csv": "unsynchronized_uncategorized", "UNSYNCHRONISED/Categorised/a.txt": "unsynchronized_categorized",
        "Synchronised V/Categorised/notes.PDF": "documentation", "tools/read.py": "documentation", ".gitattributes": "documentation", "Synchronised/x.jpg": "imagery", "x.png": "other", "readme.txt": "other",
    }
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.f for r in df.select("p", TX.family(F.col("p")).alias("f")).collect()} == paths


def test_forensics(spark, root, rows, tmp_path):
    figures = forensics.run(spark, str(root), str(tmp_path))
    assert figures["n_rows"] == rows.count() == 260
    assert figures["schema_repair"] == rows.where(FL.has(F.col("quality_flags"), FL.QUALITY["SCHEMA_REPAIR"])).count() == 20
    a = {name: spark.read.parquet(f"{tmp_path}/artifacts/{name}") for name in forensics.ARTIFACTS}
    r = a["integrity_report"].first()
    assert (r.files, r.pointers, r.tables, r.not_utf8, r.parse_failures, r.paired_sessions, r.n_rows) == (7, 1, 6, 1, 1, 1, 260) and r.integrity_status == "PASS_WITH_WARNINGS"
    named = lambda n: {x.source_file.rsplit("/", 1)[-1]: x for x in a[n].collect()}
    assert named("sampling_report")["S-S1.csv"].median_s == pytest.approx(0.1) and named("timestamp_report")["V-S1.csv"].clock == "time_of_day"
    m = {(x.source_file.rsplit("/", 1)[-1], x.role): x for x in a["missingness_report"].collect()}
    assert m["V-S1.csv", "velocity"].n_numeric == 60 and m["V-S1.csv", "velocity"].max == pytest.approx(41.9) and m["S-E.csv", "accel_x"].n_rows is None
    assert a["synchronization_report"].first().overlap_s == pytest.approx(5.9)
    q = named("session_quality")
    assert 0 < q["S-S1.csv"].quality_score <= 1 and q["S-S1.csv"].gnss_score == 1.0 and a["trajectory_points"].where("source_file LIKE '%S-S1.csv'").count() == 60
    assert a["duplicate_groups"].count() == 0 and a["smartphone_schema"].where("role = 'accel_z'").agg(F.sum("files")).first()[0] == 5
    assert a["dataset_manifest"].where("NOT is_directory").count() == r.files
    shown = {x.category: x.source_file.rsplit("/", 1)[-1] for x in a["representative_sessions"].collect()}
    found = Counter(x.source_file for x in a["range_findings"].collect() if "S-" in x.source_file.rsplit("/", 1)[-1])
    assert set(shown) == {"difficult_motion", "irregular_sampling"}  # every steady phone has a constant sensor, and of equal numbers of findings the first path counts
    assert shown["difficult_motion"] == min(found, key=lambda f: (-found[f], f)).rsplit("/", 1)[-1] and shown["irregular_sampling"] == "S-G1.csv"


def test_folders(spark):
    files = spark.createDataFrame([("Cat (Driver B)/x/S-1.csv", 5, "a"), ("Cat (Driver B)/y.csv", 6, "b"), ("top.csv", 7, "c")], "source_file string, size_bytes long, sha256 string")
    files = files.selectExpr("*", "'.csv' AS extension", "'other' AS dataset_family", "'B' AS driver", "false AS is_pointer")
    got = {r.source_file: r for r in raw.folders(files).collect()}
    assert set(got) == {"Cat (Driver B)", "Cat (Driver B)/x"}
    r = got["Cat (Driver B)/x"]
    assert (r.size_bytes, r.sha256, r.extension, r.driver, r.is_pointer, r.is_directory) == (0, None, "", "B", False, True)
    assert raw.folders(files.limit(0)).count() == 0
