"""Canonical columns of a recording, and which role of a raw header feeds each of them."""

from __future__ import annotations

from pyspark.sql import types as T

from .params import G_TO_MPS2, KMH_TO_MPS

VERSION = "2.0.0"

IDENTITY = ("dataset_family", "source_file", "file_hash", "payload_hash", "session_id", "segment_id", "stream")
TIME = ("elapsed_s", "analysis_time_s", "analysis_time_source", "source_time_s", "time_of_day_s", "timestamp_utc")
SMARTPHONE = tuple(f"{s}_{a}" for s in ("accel", "gyro", "mag", "gravity") for a in "xyz") + ("orientation_yaw", "orientation_pitch", "orientation_roll")
GNSS = ("latitude", "longitude", "altitude_m", "gnss_speed_mps", "gnss_accuracy_m", "gnss_heading_deg", "gnss_satellites_raw", "gnss_satellites_in_use", "gnss_satellites_in_view", "gnss_fix_available", "gnss_position_fresh", "gnss_stale_duration_s")
#: Role of a raw column, canonical field, unit factor.
ROLE_FIELDS: tuple[tuple[str, str, float], ...] = (
    ("accel_x", "accel_x", 1.0), ("accel_y", "accel_y", 1.0), ("accel_z", "accel_z", 1.0), ("gravity_x", "gravity_x", 1.0), ("gravity_y", "gravity_y", 1.0), ("gravity_z", "gravity_z", 1.0),
    ("mag_x", "mag_x", 1.0), ("mag_y", "mag_y", 1.0), ("mag_z", "mag_z", 1.0), ("gyro_yaw", "gyro_x", 1.0), ("gyro_pitch", "gyro_y", 1.0), ("gyro_roll", "gyro_z", 1.0),
    ("orientation_yaw", "orientation_yaw", 1.0), ("orientation_pitch", "orientation_pitch", 1.0), ("orientation_roll", "orientation_roll", 1.0),
    ("gnss_latitude", "latitude", 1.0), ("gnss_longitude", "longitude", 1.0), ("gnss_accuracy", "gnss_accuracy_m", 1.0), ("gnss_heading", "gnss_heading_deg", 1.0), ("gnss_speed", "gnss_speed_mps", KMH_TO_MPS),
    ("velocity", "ref_speed_mps", KMH_TO_MPS), ("vehicle_speed", "ref_indicated_speed_mps", KMH_TO_MPS), ("heading", "ref_heading_deg", 1.0), ("vertical_velocity", "ref_vertical_speed_mps", KMH_TO_MPS), ("yaw_rate", "ref_yaw_rate_dps", 1.0),
    ("accel_longitudinal", "ref_accel_long_mps2", G_TO_MPS2), ("accel_lateral", "ref_accel_lat_mps2", G_TO_MPS2), ("steering_angle", "ref_steering_angle_deg", 1.0),
    ("wheel_speed_fl", "ref_wheel_speed_fl", 1.0), ("wheel_speed_fr", "ref_wheel_speed_fr", 1.0), ("wheel_speed_rl", "ref_wheel_speed_rl", 1.0), ("wheel_speed_rr", "ref_wheel_speed_rr", 1.0),
    ("engine_speed", "ref_engine_speed_rpm", 1.0), ("gear", "ref_gear", 1.0), ("gear_requested", "ref_gear_requested", 1.0), ("brake_pressure", "ref_brake_pressure_psi", 1.0), ("brake_position", "ref_brake_position", 1.0),
    ("handbrake", "ref_handbrake", 1.0), ("clutch_position", "ref_clutch_position", 1.0), ("accelerator_pedal", "ref_accelerator_pedal", 1.0), ("battery_voltage", "ref_battery_voltage_v", 1.0),
    ("coolant_temperature", "ref_coolant_temp_c", 1.0), ("air_temperature", "ref_air_temp_c", 1.0), ("sample_period_s", "ref_sample_period_s", 1.0),
)
VEHICLE = tuple(f for _, f, _ in ROLE_FIELDS if f.startswith("ref_"))
#: Fixed values of the format: patterns for headers that the role table doesn't know; the raw axes may be named either way.
ALIASES = ((r"^GYROSCOPE\s*(X|YAW)\b", "gyro_yaw"), (r"^GYROSCOPE\s*(Y|PITCH)\b", "gyro_pitch"), (r"^GYROSCOPE\s*(Z|ROLL)\b", "gyro_roll"), (r"^ORIENTATION\s*\(\s*(YAW|AZIMUTH)", "orientation_yaw"))
#: Roles without which a recording lacks a sensor that features are made of.
NEEDED = (*[f"{s}_{a}" for s in ("accel", "mag", "gravity") for a in "xyz"], "gyro_yaw", "gyro_pitch", "gyro_roll", "orientation_pitch", "orientation_roll", "gnss_latitude", "gnss_longitude", "gnss_accuracy")
AVAILABILITY = {
    "has_accel": ("accel_x", "accel_y", "accel_z"), "has_gyro": ("gyro_x", "gyro_y", "gyro_z"), "has_mag": ("mag_x", "mag_y", "mag_z"), "has_gravity": ("gravity_x", "gravity_y", "gravity_z"),
    "has_orientation": ("orientation_yaw", "orientation_pitch", "orientation_roll"), "has_position": ("latitude", "longitude"), "has_reference_speed": ("ref_speed_mps",),
}

_STRINGS = {*IDENTITY, "analysis_time_source", "gnss_satellites_raw"}
_BOOLS = {"gnss_fix_available", "gnss_position_fresh"}


def _type(field: str) -> T.DataType:
    return T.StringType() if field in _STRINGS else T.BooleanType() if field in _BOOLS else T.TimestampNTZType() if field == "timestamp_utc" else T.DoubleType()


def canonical(stream: str) -> T.StructType:
    """Schema of a stream, smartphone or vehicle."""
    own = {"smartphone": SMARTPHONE + GNSS, "vehicle": GNSS + VEHICLE}
    if stream not in own:
        raise ValueError(f"stream is smartphone or vehicle, not {stream}")
    return T.StructType([T.StructField(f, _type(f)) for f in IDENTITY + TIME + own[stream]] + [T.StructField("quality_flags", T.IntegerType())])
