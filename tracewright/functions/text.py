"""Headers, names and small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def unit_of(raw: Column) -> Column:
    """Text of a closing parenthesis at the end, or null."""
    return _filled(F.trim(F.regexp_extract(raw, r"\(([^)]*)\)\s*$", 1)))


def without_unit(raw: Column) -> Column:
    """The name without its closing parenthesis; the whole name if nothing else is left."""
    name = F.trim(raw)
    return F.coalesce(_filled(F.trim(F.regexp_replace(name, r"\([^)]*\)\s*$", ""))), name)


def normalized(raw: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(raw, r"\s+", " ")))


def stream_and_session(name: Column) -> tuple[Column, Column]:
    """Of file names such as S-K7.csv: smartphone or vehicle, and the session in capitals; nulls for others."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    letter = F.upper(F.regexp_extract(stem, r"(?i)^([SV])-(.+)$", 1))
    stream = F.when(letter == "S", "smartphone").when(letter == "V", "vehicle")
    return stream, F.upper(_filled(F.regexp_extract(stem, r"(?i)^([SV])-(.+)$", 2)))


def driver_and_category(path: Column) -> tuple[Column, Column]:
    """Driver letter and label of the first path part such as 'Town (Driver B)'."""
    pattern = r"^(.+?)\s*\(Driver\s+([A-Z])\)$"
    part = F.get(F.filter(F.split(path, "/"), lambda p: p.rlike(pattern)), F.lit(0))
    return F.regexp_extract(part, pattern, 2), F.regexp_extract(part, pattern, 1)


def family(path: Column) -> Column:
    """Family of a file: documents and pictures by their endings, then the folders in its path; a name with 'un' holds the plain name, and a folder that doesn't say that it is categorised isn't."""
    p = F.lower(path)
    sync = F.when(p.contains("unsynchronised"), "unsynchronized").when(p.contains("synchronised"), "synchronized")
    kind = F.when(p.contains("categorised") & ~p.contains("uncategorised"), "categorized").otherwise("uncategorized")
    return F.when(p.rlike(r"\.(md|pdf|py|gitattributes)$"), "documentation").when(p.endswith(".jpg"), "imagery").when(sync.isNotNull(), F.concat_ws("_", sync, kind)).otherwise("other")


def ratio(text: Column) -> tuple[Column, Column]:
    """'27 / 28' as two numbers, a bare number as the first; nulls otherwise."""
    a, b = (_filled(F.regexp_extract(text, r"^\s*(\d+)\s*/\s*(\d+)\s*$", k)).cast("double") for k in (1, 2))
    return F.coalesce(a, F.expr("1D") * text.try_cast("double")), b


def ratios_consistent(in_use: Column, in_view: Column) -> Column:
    """Aggregate: no row uses more than it sees; true if none has both."""
    return F.coalesce(F.bool_and(in_use <= in_view), F.lit(True))


def number(text: Column, factor: float = 1.0) -> Column:
    """Text to a number times a unit factor; null for what isn't one."""
    return F.trim(text).try_cast("double") * F.lit(float(factor))


def colon_millis(text: Column) -> tuple[Column, Column]:
    """'YYYY-MM-DD HH:MM:SS:mmm' as seconds of the day and a timestamp without zone; missing milliseconds are 0, a missing time gives nulls."""
    pattern = r"^\s*(\d{4}-\d{2}-\d{2})[ T](\d{1,2}):(\d{2}):(\d{2})(?::(\d{1,3}))?\s*$"
    part = lambda k: _filled(F.regexp_extract(text, pattern, k))
    millis = F.coalesce(part(5).cast("double"), F.lit(0.0))
    seconds = part(2).cast("double") * 3600 + part(3).cast("double") * 60 + part(4).cast("double") + millis / 1000
    day = part(1)
    stamp = F.concat(day, F.lit(" "), F.lpad(part(2), 2, "0"), F.lit(":"), part(3), F.lit(":"), part(4), F.lit("."), F.lpad(millis.cast("int").cast("string"), 3, "0"))
    return seconds, stamp.try_cast("timestamp_ntz")


#: Fixed values, in order: the first that a header contains gives its role.
ROLES = (
    ("GPS LATITUDE", "gnss_latitude"), ("GPS LONGITUDE", "gnss_longitude"), ("GPS ALTITUDE", "gnss_altitude"), ("GPS SPEED", "gnss_speed"), ("GPS ACCURACY", "gnss_accuracy"), ("GPS ORIENTATION", "gnss_heading"),
    ("SATELLITES IN RANGE", "gnss_satellites"), ("NO OF GPS SATELLITES", "gnss_satellites"), ("TIME SINCE START OF DAY", "time_of_day_s"), ("TIME SINCE START", "time_since_start_ms"), ("SAMPLE PERIOD", "sample_period_s"), ("DATE", "datetime_string"),
    ("ACCELEROMETER X", "accel_x"), ("ACCELEROMETER Y", "accel_y"), ("ACCELEROMETER Z", "accel_z"), ("GRAVITY X", "gravity_x"), ("GRAVITY Y", "gravity_y"), ("GRAVITY Z", "gravity_z"),
    ("GYROSCOPE YAW", "gyro_yaw"), ("GYROSCOPE PITCH", "gyro_pitch"), ("GYROSCOPE ROLL", "gyro_roll"), ("MAGNETIC FIELD X", "mag_x"), ("MAGNETIC FIELD Y", "mag_y"), ("MAGNETIC FIELD Z", "mag_z"),
    ("ORIENTATION (YAW", "orientation_yaw"), ("ORIENTATION (PITCH", "orientation_pitch"), ("ORIENTATION (ROLL", "orientation_roll"), ("LATITUDE", "gnss_latitude"), ("LONGITUDE", "gnss_longitude"),
    ("VERTICAL VELOCITY", "vertical_velocity"), ("VELOCITY", "velocity"), ("HEADING", "heading"), ("HEIGHT", "altitude"), ("STEERING ANGLE", "steering_angle"),
    ("WHEEL SPEED FRONT LEFT", "wheel_speed_fl"), ("WHEEL SPEED FRONT RIGHT", "wheel_speed_fr"), ("WHEEL SPEED REAR LEFT", "wheel_speed_rl"), ("WHEEL SPEED REAR RIGHT", "wheel_speed_rr"),
    ("YAW RATE", "yaw_rate"), ("INDICATED VEHICLE SPEED", "vehicle_speed"), ("INDICATED LONGITUDINAL ACCELERATION", "accel_longitudinal"), ("INDICATED LATERAL ACCELERATION", "accel_lateral"),
    ("HANDBRAKE", "handbrake"), ("GEAR REQUESTED", "gear_requested"), ("GEAR", "gear"), ("ENGINE SPEED", "engine_speed"), ("COOLANT TEMPERATURE", "coolant_temperature"), ("CLUTCH POSITION", "clutch_position"),
    ("BRAKE PRESSURE", "brake_pressure"), ("BRAKE POSITION", "brake_position"), ("BATTERY VOLTAGE", "battery_voltage"), ("AIR TEMPERATURE", "air_temperature"), ("ACCELERATOR PEDAL POSITION", "accelerator_pedal"),
)


def role(header: Column, roles: tuple[tuple[str, str], ...] = ROLES) -> Column:
    """Semantic role of a header by the first pattern that it contains, else 'unknown'."""
    name, out = normalized(header), None
    for pattern, value in roles:
        out = F.when(name.contains(pattern), value) if out is None else out.when(name.contains(pattern), value)
    return out.otherwise("unknown")
