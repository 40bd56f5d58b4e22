"""Thresholds and constants of the operators.

Fixed values: results depend on them.
"""

from __future__ import annotations

import math

# segmentation
SEGMENT_GAP_MULTIPLE = 100.0
SEGMENT_GAP_MIN_SECONDS = 10.0
SHORT_SEGMENT_SECONDS = 5.0
CLOCK_RESET_MIN_DROP_S = 1.0
# freshness
STALE_UPDATE_MULTIPLE = 2.0
STALE_MIN_SECONDS = 1.0
POSITION_HOLD_THRESHOLD_S = 30.0
MIN_OUTAGE_DURATION_S = 1.0
POOR_ACCURACY_M = 50.0
# alignment in time
MAX_INTERPOLATION_GAP_S = 0.5
NEAREST_TOLERANCE_S = 1.0
SEARCH_STEP_S = 0.1
SEARCH_HALF_WIDTH_S = 30.0
MIN_OVERLAP_S = 60.0
MIN_CORRELATION = 0.5
HIGH_CORRELATION = 0.8
MIN_PEAK_MARGIN = 0.05
TIMEZONE_TOLERANCE_S = 5.0
NEGLIGIBLE_DRIFT_S = 0.05
MAX_LAG_SEARCH_S = 15.0
LAG_SEARCH_STEP_S = 0.2
MIN_LAG_PEAK_MARGIN = 0.1
MIN_LAG_CORRELATION = 0.3
MIN_LAG_S = 0.2
SMOOTHING_WINDOW_S = 2.0
# sampling classes
STABLE_CV_MAX = 0.05
MOSTLY_STABLE_CV_MAX = 0.2
IRREGULAR_CV_MAX = 1.0
IRREGULARITY_THRESHOLD = 0.5
# integration
MAX_INTEGRATION_STEP_S = 0.5
IRREGULAR_DT_FACTOR = 5.0
# frames
STANDARD_GRAVITY_MPS2 = 9.80665
LOW_DYNAMIC_ACCEL_TOLERANCE_MPS2 = 0.5
LOW_DYNAMIC_GYRO_TOLERANCE_RPS = 0.1
MIN_GRAVITY_SAMPLES = 20
MAX_DIRECTION_SPREAD_RAD = 0.35
EARTH_FIELD_MIN_UT = 25.0
EARTH_FIELD_MAX_UT = 65.0
MAX_MAGNITUDE_CV = 0.15
MAX_DIRECTION_RATE_RPS = 3.0
GOOD_SAMPLE_FRACTION = 0.8
MAX_DIP_VARIATION_DEG = 15.0
MIN_LONGITUDINAL_ACCEL_MPS2 = 0.4
MIN_HEADING_SPEED_MPS = 2.0
MIN_FORWARD_SAMPLES = 50
MIN_FORWARD_CORRELATION = 0.3
MAX_SPLIT_HALF_DISAGREEMENT_RAD = 0.26
MAX_GRAVITY_RESIDUAL_DEG = 10.0
MIN_CALIBRATION_DURATION_S = 20.0
MAX_RETAINED_SAMPLES = 60000
GRAVITY_GAIN_HZ = 0.5
MAGNETIC_GAIN_HZ = 0.05
MIN_VECTOR_NORM = 1e-12
EULER_GIMBAL_LIMIT_RAD = 1e-7
QUATERNION_NORM_TOLERANCE = 1e-9
ORTHONORMALITY_TOLERANCE = 1e-9
# rest
MAX_STATIONARY_ACCEL_STD_MPS2 = 0.25
MAX_STATIONARY_GYRO_RPS = 0.03
MAX_STATIONARY_GRAVITY_ERROR_MPS2 = 0.15
MIN_STATIONARY_WINDOW_S = 1.0
START_REST_TOLERANCE_S = 3.0
MAX_PLAUSIBLE_GYRO_BIAS_RPS = 0.35
MAX_PLAUSIBLE_ACCEL_BIAS_MPS2 = 2.0
MAX_PLAUSIBLE_SPECIFIC_FORCE_MPS2 = 147.0
MAX_PLAUSIBLE_RATE_RPS = 35.0
LOW_ALIGNMENT_CONFIDENCE = 0.25
MIN_SEGMENT_SAMPLES = 300
GYRO_PERTURBATIONS_RPS = (0.001, 0.005, 0.01, 0.02)
ACCEL_PERTURBATIONS_MPS2 = (0.005, 0.02, 0.05, 0.1)
# geodesy and gravity
WGS84_SEMI_MAJOR_M = 6378137.0
WGS84_E2 = 0.00669437999014
SOMIGLIANA_GAMMA_E = 9.7803253359
SOMIGLIANA_K = 0.00193185265241
SOMIGLIANA_E2 = 0.00669437999013
FREE_AIR_GRADIENT = 3.086e-06
# windows and splits
WINDOW_SECONDS = 5.0
WINDOW_STRIDE_SECONDS = 0.1
WINDOW_MIN_COVERAGE = 0.8
SPLIT_RATIOS = {"train": 0.7, "validation": 0.15, "test": 0.15}
FINGERPRINT_DECIMALS = 6
# ingest
HASH_SIZE_LIMIT_BYTES = 64 * 1024 * 1024
POINTER_PROBE_BYTES = 1024
HEADER_PROBE_BYTES = 16384
KMH_TO_MPS = 1.0 / 3.6
G_TO_MPS2 = 9.80665
KM_TO_M = 1000.0
SHIFT_INDEX = 6

#: How far a norm near g can be off before its horizontal part shows: sqrt((g + tol)^2 - g^2).
QUADRATURE_BLIND_SPOT = math.sqrt((STANDARD_GRAVITY_MPS2 + MAX_STATIONARY_GRAVITY_ERROR_MPS2) ** 2 - STANDARD_GRAVITY_MPS2**2)
