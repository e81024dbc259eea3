"""Fixed values that results depend on.  Every constant that must equal the behaviour being
rebuilt is listed here, in natural order, so operators take them as parameters."""

# Incident types accepted by the report schema.
INCIDENT_TYPES = ["accident", "congestion", "roadwork", "weather", "unknown"]

# Service area (lat/lon bounds) used by the business rule.
SERVICE_AREA = {"lat_min": -33.95, "lat_max": -33.75, "lon_min": 150.95, "lon_max": 151.35}

# Duplicate detection defaults.
DUP_WINDOW_MINUTES = 30
DUP_DISTANCE_KM = 2.0
KM_PER_DEGREE = 111.0

# Description rules.
DESC_MIN_CHARS = 10
DESC_MAX_CHARS = 5000
DESC_REPEAT_RATE = 0.7
DESC_MIN_WORDS = 2
DESC_VALUE_CHARS = 30
CUSTOM_VALUE_CHARS = 50

# Whitespace as Python's str.isspace() sees it, as a regex class
# (Java and RE2 both read the \x{..} escapes).
PY_WS = r"[\t\n\x{0B}\x{0C}\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# The same whitespace as a plain character set (for trim functions).
PY_WS_CHARS = ("\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# Validator messages and error codes.
MSG_REQUIRED = "Field required"
MSG_GE = "Input should be greater than or equal to {}"
MSG_LE = "Input should be less than or equal to {}"
MSG_STR_SHORT = "String should have at least {} characters"
MSG_STR_LONG = "String should have at most {} characters"
MSG_ENUM = "Input should be 'accident', 'congestion', 'roadwork', 'weather' or 'unknown'"
MSG_TS_FUTURE = "Timestamp cannot be in the future"
MSG_END_BEFORE = "end_datetime must be after timestamp"
MSG_END_FUTURE = "end_datetime cannot be in the future"
MSG_ONGOING_WITH_END = "is_ongoing must be False when end_datetime is provided"
MSG_END_REQUIRED = "end_datetime must be provided when is_ongoing is False"
MSG_VALUE_ERROR_PREFIX = "Value error, "
MSG_AREA = "Location ({}, {}) is outside service area"
MSG_NOISE = "Description appears to be mostly repeated characters"
MSG_WORDS = "Description must contain at least 2 words"
CODE_MISSING = "missing"
CODE_GE = "greater_than_equal"
CODE_LE = "less_than_equal"
CODE_STR_SHORT = "string_too_short"
CODE_STR_LONG = "string_too_long"
CODE_ENUM = "enum"
CODE_VALUE_ERROR = "value_error"
CODE_AREA = "out_of_service_area"
CODE_NOISE = "description_quality_low"
CODE_WORDS = "description_too_short_words"

# Time-of-day bins (start hour inclusive, end hour exclusive) and rush hours.
TIME_BINS = [("morning", 5, 9), ("mid_morning", 9, 12), ("afternoon", 12, 17), ("evening", 17, 21)]
TIME_BIN_OTHER = "night"
RUSH_HOURS = [(7, 9), (17, 19)]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

# Grid derivation.
GRID_STEP_DEG = 0.01
HIGHWAY_DISTANCE_CAP_KM = 50.0

# Weather categories (upper bound exclusive).
WEATHER_CATEGORIES = [("cold", 0.0), ("cool", 15.0), ("mild", 25.0)]
WEATHER_TOP = "warm"

# Severity buckets.
SEVERITY_HIGH = 70.0
SEVERITY_MEDIUM = 40.0

# Encoder feature lists.
NUMERIC_FEATURES = ["temperature", "wind_speed", "precipitation", "humidity", "visibility",
                    "severity_initial", "num_lanes_blocked", "num_vehicles"]
CATEGORICAL_FEATURES = ["incident_type", "day_of_week", "weather_category"]
MISSING_WARN_PCT = 40.0

# Kaplan-Meier settings.
KM_MIN_SAMPLES_BY_TYPE = 50
KM_SURVIVAL_POINTS = [10, 25, 50, 75, 90]
KM_DEFAULT_MEDIAN = 30.0
KM_MIN_OBSERVED_FOR_CI = 10
