"""Scalar column functions.  All are built-in expressions: codegen'd, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadlens.operators.features import map_lookup

# Incident type -> news search phrase, and the base terms always added.
NEWS_TYPE_TERMS = {
    "accident": "road accident crash",
    "congestion": "traffic congestion jam",
    "road_closure": "road closed blocked",
    "hazard": "road hazard obstruction",
    "event": "public event rally gathering",
    "waterlogging": "waterlogging flood",
    "protest": "protest demonstration",
    "vip_movement": "VIP convoy road block",
}
NEWS_BASE_TERMS = "Bengaluru traffic"

# Operator-facing term translations (passthrough when absent).
TRANSLATIONS = {
    "1 Inspector, 4 Traffic Constables": "1 ಇನ್ಸ್‌ಪೆಕ್ಟರ್, 4 ಟ್ರಾಫಿಕ್ ಕಾನ್‌ಸ್ಟೇಬಲ್‌ಗಳು",
    "2 Traffic Constables": "2 ಟ್ರಾಫಿಕ್ ಕಾನ್‌ಸ್ಟೇಬಲ್‌ಗಳು",
    "1 Traffic Constable (Monitor only)": "1 ಟ್ರಾಫಿಕ್ ಕಾನ್‌ಸ್ಟೇಬಲ್ (ಮಾನಿಟರ್ ಮಾತ್ರ)",
    "10 Heavy Barricades, 5 Cones": "10 ಹೆವಿ ಬ್ಯಾರಿಕೇಡ್‌ಗಳು, 5 ಕೋನ್‌ಗಳು",
    "4 Standard Barricades": "4 ಸ್ಟ್ಯಾಂಡರ್ಡ್ ಬ್ಯಾರಿಕೇಡ್‌ಗಳು",
    "None required": "ಯಾವುದೇ ಅಗತ್ಯವಿಲ್ಲ",
    "Major detour via adjacent arterial roads. Complete block of node.": "ಪಕ್ಕದ ರಸ್ತೆಗಳ ಮೂಲಕ ಪ್ರಮುಖ ಬಳಸುದಾರಿ. ಜಂಕ್ಷನ್ ಸಂಪೂರ್ಣ ಬ್ಲಾಕ್.",
    "Partial lane closure. Route heavy vehicles to alternate paths.": "ಭಾಗಶಃ ಲೇನ್ ಮುಚ್ಚುವಿಕೆ. ಭಾರೀ ವಾಹನಗಳನ್ನು ಪರ್ಯಾಯ ಮಾರ್ಗಗಳಿಗೆ ತಿರುಗಿಸಿ.",
    "No diversion needed.": "ಯಾವುದೇ ತಿರುವು ಅಗತ್ಯವಿಲ್ಲ.",
}

# Secret-looking setting names.
SECRET_WORDS = ["password", "secret", "token", "key", "api_key"]
# Audit detail keys that are replaced, and their replacements.
REDACTIONS = {"location": "REDACTED_GRID_CELL", "user_ip": "REDACTED_IP"}
# Blending weights and multipliers.
SEVERITY_WEIGHTS = (0.7, 0.3)
DURATION_WEIGHTS = (0.6, 0.4)
ALERT_MULTIPLIER = 1.3
NEWS_SEVERITY_BOOST = 15.0
NEWS_DURATION_FACTOR = 1.5


def format_duration(minutes: Column) -> Column:
    """"1 day 2 hr 5 min" style; null, zero or unparsable -> "0 min"."""
    m = F.floor(minutes.cast("string").try_cast("double")).cast("long")
    d, h, mi = F.floor(m / 1440), F.floor(F.pmod(m, F.lit(1440)) / 60), F.pmod(m, F.lit(60))
    day = F.when(d > 0, F.concat(d.cast("string"), F.lit(" day"), F.when(d > 1, F.lit("s")).otherwise(F.lit(""))))
    hr = F.when(h > 0, F.concat(h.cast("string"), F.lit(" hr")))
    mn = F.when((mi > 0) | ((d <= 0) & (h <= 0)), F.concat(mi.cast("string"), F.lit(" min")))
    return F.when(m.isNull() | (m == 0), F.lit("0 min")).otherwise(F.concat_ws(" ", day, hr, mn))


def title_words(s: Column) -> Column:
    """Replace "_" by " " then capitalise each space-separated word."""
    return F.initcap(F.replace(s, F.lit("_"), F.lit(" ")))


def ellipsis(s: Column, n: int) -> Column:
    return F.concat(F.substring(s, 1, n), F.when(F.length(s) > n, F.lit("...")).otherwise(F.lit("")))


def incident_label(itype: Column, address: Column) -> Column:
    a = F.coalesce(address, F.lit("Unknown Location"))
    return F.concat(title_words(F.coalesce(itype, F.lit("Unknown"))), F.lit(" at "), ellipsis(a, 40))


def translate_terms(s: Column) -> Column:
    return F.coalesce(map_lookup(TRANSLATIONS, s), s)


def build_news_query(address: Column, landmark: Column, corridor: Column, locality: Column, area: Column,
                     cause: Column, itype: Column) -> Column:
    def nz(c):
        return F.when(F.coalesce(c, F.lit("")) != "", c)
    loc = F.coalesce(nz(address), nz(landmark), nz(corridor), nz(locality), nz(area), F.lit(""))
    bad = F.upper(F.trim(loc)).isin("", "NULL", "NONE")
    loc = F.when(bad, F.lit("")).otherwise(F.trim(F.split_part(loc, F.lit(","), F.lit(1))))
    raw = F.coalesce(nz(cause), nz(itype), F.lit(""))
    term = F.coalesce(map_lookup(NEWS_TYPE_TERMS, F.lower(raw)), F.replace(raw, F.lit("_"), F.lit(" ")))
    return F.concat_ws(" ", F.lit(NEWS_BASE_TERMS), F.when(loc != "", loc), F.when(term != "", term))


def l2_normalize(v: Column) -> Column:
    """Unit length; the zero vector stays zero."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(
        F.transform(v, lambda x: x.cast("double")))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def log_duration(minutes: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), minutes))


def from_log_duration(y: Column) -> Column:
    return F.greatest(F.lit(0.0), F.expm1(y))


def duration_interval(est: Column, lo: float = 0.8, hi: float = 1.2) -> Column:
    return F.struct((est * lo).alias("ci_lower"), (est * hi).alias("ci_upper"))


def news_boost(severity: Column, duration: Column, matched: Column) -> Column:
    return F.struct(
        F.when(matched, F.least(severity + NEWS_SEVERITY_BOOST, F.lit(100.0))).otherwise(severity).alias("severity"),
        F.when(matched, duration * NEWS_DURATION_FACTOR).otherwise(duration).alias("duration"))


def alert_multiplier(log_estimate: Column, alert: Column) -> Column:
    return F.when(alert, log_estimate * ALERT_MULTIPLIER).otherwise(log_estimate)


def weighted_blend(sev_a: Column, sev_b: Column, dur_a: Column, dur_b: Column) -> Column:
    ws, wd = SEVERITY_WEIGHTS, DURATION_WEIGHTS
    s = F.least(F.greatest(sev_a * ws[0] + sev_b * ws[1], F.lit(0.0)), F.lit(100.0))
    d = F.greatest(dur_a * wd[0] + dur_b * wd[1], F.lit(0.0))
    return F.struct(s.alias("severity"), d.alias("duration"))


def is_missing_text(c: Column) -> Column:
    return c.isNull() | F.lower(c.cast("string")).isin("none", "", "nat")


def mask_secret(name: Column, value: Column) -> Column:
    secret = F.lit(False)
    for w in SECRET_WORDS:
        secret = secret | F.contains(F.lower(name), F.lit(w))
    masked = F.when(F.length(value) > 6, F.concat(F.substring(value, 1, 3), F.repeat(F.lit("*"), F.length(value) - 6),
                                                  F.substring(value, -3, 3))).otherwise(F.lit("***"))
    return F.when(secret, masked).otherwise(value)


def mask_api_key(key: Column) -> Column:
    return F.concat(F.substring(key, 1, 8), F.lit("..."))


def redact_details(details: Column) -> Column:
    """map<string,string>: the sensitive keys get fixed replacement values."""
    def replace(k, v):
        return lambda kk, vv: F.when(kk == k, F.lit(v)).otherwise(vv)
    expr = details
    for k, v in REDACTIONS.items():
        expr = F.transform_values(expr, replace(k, v))
    return expr
