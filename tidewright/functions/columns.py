"""Pure column-to-column formulas. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The platforms whose name prefixes an order key.
PLATFORMS = ("uber_eats", "doordash", "own_app")
EARTH_KM = 6371.0
KM_PER_MILE = 1.60934
LATE_SECONDS = 86_400


def dollars_to_cents(dollars: Column) -> Column:
    return F.round(dollars * 100).cast("long")


def clean_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def identity_key(email: Column, platform: Column, platform_customer_id: Column) -> Column:
    """SHA-256 of the cleaned email; without one, of platform and its customer id (null if null)."""
    return F.when(email.isNotNull(), F.sha2(clean_email(email), 256)).otherwise(F.sha2(F.concat(platform, platform_customer_id), 256))


def match_method(email: Column) -> Column:
    return F.when(email.isNotNull(), "exact_email").otherwise("platform_id_fallback")


def order_key(platform: Column, order_id: Column) -> Column:
    return F.concat(platform, F.lit("_"), order_id)


def strip_platform(key: Column) -> Column:
    return F.regexp_replace(key, f"^({'|'.join(PLATFORMS)})_", "")


def is_late(event_ts: Column, seen_ts: Column, seconds: int = LATE_SECONDS) -> Column:
    """Seen more than ``seconds`` after it happened; exactly that old is not late."""
    return (F.unix_timestamp(seen_ts) - F.unix_timestamp(event_ts)) > F.lit(seconds)


def date_key(ts: Column) -> Column:
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def time_key(ts: Column) -> Column:
    return (F.hour(ts) * 100 + F.minute(ts)).cast("int")


def surrogate_key(*natural: Column) -> Column:
    """60 bits of the MD5 of the natural key: never negative, no 32-bit collisions."""
    text = natural[0].cast("string") if len(natural) == 1 else F.to_json(F.struct(*natural), {"ignoreNullFields": "false"})
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def change_hash(*tracked: Column) -> Column:
    """Nulls keep their place, so (a, null) and (null, a) differ."""
    return F.sha2(F.to_json(F.struct(*tracked), {"ignoreNullFields": "false"}), 256)


def mask(email: Column) -> Column:
    return F.md5(clean_email(email))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() would skip a null and give half the globe
    return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def minutes_between(start: Column, end: Column) -> Column:
    return F.round((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60, 2)


def mph_to_kmh(mph: Column) -> Column:
    return F.round(mph * KM_PER_MILE, 2)


def day_part(hour: Column) -> Column:
    # fixed values: the bounds of the parts of a day
    return F.when(hour.between(5, 11), "morning").when(hour.between(12, 16), "afternoon").when(hour.between(17, 21), "evening").otherwise("night")


def is_weekend(ts: Column) -> Column:
    return F.dayofweek(ts).isin(1, 7)


def item_count(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)).cast("int")


def rate_pct(part: Column, whole: Column) -> Column:
    """Null where the whole is 0."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 2)


def version_status(valid_to: Column) -> Column:
    return F.when(valid_to.isNull(), "current").otherwise("historical")


def rating_0_100(rating: Column, low: float, high: float) -> Column:
    return F.round((rating - low) * 100 / (high - low), 2)
