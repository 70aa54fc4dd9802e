"""Column expressions over uploads, documents and sessions."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.schemas import ACCESS_MINUTES, RETIRED_STATUSES, SESSION_DAYS

# Interface status codes and their labels.
STATUS_LABELS = {"READY": "Ready", "PROCESSING": "Processing", "FAILED": "Failed"}

# Fixed value: message kept when a failure has none of its own.
DEFAULT_ERROR = "Upload initialization failed"

# Fixed value: first step of every object key.
OBJECT_ROOT = "documents"

# The email pattern of the sign-up form's validator library, whose two look-aheads
# (no leading dot, no two dots in a row) are separate tests here so that RE2 engines agree.
EMAIL = r"^[A-Za-z0-9_'+.-]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}\z"

_UNIT_SECONDS = [("day", 86_400), ("hour", 3_600), ("minute", 60)]


def instant(moment: str | dt.datetime) -> Column:
    """A zone-free timestamp literal."""
    text = moment.isoformat(sep=" ") if isinstance(moment, dt.datetime) else moment
    return F.to_timestamp_ntz(F.lit(text))


def epoch_seconds(moment: Column) -> Column:
    """Seconds since 1970 with their fraction, read off the clock fields: no zone comes into it."""
    clock = F.hour(moment) * 3600 + F.minute(moment) * 60 + F.extract(F.lit("SECOND"), moment)
    return F.unix_date(F.to_date(moment)).cast("bigint") * 86_400 + clock


def month_start(moment: Column) -> Column:
    return F.trunc(F.to_date(moment), "MM").cast("timestamp_ntz")


def checked_part_size(part_size: float) -> int:
    """Part size in whole bytes; anything else is refused here, before a job starts."""
    if not math.isfinite(part_size) or part_size <= 0 or part_size != int(part_size):
        raise ValueError(f"part size must be a positive whole number of bytes, got {part_size!r}")
    return int(part_size)


def part_count(file_size: Column, part_size: float) -> Column:
    """Number of parts an upload of ``file_size`` bytes is cut into."""
    return F.ceil(file_size.cast("bigint") / F.lit(checked_part_size(part_size)))


def object_key(user_id: Column, document_id: Column) -> Column:
    """``documents/{user}/{document}``; null when either id is (concat does not skip nulls)."""
    return F.concat(F.lit(OBJECT_ROOT + "/"), user_id.cast("string"), F.lit("/"), document_id.cast("string"))


def row_id(*keys: Column) -> Column:
    """Repeatable row id: a lost task that runs again gives the same ids, as a random one would not."""
    marked = [F.coalesce(k.cast("string"), F.lit("\u0000")) for k in keys]
    return F.sha2(F.concat_ws("\u001f", *marked), 256)


def session_expires_at(issued: Column) -> Column:
    return issued + F.expr(f"INTERVAL {24 * SESSION_DAYS} HOURS")


def access_expires_at(issued: Column) -> Column:
    return issued + F.expr(f"INTERVAL {ACCESS_MINUTES} MINUTES")


def current_status(status: Column) -> Column:
    """Replaces retired status names."""
    for old, new in RETIRED_STATUSES.items():
        status = F.when(status == old, new).otherwise(status)
    return status


def interface_status(status: Column) -> Column:
    """Stored status to one of the three the interface knows."""
    return F.when(status == "COMPLETED", "READY").when(status == "FAILED", "FAILED").otherwise("PROCESSING")


def status_label(status: Column) -> Column:
    code = interface_status(status)
    label = F.lit(None).cast("string")
    for key, text in STATUS_LABELS.items():
        label = F.when(code == key, text).otherwise(label)
    return label


def error_text(message: Column) -> Column:
    return F.coalesce(message, F.lit(DEFAULT_ERROR))


def email_is_valid(email: Column) -> Column:
    return email.rlike(EMAIL) & ~email.startswith(".") & ~email.contains("..")


def relative_age(moment: Column, now: str | dt.datetime) -> Column:
    """"2 days ago", "1 hour ago", "15 minutes ago": whole units, the largest that fits."""
    seconds = F.floor(epoch_seconds(instant(now)) - epoch_seconds(moment))
    age = F.lit("just now")
    for unit, size in reversed(_UNIT_SECONDS):
        n = F.floor(seconds / size)
        text = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
        age = F.when(seconds >= size, text).otherwise(age)
    return F.when(moment.isNotNull(), age)
