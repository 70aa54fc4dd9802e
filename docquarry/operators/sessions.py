"""Sessions: expiry, refresh outcomes, rotation, and login audits over batches of requests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.uploads import instant, session_expires_at


def expired_sessions(sessions: DataFrame, now: str | dt.datetime, user_id: str | None = None) -> DataFrame:
    """Sessions past their time; one that ends exactly now is still live."""
    expired = sessions.where(F.col("expiresAt") < instant(now))
    return expired if user_id is None else expired.where(F.col("userId") == user_id)


def live_sessions(sessions: DataFrame, now: str | dt.datetime) -> DataFrame:
    return sessions.where(F.col("expiresAt") >= instant(now))


def _absent(value: Column) -> Column:
    return value.isNull() | (value == "")


def _spread(value: Column, by: Column) -> Column:
    """Join key that sends rows without a value to many tasks instead of one.

    The outcome of such rows is known without the join, so a chance match is ignored by the callers.
    """
    return F.when(_absent(value), F.concat(F.lit("\u0000"), by.cast("string"))).otherwise(value)


def refresh_outcomes(
    requests: DataFrame, sessions: DataFrame, now: str | dt.datetime, request_key: str = "requestId",
    moment: str = "requestedAt",
) -> DataFrame:
    """What became of each refresh request: ``missing``, ``unknown``, ``expired`` or ``valid``.

    Tokens are unique among sessions, so a request meets at most one session. The first request of a
    token, by moment, then key, finds it; it is rotated or deleted then, so to later ones the token is
    ``unknown``. The first is a min that combines before the shuffle.
    """
    turn = F.struct(F.col(moment), F.col(request_key))
    firsts = requests.where(~_absent(F.col("token"))).groupBy("token").agg(F.min(turn).alias("first"))
    known = sessions.select("token", F.col("id").alias("sessionId"), "userId", "expiresAt").join(firsts, "token")
    known = known.withColumnRenamed("token", "match")
    asked = requests.withColumn("match", _spread(F.col("token"), F.col(request_key)))
    earliest = F.col(moment).eqNullSafe(F.col(f"first.{moment}")) & F.col(request_key).eqNullSafe(F.col(f"first.{request_key}"))
    outcome = (
        F.when(_absent(F.col("token")), "missing")
        .when(F.col("sessionId").isNull() | ~earliest, "unknown")
        .when(F.col("expiresAt") < instant(now), "expired")
        .otherwise("valid")
    )
    joined = asked.join(known, "match", "left").withColumn("outcome", outcome)
    found = F.col("outcome").isin("expired", "valid")
    return joined.select(
        *requests.columns,
        "outcome",
        F.when(found, F.col("sessionId")).alias("sessionId"),
        F.when(found, F.col("userId")).alias("userId"),
    )


def rotate_sessions(
    sessions: DataFrame, rotations: DataFrame, now: str | dt.datetime | None = None, order: str = "newToken"
) -> DataFrame:
    """Gives sessions a new token and a new end; id, account and creation time stay.

    ``rotations`` has ``token``, ``newToken`` and ``rotatedAt``. Of several for one token the first
    counts, by ``rotatedAt``, then ``order``: after it, the old token is unknown. With ``now``, a session
    past its time that is asked for is deleted instead. One join does both.
    """
    first = F.min_by(F.struct("newToken", "rotatedAt"), F.struct("rotatedAt", order)).alias("turn")
    turns = rotations.where(~_absent(F.col("token"))).groupBy("token").agg(first)
    turned = sessions.join(turns, "token", "left")
    if now is not None:
        turned = turned.where(F.col("turn").isNull() | (F.col("expiresAt") >= instant(now)))
    return turned.select(
        "id",
        F.coalesce("turn.newToken", "token").alias("token"),
        "userId",
        F.coalesce(session_expires_at(F.col("turn.rotatedAt")), F.col("expiresAt")).alias("expiresAt"),
        "createdAt",
    )


def login_lookup(attempts: DataFrame, accounts: DataFrame, attempt_key: str = "attemptId") -> DataFrame:
    """Each login attempt with its account, or ``no_account``. Emails compare as written."""
    known = accounts.select(F.col("email").alias("match"), F.col("id").alias("userId"))
    asked = attempts.withColumn("match", _spread(F.col("email"), F.col(attempt_key)))
    hit = ~_absent(F.col("email")) & F.col("userId").isNotNull()
    return asked.join(known, "match", "left").select(
        *attempts.columns,
        F.when(hit, F.col("userId")).alias("userId"),
        F.when(hit, "account").otherwise("no_account").alias("outcome"),
    )
