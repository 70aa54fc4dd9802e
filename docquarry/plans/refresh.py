"""A batch of session refreshes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.sessions import refresh_outcomes, rotate_sessions


def refresh_sessions(
    requests: DataFrame, sessions: DataFrame, now: str | dt.datetime, request_key: str = "requestId"
) -> tuple[DataFrame, DataFrame]:
    """Sessions after the batch, and the outcome of each request.

    ``requests`` has ``token``, ``newToken`` and ``requestedAt``. An expired session that was asked for
    is deleted; a valid one gets its new token and end. Of several requests for one token the first, by
    time, then key, does so, and the others' token is unknown by then.
    """
    asked = requests.select("token", "newToken", F.col("requestedAt").alias("rotatedAt"), request_key)
    return rotate_sessions(sessions, asked, now, request_key), refresh_outcomes(requests, sessions, now, request_key)
