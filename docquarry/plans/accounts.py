"""Batches of sign-ups and log-ins: what each request came to, and the rows that follow.

Passwords and tokens are not made or checked here: requests bring the token their session gets, and
log-ins are taken as having passed the password check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.uploads import row_id, session_expires_at
from docquarry.operators.catalog import delete_where, new_accounts
from docquarry.operators.sessions import login_lookup
from docquarry.operators.validation import accepted_rows, validate_accounts
from docquarry.schemas import ACCOUNTS, SESSIONS


def _new_sessions(granted: DataFrame, moment: str) -> DataFrame:
    return granted.select(
        row_id(F.col("userId"), F.col("token")).alias("id"),
        "token",
        "userId",
        session_expires_at(F.col(moment)).alias("expiresAt"),
        F.col(moment).alias("createdAt"),
    ).select(*SESSIONS.names)


def sign_up(requests: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New accounts, their first sessions, and ``requestId`` with its outcome.

    ``requests`` has ``requestId``, ``name``, ``email``, ``token`` and ``requestedAt``. Outcomes are
    ``invalid``, ``exists`` (also for all but the first request with a new email) and ``created``.
    Write accounts and sessions to new paths and switch both over together.
    """
    checked = validate_accounts(requests)
    granted = new_accounts(accepted_rows(checked), accounts, "requestedAt", "requestId")
    granted = granted.withColumn("userId", row_id(F.col("email")))
    created = granted.select(
        F.col("userId").alias("id"),
        "name",
        "email",
        F.lit(False).alias("emailVerified"),
        F.col("requestedAt").alias("createdAt"),
        F.col("requestedAt").alias("updatedAt"),
    ).select(*ACCOUNTS.names)
    won = granted.select("requestId", F.lit(True).alias("won"))
    outcome = F.when(F.size("errors") > 0, "invalid").when(F.col("won"), "created").otherwise("exists")
    outcomes = checked.join(won, "requestId", "left").select("requestId", outcome.alias("outcome"))
    return created, _new_sessions(granted, "requestedAt"), outcomes


def log_in(attempts: DataFrame, accounts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions after a batch of log-ins: one more each, and none of the account's expired ones.

    ``attempts`` has ``attemptId``, ``email``, ``token`` and ``attemptedAt``. Every log-in sweeps what
    had expired by then, so the account's last one decides; sessions of other accounts stay.
    """
    granted = login_lookup(attempts, accounts).where(F.col("outcome") == "account")
    last = granted.groupBy("userId").agg(F.max("attemptedAt").alias("lastLogin"))
    held = sessions.unionByName(_new_sessions(granted, "attemptedAt")).join(last, "userId", "left")
    return delete_where(held, F.col("expiresAt") < F.col("lastLogin")).select(*SESSIONS.names)
