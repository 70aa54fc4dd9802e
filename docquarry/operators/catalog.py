"""The catalog of accounts and documents: filters, cards, keyed joins, row changes, state, counts.

Shuffle notes. The key side of every semi or anti join is reduced to its distinct keys first
(``key_set``): that runs before the shuffle, so a key holding a third of the rows arrives as one row
per task. Hot keys on the row side are split by AQE's skew join. No side is broadcast by hint:
Catalyst and AQE do so from the measured size, and fall back to a sort-merge join beyond it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import contains_text
from docquarry.functions.uploads import error_text, interface_status, relative_age, status_label
from docquarry.schemas import FAILURE_REASONS, UPLOAD_STATUSES


# -- filters and projections ------------------------------------------------------------------

def search_documents_by_name(documents: DataFrame, query: str, column: str = "fileName") -> DataFrame:
    """Documents whose name contains ``query``, in any case. The empty query keeps all."""
    return documents if query == "" else documents.where(contains_text(F.col(column), query))


def public_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.select("id", "name", "email")


def document_cards(documents: DataFrame, now: str | dt.datetime) -> DataFrame:
    """What the document grid shows: name, status with its label, and age."""
    return documents.select(
        "id",
        F.col("fileName").alias("name"),
        interface_status(F.col("status")).alias("status"),
        status_label(F.col("status")).alias("label"),
        relative_age(F.col("createdAt"), now).alias("uploadedAt"),
    )


def documents_of_account(documents: DataFrame, user_id: str) -> DataFrame:
    return documents.where(F.col("userId") == user_id)


def documents_in_status(documents: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Documents in any of ``statuses``; reads only their folders in a catalog partitioned by status."""
    unknown = set(statuses) - set(UPLOAD_STATUSES)
    if unknown:
        raise ValueError(f"unknown status: {sorted(unknown)}")
    return documents.where(F.col("status").isin(*statuses))


def documents_failed_for(documents: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """Failed documents with any of these reasons."""
    unknown = set(reasons) - set(FAILURE_REASONS)
    if unknown:
        raise ValueError(f"unknown reason: {sorted(unknown)}")
    return documents_in_status(documents, ["FAILED"]).where(F.col("failureReason").isin(*reasons))


def abort_candidates(documents: DataFrame) -> DataFrame:
    """Failed documents that still hold an open multipart upload."""
    return documents.where((F.col("status") == "FAILED") & F.col("uploadId").isNotNull()).select(
        "id", "r2Key", "uploadId", error_text(F.col("errorMessage")).alias("errorMessage")
    )


# -- keyed joins --------------------------------------------------------------------------------

def key_set(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Distinct non-null keys, combined before the shuffle."""
    return df.select(F.col(column).alias(name or column)).where(F.col(name or column).isNotNull()).distinct()


def lookup_by_key(requests: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` whose key is asked for at least once."""
    return base.join(key_set(requests, key), key, "left_semi")


def new_rows(incoming: DataFrame, existing: DataFrame, key: str, *order: str) -> DataFrame:
    """First row of each key in ``incoming``, by ``order``, unless the key already exists.

    The first row is found by a min that combines before the shuffle, not by a window. Rows without a
    key cannot be told apart and are not taken in; ``keyless_rows`` gives them.
    """
    rest = [c for c in incoming.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("row")
    firsts = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(first)
    fresh = firsts.join(key_set(existing, key), key, "left_anti")
    return fresh.select(key, "row.*").select(*incoming.columns)


def keyless_rows(incoming: DataFrame, key: str) -> DataFrame:
    """The rows of ``incoming`` that ``new_rows`` leaves out because they have no key."""
    return incoming.where(F.col(key).isNull())


def new_accounts(incoming: DataFrame, accounts: DataFrame, *order: str) -> DataFrame:
    """Sign-ups to create: emails not yet known, compared as written, one per email."""
    return new_rows(incoming, accounts, "email", *order)


def _owned(accounts: DataFrame, rows: DataFrame) -> DataFrame:
    owners = public_accounts(accounts).select(
        F.col("id").alias("userId"), F.col("name").alias("userName"), F.col("email").alias("userEmail")
    )
    return rows.join(owners, "userId", "inner")


def account_documents(accounts: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents with the public columns of their account."""
    return _owned(accounts, documents)


def account_sessions(accounts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions with the public columns of their account."""
    return _owned(accounts, sessions)


def orphan_rows(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose key has no parent. A null key refers to nothing and is no orphan."""
    known = key_set(parent, parent_key, child_key)
    return child.where(F.col(child_key).isNotNull()).join(known, child_key, "left_anti").select(*child.columns)


def cascade_delete(deleted_ids: DataFrame, child: DataFrame, child_key: str = "userId") -> DataFrame:
    """What is left of ``child`` once the accounts in ``deleted_ids.id`` are gone."""
    return delete_rows(child, deleted_ids.select(F.col("id").alias(child_key)), child_key)


# -- row changes --------------------------------------------------------------------------------

def delete_rows(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``base`` without the given keys. A key that is not there is no error."""
    return base.join(key_set(keys, key), key, "left_anti").select(*base.columns)


def delete_where(base: DataFrame, condition: Column) -> DataFrame:
    """``base`` without the rows that meet ``condition``; a null condition deletes nothing."""
    return base.where(~F.coalesce(condition, F.lit(False)))


def upsert_rows(base: DataFrame, changes: DataFrame, key: str, *order: str) -> DataFrame:
    """``base`` with the last change of each key, by ``order``, put in or added.

    One join, each side read once. Rows without a key meet nothing: those of ``base`` stay, spread over
    the tasks by their values, and the last change without a key is added. Write the result to a new path and switch readers over;
    ``base`` may be a table on disk.
    """
    columns = [F.col(c) for c in base.columns if c != key]
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("row")
    spread = F.when(F.col(key).isNull(), F.xxhash64(*columns)).otherwise(F.lit(0).cast("long")).alias("_spread")
    held = base.select(key, spread, F.struct(*columns).alias("held"))
    lasts = changes.groupBy(key).agg(last).withColumn("_spread", F.lit(0).cast("long"))
    joined = held.join(lasts, [key, "_spread"], "full_outer")
    return joined.select(key, F.coalesce("row", "held").alias("row")).select(key, "row.*").select(*base.columns)


# -- state and counts ----------------------------------------------------------------------------

def latest_document_state(log: DataFrame, key: str = "id", *order: str) -> DataFrame:
    """Newest row of each document in a change log, combined per task before the shuffle."""
    order = order or ("updatedAt", "seq")
    rest = [c for c in log.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return log.groupBy(key).agg(newest).select(key, "row.*").select(*log.columns)


def document_status_counts(documents: DataFrame) -> DataFrame:
    """Documents per account and status."""
    return documents.groupBy("userId", "status").agg(F.count("*").alias("documents"))


def document_status_table(documents: DataFrame) -> DataFrame:
    """One row per account, one column per status; absent statuses count 0."""
    wide = documents.groupBy("userId").pivot("status", UPLOAD_STATUSES).agg(F.count("status"))
    return wide.na.fill(0, UPLOAD_STATUSES)
