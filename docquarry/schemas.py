"""Declared schemas and fixed values of the document collection.

Timestamps carry no zone (``TIMESTAMP_NTZ``), as the stored tables do. No schema is ever inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Upload status, in life-cycle order.
UPLOAD_STATUSES = [
    "PENDING_UPLOAD",
    "UPLOAD_INITIALIZED",
    "UPLOAD_COMPLETED",
    "QUEUED",
    "PROCESSING",
    "COMPLETED",
    "FAILED",
]

# Fixed value: a status name of older rows and the one that replaced it.
RETIRED_STATUSES = {"PROCESSING_VECTORS": "PROCESSING"}

# Reasons a document can fail for.
FAILURE_REASONS = [
    "PASSWORD_PROTECTED",
    "CORRUPTED_FILE",
    "EMPTY_DOCUMENT",
    "OCR_REQUIRED",
    "EMBEDDING_FAILED",
    "PROCESSING_FAILED",
]

# File types an upload may have.
ALLOWED_MIME_TYPES = [
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "text/plain",
]

# Limits.
MAX_FILE_BYTES = 100 * 1024 * 1024
MAX_FILE_NAME = 255
MAX_PARTS = 10_000
SESSION_DAYS = 7
ACCESS_MINUTES = 15
FREE_UPLOADS_PER_MONTH = 50
FREE_QUESTIONS_PER_MONTH = 500


def _required(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, nullable=False)


# The password hash of an account is left out on purpose: it is never read.
ACCOUNTS = T.StructType([
    _required("id", T.StringType()),
    _required("name", T.StringType()),
    _required("email", T.StringType()),
    _required("emailVerified", T.BooleanType()),
    _required("createdAt", T.TimestampNTZType()),
    _required("updatedAt", T.TimestampNTZType()),
])

SESSIONS = T.StructType([
    _required("id", T.StringType()),
    _required("token", T.StringType()),
    _required("userId", T.StringType()),
    _required("expiresAt", T.TimestampNTZType()),
    _required("createdAt", T.TimestampNTZType()),
])

DOCUMENTS = T.StructType([
    _required("id", T.StringType()),
    _required("fileName", T.StringType()),
    _required("fileSize", T.LongType()),
    _required("mimeType", T.StringType()),
    _required("r2Key", T.StringType()),
    T.StructField("uploadId", T.StringType()),
    _required("status", T.StringType()),
    T.StructField("failureReason", T.StringType()),
    T.StructField("errorMessage", T.StringType()),
    _required("userId", T.StringType()),
    _required("createdAt", T.TimestampNTZType()),
    _required("updatedAt", T.TimestampNTZType()),
])

TABLES = {"accounts": ACCOUNTS, "sessions": SESSIONS, "documents": DOCUMENTS}
