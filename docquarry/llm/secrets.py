"""Secrets in whole texts: keywords found by one automaton, patterns tried only there, check sums verified."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keywords (fixed values), in small letters, and the kind whose pattern is tried where one is found.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
    "api_key": "assign", "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
#: Patterns (fixed values), anchored at a keyword.
PATTERNS = {
    "assign": re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z_])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z_])"),
}
HEX = re.compile(r"[0-9a-f]{32,}")
ORDER = ["assign", "access", "hex", "github", "npm"]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Letters A to Z to small ones, all else as it is, so that positions stay.
SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def check_digits(body: str) -> str:
    """The CRC-32 of a token's body in base 62, six digits."""
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0")


def valid(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return match.end(2) - match.start(2) >= 8
    if kind == "access":
        return match.end() - match.start() >= 16
    return check_digits(match[1]) == match[2]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def find(text: str, keywords) -> list[tuple[str, int, int]]:
    """kind, start, end of the secrets, by start, then kind.

    For each kind the leftmost matches that do not overlap, those that fail their test left out after.
    Runs of hexadecimal digits have no keyword; one pattern scans for them.
    """
    spans = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    hits = sorted((end - size + 1, kind) for end, (size, kind) in keywords.iter(text.translate(SMALL)))
    past = dict.fromkeys(PATTERNS, 0)
    for start, kind in hits:
        if start >= past[kind] and (match := PATTERNS[kind].match(text, start)):
            past[kind] = match.end()
            if valid(kind, match):
                spans.append((kind, start, match.end()))
    return sorted(spans, key=lambda s: (s[1], ORDER.index(s[0])))


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))


def find_secrets(df: DataFrame, text: str = "text", spans: str = "_spans") -> DataFrame:
    """The rows with the secrets of their texts: array<struct<kind, start, end>>, in code points, end exclusive.

    Whole texts, each row by itself, no shuffle. A null text has none, like an empty one. Other columns
    pass through; ``spans`` names the new one and must not be taken.
    """
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t.as_py() or "", keywords)] for t in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], [*batch.schema.names, spans])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(spans, SPANS)]))


def joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))
    return find_secrets(documents).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"),
    )
