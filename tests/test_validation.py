import pytest
from pyspark.sql import functions as F

from docquarry.functions.text import utf16_length
from docquarry.operators.validation import (
    accepted_rows,
    error_rows,
    rejected_rows,
    split_accepted_rejected,
    validate_accounts,
    validate_uploads,
)
from docquarry.session import shared_path
from docquarry.sources.manifests import parse_requests

PDF = "application/pdf"
UPLOAD = "id int, fileName string, fileSize double, mimeType string"


def codes(df, key="id"):
    found = {}
    for row in error_rows(df, key).collect():
        found.setdefault(row[key], {})[row.field] = row.code
    return found


def test_upload_bounds(spark):
    rows = [
        (1, "a", 1.0, PDF),
        (2, "a", 0.0, PDF),
        (3, "a", 104857600.0, PDF),
        (4, "a", 104857601.0, PDF),
        (5, "a", 1.5, PDF),
        (6, "a", None, PDF),
        (7, "", 1.0, PDF),
        (8, "x" * 255, 1.0, PDF),
        (9, "x" * 256, 1.0, PDF),
        (10, "x" * 253 + "😀", 1.0, PDF),
        (11, "x" * 254 + "😀", 1.0, PDF),
        (12, None, -1.5, "text/html"),
        (13, "a", float("nan"), None),
        (14, "a", float("inf"), PDF),
        (15, "a", -3.0, PDF),
    ]
    checked = validate_uploads(spark.createDataFrame(rows, UPLOAD))
    assert codes(checked) == {
        2: {"fileSize": "too_small"},
        4: {"fileSize": "too_big"},
        5: {"fileSize": "invalid_type"},
        6: {"fileSize": "invalid_type"},
        7: {"fileName": "too_small"},
        9: {"fileName": "too_big"},
        11: {"fileName": "too_big"},
        12: {"fileName": "invalid_type", "fileSize": "invalid_type", "mimeType": "invalid_value"},
        13: {"fileSize": "invalid_type", "mimeType": "invalid_value"},
        14: {"fileSize": "invalid_type"},
        15: {"fileSize": "too_small"},
    }


def test_part_limit_is_an_error_when_a_part_size_is_given(spark):
    rows = [(1, "a", 100_000.0, PDF), (2, "a", 100_001.0, PDF)]
    checked = validate_uploads(spark.createDataFrame(rows, UPLOAD), part_size=10)
    assert codes(checked) == {2: {"fileSize": "too_many_parts"}}


def test_allowed_types_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "a", 1.0, "text/markdown")], UPLOAD)
    assert codes(validate_uploads(df)) and not codes(validate_uploads(df, allowed_mime=["text/markdown"]))


def test_accepted_and_rejected_make_up_the_input(spark):
    rows = [(i, "a" * (i % 3), float(i), PDF) for i in range(50)]
    checked = validate_uploads(spark.createDataFrame(rows, UPLOAD), max_bytes=40)
    accepted, rejected = split_accepted_rejected(checked, shared_path(spark, "split"))
    assert accepted.count() + rejected.count() == 50
    assert accepted.schema["fileSize"].dataType.simpleString() == "bigint"
    assert {r.id for r in accepted.collect()} == {r.id for r in accepted_rows(checked).collect()}
    assert {r.id for r in rejected.collect()} == {r.id for r in rejected_rows(checked).collect()}


def test_empty_batch(spark):
    checked = validate_uploads(spark.createDataFrame([], UPLOAD))
    accepted, rejected = split_accepted_rejected(checked, shared_path(spark, "split"))
    assert accepted.count() == rejected.count() == 0


def test_manifest_fields_keep_their_json_type(spark):
    lines = [
        '{"fileName":"a.txt","fileSize":1.0,"mimeType":"text/plain"}',
        '{"fileName":7,"fileSize":"7","mimeType":null}',
        '{"fileName":"b","fileSize":true}',
        "[1]",
        "nope",
        "",
    ]
    rows = parse_requests(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.fileName, r.fileSize, r.mimeType, r.malformed) for r in rows] == [
        ("a.txt", 1.0, "text/plain", False),
        (None, None, None, False),
        ("b", None, None, False),
        (None, None, None, True),
        (None, None, None, True),
        (None, None, None, True),
    ]


@pytest.mark.parametrize(
    ("email", "good"),
    [
        ("a@b.co", True),
        ("a.b+c@d-e.org", True),
        ("o'neil@example.com", True),
        (".a@b.co", False),
        ("a..b@c.co", False),
        ("a.@b.co", False),
        ("a@b", False),
        ("a@b.c", False),
        ("a@-b.co", False),
        ("a b@c.co", False),
        ("a@b.co\n", False),
        ("", False),
        (None, False),
    ],
)
def test_email(spark, email, good):
    df = spark.createDataFrame([(1, "Jo", email)], "id int, name string, email string")
    assert (codes(validate_accounts(df)) == {}) is good


def test_account_name(spark):
    df = spark.createDataFrame(
        [(1, "J", "a@b.co"), (2, "Jo", "a@b.co"), (3, "😀", "a@b.co"), (4, None, "a@b.co")],
        "id int, name string, email string",
    )
    assert codes(validate_accounts(df)) == {1: {"name": "too_small"}, 4: {"name": "invalid_type"}}


def test_utf16_length(spark):
    row = spark.createDataFrame([("a😀é",)], "t string").select(utf16_length(F.col("t"))).head()
    assert row[0] == 4


def test_a_repeated_field_keeps_its_last_value(spark):
    lines = [
        '{"fileName":"a","fileName":"b","fileSize":"7","fileSize":2}', '{"fileName":"a"} x', '{"fileName":"a"}, {"fileName":"b"}',
        '[{"fileName":"z"}]', "null", "", None, ' {"fileSize":1.0,"mimeType":null} ', '{"fileName":"a"',
    ]
    rows = parse_requests(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.fileName, r.fileSize, r.malformed) for r in rows] == [
        ("b", 2.0, False), (None, None, True), (None, None, True), (None, None, True), (None, None, True), (None, None, True),
        (None, None, True), (None, 1.0, False), (None, None, True),
    ]


def test_whole_sizes_of_any_magnitude(spark):
    sizes = [1e300, 1e19, 0.5, float("inf"), float("-inf"), float("nan"), None, 2.0, -3.0]
    rows = spark.createDataFrame([("a", x, "text/plain") for x in sizes], "fileName string, fileSize double, mimeType string")
    codes = [[e.code for e in r.errors] for r in validate_uploads(rows).collect()]
    bad = ["invalid_type"]
    assert codes == [["too_big"], ["too_big"], bad, bad, bad, bad, bad, [], ["too_small"]]
