import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators.structured import csv_passages, csv_records, guarded, markdown_sections, unguarded

MARKS = ["\x1d", "\x1e", "\x1f", "\x1dd", "\x1de", "a", "e", "d", ""]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_marks_in_a_text_come_back(spark):
    random.seed(1)
    texts = ["".join(random.choices(MARKS, k=random.randrange(9))) for _ in range(500)]
    for r in frame(spark, texts).select("text", guarded(F.col("text")).alias("g"), unguarded(guarded(F.col("text"))).alias("u")).collect():
        assert r.u == r.text and "\x1e" not in r.g and "\x1f" not in r.g


def test_records_as_the_csv_module_reads_them(spark):
    random.seed(2)
    parts = ["a", "b c", ",", '"', "\n", "\r\n", "é😀", "", " ", "\x1e", "\x1f", "\x1d", "1"]
    texts, want = [], []
    for _ in range(400):
        rows = [["".join(random.choices(parts, k=random.randrange(5))) for _ in range(random.randrange(1, 5))] for _ in range(random.randrange(1, 5))]
        out = io.StringIO()
        csv.writer(out, lineterminator=random.choice(["\n", "\r\n"]), quoting=random.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows(rows)
        texts.append(out.getvalue())
        want.append([r for r in csv.reader(io.StringIO(out.getvalue(), newline="")) if r])
    found = frame(spark, texts).select("id", csv_records(F.col("text")).alias("r")).orderBy("id").collect()
    for r, rows, text in zip(found, want, texts):
        assert r.r == rows, repr(text)


@pytest.mark.parametrize("text, want", [
    (None, []), ("", []), ("name", []), ("\n\n", []), ("a,b\n1,2", ["a: 1\nb: 2"]), ("a,b\r\n1,2\r\n\r\n3,4\r\n", ["a: 1\nb: 2", "a: 3\nb: 4"]),
    ('a\n"x\ny, ""z"""\n', ['a: x\ny, "z"']), ("a\n1,2,3", ["a: 1\nfield 2: 2\nfield 3: 3"]), ("a,b\n1", ["a: 1"]), ('a\n"open\nend', ["a: open\nend"]),
    ('a,b\n"",', ["a: \nb: "]),
])
def test_csv_passages(spark, text, want):
    found = csv_passages(frame(spark, [text])).orderBy("record_no").collect()
    assert [r.passage for r in found] == want and [r.record_no for r in found] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("text, want", [
    (None, []), ("", []), (" \n\t", []), ("just text\nmore", [(0, "", "just text\nmore")]),
    ("# A\n\none\n## B ##\ntwo\n# C\nthree\n", [(1, "A", "one"), (2, "A > B", "two"), (1, "C", "three")]),
    ("intro\n### Deep\nx\n# Top\n## Empty\n#### Low\ny", [(0, "", "intro"), (3, "Deep", "x"), (4, "Top > Empty > Low", "y")]),
    ("# A\n```\n# no heading\n```\n## B\nz", [(1, "A", "```\n# no heading\n```"), (2, "A > B", "z")]),
    ("# A\n~~~~ py\n# no\n~~~\n# still no\n~~~~\nw\n# B\nv", [(1, "A", "~~~~ py\n# no\n~~~\n# still no\n~~~~\nw"), (1, "B", "v")]),
    ("# A\n```\n# never closed\n## no", [(1, "A", "```\n# never closed\n## no")]),
    ("#no heading\n####### seven\n    # code\n   # Yes\r\nt\r\n", [(0, "", "#no heading\n####### seven\n    # code"), (1, "Yes", "t")]),
    ("#\ntext\n# C# and F#\nu", [(1, "", "text"), (1, "C# and F#", "u")]),
    ("# mark \x1e\x1f\x1d here\nbody \x1e", [(1, "mark \x1e\x1f\x1d here", "body \x1e")]),
    ("```\n```\n# A\nx", [(0, "", "```\n```"), (1, "A", "x")]),
])
def test_sections(spark, text, want):
    found = markdown_sections(frame(spark, [text]).withColumn("other", F.lit("kept"))).orderBy("section_no").collect()
    assert [(r.level, r.path, r.passage) for r in found] == want and all(r.other == "kept" for r in found)


def test_long_files(spark):
    lines = "\n".join(f"## h{i}\nbody {i}\n" for i in range(3_000))
    table = "n,v\n" + "\n".join(f'{i},"v\n{i}"' for i in range(20_000))
    assert markdown_sections(frame(spark, ["# T\n" + lines])).where(F.col("path") == F.concat(F.lit("T > h"), F.col("section_no") - 1)).count() == 3_000
    assert csv_passages(frame(spark, [table])).count() == 20_000
    fenced = "```\n" + "# x\n" * 100_000 + "```\n# end\nz"
    assert [r.path for r in markdown_sections(frame(spark, [fenced])).collect()] == ["", "end"]
