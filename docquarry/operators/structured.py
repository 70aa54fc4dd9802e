"""Passages that know their place: records of CSV files, sections of Markdown files under their headings.

Everything stays within the row, in a few passes over the text: it is cut at characters that say what
they part, marks are put where a record, field or section ends, and it is cut again there. Marks are
control characters; where a text has one itself it is written otherwise until the cutting is done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators.passages import chunk_documents

ESCAPE, OUTER, INNER = "\x1d", "\x1e", "\x1f"
#: Stands where quotes open, so that an empty field in quotes is not nothing.
QUOTED = ESCAPE + "q"


def guarded(text: Column) -> Column:
    """The text without OUTER and INNER."""
    plain = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "d"))
    return F.replace(F.replace(plain, F.lit(OUTER), F.lit(ESCAPE + "e")), F.lit(INNER), F.lit(ESCAPE + "f"))


def unguarded(text: Column) -> Column:
    text = F.replace(text, F.lit(QUOTED), F.lit(""))
    plain = F.replace(F.replace(text, F.lit(ESCAPE + "e"), F.lit(OUTER)), F.lit(ESCAPE + "f"), F.lit(INNER))
    return F.when(text.contains(ESCAPE), F.replace(plain, F.lit(ESCAPE + "d"), F.lit(ESCAPE))).otherwise(text)


def csv_records(text: Column, comma: str = ",") -> Column:
    """array<array<string>>: the fields of each record of a CSV text, as written, without quotes around them.

    A field in quotes may hold commas, line breaks, and quotes, which are doubled there. Records end at
    line breaks of any kind outside of quotes; a line without a character is none. A quote that is
    never closed goes on to the end. A null or empty text has no records.
    """

    def marked(parts: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            # outside of quotes are the parts with an even number; an empty one between two quotes is a quote
            inner = (i > 0) & (i < F.size(parts) - 1)
            outside = F.replace(F.regexp_replace(part, "\r\n|\r|\n", OUTER), F.lit(comma), F.lit(INNER))
            return F.when(i % 2 == 1, F.concat(F.lit(QUOTED), part)).when(inner & (part == ""), F.lit('"')).otherwise(outside)

        return F.array_join(F.transform(parts, one), "")

    parts = F.split(guarded(F.coalesce(text, F.lit(""))), '"', -1)
    joined = F.transform(F.array(parts), marked)[0]
    records = F.filter(F.split(joined, OUTER, -1), lambda r: r != "")
    return F.transform(records, lambda r: F.transform(F.split(r, INNER, -1), unguarded))


def csv_passages(documents: DataFrame, text: str = "text", comma: str = ",") -> DataFrame:
    """A row for each record after the first, which names the fields: ``record_no`` from 1 and ``passage``.

    A passage has a line ``name: value`` for each field; fields beyond the names are named by their
    number. Other columns pass through, the text does not.
    """
    carried = [c for c in documents.columns if c != text]

    def named(records: Column) -> Column:
        names = F.get(records, F.lit(0))

        def passage(record: Column) -> Column:
            name = lambda i: F.coalesce(F.get(names, i), F.concat(F.lit("field "), (i + 1).cast("string")))
            return F.array_join(F.transform(record, lambda v, i: F.concat(name(i), F.lit(": "), v)), "\n")

        return F.transform(F.slice(records, F.lit(2), F.greatest(F.size(records) - 1, F.lit(0))), passage)

    # within one expression, so that a file is cut once and not for each of its fields
    passages = F.transform(F.array(csv_records(F.col(text), comma)), named)[0]
    rows = documents.select(*carried, F.posexplode(passages).alias("_at", "passage"))
    return rows.select(*carried, (F.col("_at") + 1).alias("record_no"), "passage")


#: A fenced block with all its lines, or one line.
ITEM = r"(?m)(?:^ {0,3}(`{3,}|~{3,})[^\n]*(?:\n(?s:.*?)(?:^ {0,3}\1[`~]*[ \t\r]*$|\z)|\z)|^[^\n]*$)"
HEADING = r"^ {0,3}(#{1,6})(?:[ \t]|\r?$)"
BLANKS = " \t\r\n"


def markdown_sections(documents: DataFrame, text: str = "text") -> DataFrame:
    """A row for each section with a text: ``section_no`` from 1, ``level``, ``path`` and ``passage``.

    A heading is a line of one to six ``#`` and its title; ``path`` holds the titles from the outermost
    down to the section's own, parted by `` > ``, and is empty (level 0) before the first heading.
    Lines in fenced blocks are no headings. A section goes up to the next heading of any level, blank
    ends cut off; one that has nothing more is left out, but its title stands in the paths below it.
    Other columns pass through, the text does not. A null or blank text has no sections.
    """
    carried = [c for c in documents.columns if c != text]
    items = F.regexp_extract_all(guarded(F.coalesce(F.col(text), F.lit(""))), F.lit(ITEM), F.lit(0))
    marked = F.transform(items, lambda i: F.when(i.rlike(HEADING), F.concat(F.lit(OUTER), i)).otherwise(i))
    cut = F.split(F.array_join(marked, "\n"), OUTER, -1)

    def section(part: Column, i: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        title = F.regexp_replace(F.btrim(F.regexp_replace(head, r"^ {0,3}#{1,6}", ""), F.lit(BLANKS)), r"(^|[ \t]+)#+$", "")
        level = F.length(F.regexp_extract(head, r"^ {0,3}(#{1,6})", 1))
        body = F.substring(part, F.length(head) + 1, F.length(part))
        return F.struct(
            F.when(i > 0, level).otherwise(0).alias("level"), unguarded(title).alias("title"),
            unguarded(F.btrim(F.when(i > 0, body).otherwise(part), F.lit(BLANKS))).alias("passage"),
        )

    def step(state: Column, s: Column) -> Column:
        above = F.filter(state["stack"], lambda t: t["level"] < s["level"])
        stack = F.when(s["level"] > 0, F.array_append(above, F.struct(s["level"].alias("level"), s["title"].alias("title")))).otherwise(above)
        path = F.array_join(F.transform(stack, lambda t: t["title"]), " > ")
        found = F.struct(s["level"].alias("level"), path.alias("path"), s["passage"].alias("passage"))
        out = F.when(s["passage"] != "", F.array_append(state["out"], found)).otherwise(state["out"])
        return F.struct(stack.alias("stack"), out.alias("out"))

    start = F.struct(
        F.array().cast("array<struct<level:int,title:string>>").alias("stack"),
        F.array().cast("array<struct<level:int,path:string,passage:string>>").alias("out"),
    )
    found = F.aggregate(F.transform(cut, section), start, step, lambda s: s["out"])
    rows = documents.select(*carried, F.posexplode(found).alias("_at", "_s"))
    return rows.select(*carried, (F.col("_at") + 1).alias("section_no"), "_s.level", "_s.path", "_s.passage")


def file_passages(files: DataFrame, text: str = "text", name: str = "fileName") -> DataFrame:
    """``place`` and ``passage`` of all files by the ending of their name, read as records, sections or plain text.

    A place is ``record 3``, the path of headings, or ``character 700``: where a passage of a plain text
    begins. Records and sections longer than a passage of plain text are cut like one, each piece with
    the whole's place. A file without text has no rows. Other columns pass through.
    """
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    carried = [c for c in files.columns if c != text]
    numbered = lambda word, column: F.concat(F.lit(f"{word} "), F.col(column).cast("string"))
    records = csv_passages(files.where(ending == "csv"), text).select(*carried, numbered("record", "record_no").alias("place"), "passage")
    sections = markdown_sections(files.where(ending.isin("md", "markdown")), text).select(*carried, F.col("path").alias("place"), "passage")
    cut = chunk_documents(records.unionByName(sections), text="passage").select(*carried, "place", "passage")
    plain = chunk_documents(files.where(~ending.isin("csv", "md", "markdown") | F.col(name).isNull()), text=text)
    return cut.unionByName(plain.select(*carried, numbered("character", "start").alias("place"), "passage"))
