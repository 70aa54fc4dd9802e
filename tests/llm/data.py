"""Small tables with the cases every operator must stand."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Columns of other rows and of the operators' own making, to clash with.
EXTRA = {"n_words": "7", "shard": "x", "token": "t", "id": "i", "fingerprint": "f", "start": "s", "length": "l", "key": "k", "_found": "f", "_quality": "q", "_row": "r"}

PROSE = "the quick brown fox jumps over the lazy dog while nine wise men sing old songs by the river bank at dawn"


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame(
        [(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA
    )


def odd_texts():
    """Null, empty, blank, one word, long words, control characters, repeats, other scripts, very long."""
    long = " ".join(f"word{i % 997} other{i % 89}" for i in range(20_000))
    return [
        None, "", "   \t\r\n\x0b\x0c ", "word", "word", PROSE, PROSE, PROSE + " ", "  " + PROSE.upper() + "  ", "x" * 70_000,
        "a b c d \u0085 e f", "ÀÉÎ Straße ﬁn Σας İstanbul", "漢字かな交じり文 はここ", "emoji 😀😀 👩‍👩‍👧 ok",
        "\x00 nul \x1f unit", "line\nline\nline\n\n \nother", "the the the the the the the the", long, long + " end",
        PROSE + " " + PROSE, "<s> </s> <unk> <|endoftext|> ▁▁ ▁a", "'s don't I'LL we'RE 12345 67.8",
    ]


def odd(spark):
    """The texts above, some ids null or repeated, a row repeated whole."""
    texts = odd_texts()
    ids = list(range(len(texts)))
    ids[3], ids[6], ids[8] = None, 5, None
    return table(spark, texts + [PROSE, PROSE, None], ids + [5, 5, None])


def store(df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def with_extra(df):
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


def rows(df, *names):
    """Rows as sorted tuples, nulls first."""
    found = [tuple(r) for r in (df.select(*names) if names else df).collect()]
    return sorted(found, key=lambda r: [(x is not None, x) for x in r])
