"""Small tables with the awkward cases, and helpers."""

from pyspark.sql import types as T

SHAPE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Names that operators use inside; a table may have such columns of its own.
CLASHING = ["kept", "print", "row_key", "size", "bucket", "length", "score", "slot", "shard", "rank", "turn", "doc", "component_id", "host", "l", "r", "c", "no"]

WORDS = "the of and to in that was for with on river stone market winter garden letter silver window carried slowly between morning evening people small great house water light".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 7 or ""))
    return " ".join(out)


def awkward() -> list[tuple]:
    """Nulls in every column, empty and long texts, repeated rows, ties, emoji and control characters."""
    long = prose(5, 9000)
    return [
        (1, "one two three four five six", "en", "a", 10),
        (2, "one two three four five six", "en", "b", 10),
        (2, "one two three four five six", "en", "b", 10),
        (3, None, "en", "a", None),
        (4, "", None, "c", 0),
        (5, " \t\n ", "de", None, 4),
        (6, long, "en", "a", len(long)),
        (7, long, "en", "a", len(long)),
        (8, long + "!", "en", "a", len(long) + 1),
        (None, "no id here at all", "en", "a", 3),
        (None, "one two three four five six", None, None, None),
        (9, "héllo \U0001f600 wörld\x00 café İ", "fr", "b", 9),
        (10, prose(1, 60), "en", "z", 5),
        (11, prose(1, 60) + " tail", "en", "z", 5),
        (12, prose(2, 60), "en", "z", 5),
    ]


def frame(spark, rows=None, clash=False):
    df = spark.createDataFrame(awkward() if rows is None else rows, SHAPE)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("mine") for c in CLASHING})
    return df


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
