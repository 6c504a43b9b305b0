"""Small awkward tables that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i * 7919 % 997} tail{i % 13}" for i in range(6000))
PROSE = (
    "The river bends twice before it meets the old mill, and every spring the water carries small stones down from the "
    "hills where shepherds once kept their flocks through long and quiet summers."
)


def awkward_rows():
    return [
        (1, PROSE, "en", "a", None),
        (2, PROSE, "en", "a", 5),  # a copy
        (3, None, None, None, None),
        (4, "", "en", "", 0),
        (5, " \t\n ", "en", "b", 3),
        (6, "one two", "en", "b", 7),
        (6, "one two", "en", "b", 7),  # a repeated row
        (None, PROSE + " And more.", "en", "a", 1),
        (8, LONG, "xx", "c", len(LONG)),
        (9, "x" * 30000, "xx", "c", 30000),
        (10, "é" * 50 + "\n" + "İstanbul ǅ \U0001f600 漢字", "xx", "c", 1),
        (11, "same line of five words\nsame line of five words\nother", "en", "b", 1),
    ]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def wider(df):
    """The table with further columns, named as those that operators make."""
    from pyspark.sql import functions as F

    names = "key node rank n bits comp slot start block row tokens kept score list_id text_a line source_name units degree at share"
    return df.select("*", *[F.lit("x").alias(n) for n in names.split()])
