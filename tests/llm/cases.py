"""Small tables with nulls, empty and long texts, repeats, ties and clashing column names."""

LONG = " ".join(f"word{i % 997} and {i}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 70),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "b", 70),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "b", 70),
    (3, "", "en", "a", 0),
    (4, None, None, None, None),
    (None, "le chat est sur la table avec les enfants et la souris", "fr", None, 50),
    (None, None, None, "a", None),
    (5, " \t\n ", None, "c", 4),
    (6, LONG, "en", "a", len(LONG)),
    (7, "der Hund und die Katze sind nicht in dem Haus mit dem Garten", "de", "c", 60),
    (8, "el perro y los gatos no están en la casa con el jardín \U0001f600 año", "es", "c", 60),
    (9, "12345 !!! ###", "en", "b", 13),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = "row k fp size h sk copies taken score found word left right base more label gone kept first pat kind token start end n".split()


def docs(spark, rows=None, extra=True):
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})
    return df


def write(df, folder, name="documents"):
    df.coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
