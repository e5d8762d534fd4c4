"""Small document and page tables with every odd case that operators must handle."""

from pyspark.sql import functions as F

WORDS = ("alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa "
         "quebec romeo sierra tango uniform victor whiskey xray yankee zulu").split()


def prose(seed: int, n: int) -> str:
    """``n`` words that depend on the seed."""
    return " ".join(WORDS[(seed * 7 + i * (seed % 5 + 3) + i * i) % len(WORDS)] + str((seed * i) % 11)
                    for i in range(n))


def odd_documents() -> list[tuple]:
    """(doc_id, text) with nulls, empties, copies, ties, repeated rows and a long text."""
    base = [(i, prose(i, 30 + i)) for i in range(12)]
    return [*base, (100, None), (101, ""), (102, " \t\n "), (103, "one"), (104, "one two three four"),
            (105, prose(3, 33)), (105, prose(3, 33)), (106, "\n" + prose(3, 33).replace(" ", " \n\t ")),
            (107, prose(3, 33).upper()), (108, "é ß 日本 \U0001f600 ÀÉ"), (109, prose(77, 20_000)),
            (110, "x" * 50_000), (None, prose(4, 34)), (None, None)]


def frame(spark, rows, extra: bool = True):
    """Documents; with columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if extra:
        df = df.withColumns({c: F.lit(f"own {c}") for c in (
            "key", "norm", "kept", "row", "component_id", "n_shingles", "idx", "grade", "h", "tail", "ids", "host")})
    return df


def empty(spark):
    return frame(spark, [])
