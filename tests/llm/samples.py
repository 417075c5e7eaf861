"""Small tables with the awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


def documents() -> list[tuple]:
    """Copies, near copies, shared passages, repeats within a text, and rows without text."""
    texts: dict[int | None, str | None] = {}
    base = words(1, 120)
    texts[10] = " ".join(base)
    texts[11] = texts[10]
    texts[12] = " ".join([*base[:50], "changed", *base[51:]])
    texts[13] = " ".join([*base[:20], "and", "more", *base[20:], "tail"])
    passage = words(2, 40)
    texts[20] = " ".join(words(3, 60) + passage + words(4, 60))
    texts[21] = " ".join(words(5, 200) + passage)
    texts[22] = "\n".join(passage[:20] + words(6, 10) + passage[20:])
    texts[23] = " ".join(words(7, 50) * 2)
    texts[30] = "Über ÉCOLE\tétait <|endoftext|> it's 10 o'clock …"
    texts[31] = "same"
    texts[32] = "same"
    texts[33] = "a b c d"
    texts[34] = "A  b\nC d"
    texts[40] = None
    texts[41] = ""
    texts[42] = " \n\t "
    texts[43] = "漢字 🎉 ▁   x"
    texts[50] = " ".join(words(8, 20_000))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    return [*rows, (11, texts[11], "en", "s", 1), (60, texts[20], None, None, None), (None, "no number here", "en", "s", 3)]


def frame(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """The rows, with columns whose names operators might use themselves."""
    df = spark.createDataFrame(documents() if rows is None else rows, DOCUMENTS).repartition(3)
    for name in ("key", "parts", "own", "stays", "left_id", "sid", "n", "score"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def empty(spark: SparkSession) -> DataFrame:
    return frame(spark, [])
