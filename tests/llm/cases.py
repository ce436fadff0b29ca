"""Small tables with the awkward cases all operators must take."""

from pyspark.sql import types as T

SENTENCE = "the quick brown fox jumps over the lazy dog and runs through the old forest until night falls upon the quiet village"
NUMBERED = " ".join(f"word{k}" for k in range(60))

DOCS = [
    (1, SENTENCE), (2, SENTENCE.upper()), (3, SENTENCE + " again"), (4, NUMBERED), (5, NUMBERED.replace("word30", "changed")),
    (6, None), (7, ""), (8, " \t\n\x0b\x0c\r "), (9, "one two"), (10, "ONE  two"), (11, "x" * 5000), (12, "é" * 300 + "\n" + "日本語 " * 50),
    (None, SENTENCE), (None, None), (13, NUMBERED), (13, NUMBERED), (14, "a b c d e f g h " * 300), (15, "\n\n\n"), (16, "<|endoftext|> and ▁marks▁ 🎉"),
]


def frame(spark, rows, schema):
    """The rows with extra columns whose names operators use inside, and some nulls in them."""
    extra = ["ref", "key", "id", "n", "lines", "found", "host", "rule", "own_id", "c1", "evidence", "payload"]
    fields = list(T._parse_datatype_string(schema).fields) + [T.StructField(c, T.StringType()) for c in extra]
    return spark.createDataFrame([(*r, *(None if k % 2 else f"{c}{i}" for k, c in enumerate(extra))) for i, r in enumerate(rows)], T.StructType(fields))


def docs(spark, rows=DOCS):
    return frame(spark, rows, "doc_id long, text string")


def empty_docs(spark):
    return docs(spark, [])
