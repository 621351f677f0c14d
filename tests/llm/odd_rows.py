"""Rows that operators must survive."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()),
                     T.StructField("_key", T.StringType()), T.StructField("node", T.StringType())])

PROSE = " ".join(f"word{i % 37} and the{i % 11} of{i} it" for i in range(60))
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
#: Nulls in every column, empty, blank and symbol-only texts, copies, repeated rows, a very long text; clashing extra columns.
ODD = [(1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, PROSE + " extra tail", None, None), (3, PROSE + " extra tail", None, None),
       (4, None, "en", "a"), (5, "", "fr", "b"), (6, " \n\t ", "fr", "b"), (7, "*** ###", None, "b"), (8, "*** ###", "en", None),
       (None, PROSE + "\nshort line", "en", "a"), (None, None, None, None), (9, LONG, "en", "a"), (10, "two words", "de", "a"),
       (11, "It's <|startoftext|> É ﬁ \u0301x!\x00 end.", "fr", "c")]
