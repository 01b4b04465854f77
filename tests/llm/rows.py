"""Small documents that hold the awkward cases, and helpers to compare."""

import re

from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
PROSE = "The river runs past the old mill and the miller counts his sacks of grain before the rain comes down from the hills again."
OTHER = "Nobody in the village could remember who had planted the walnut trees that stand along the road to the northern bridge."

TEXTS = [
    (0, PROSE + "\n" + OTHER + " " + PROSE.replace("river", "stream").replace("rain", "snow"), "en", "a"),
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, " \t\n ", "de", None),
    (4, "one", "en", "b"),
    (5, "One", "en", "b"),
    (6, "Write to anna.b@mail.example.com or +1 (555) 123-4567, from 10.0.0.1 with 4111 1111 1111 1111.", "en", "b"),
    (7, "Write to anna.b@mail.example.com or +1 (555) 123-4567, from 10.0.0.1 with 4111 1111 1111 1111.", "en", "c"),
    (8, "bad 999.1.1.1 and 4111111111111112 and +1 23 and a@b and x..y@z.co. 1.2.3.4.5.6.7.8 é@ü.de ñ+34 612 345 678", "es", "c"),
    (9, "Der Fluß 中文 😀 <|endoftext|> ▁x ﬁ ÄÖÜ\x00", "de", "é"),
    (10, (PROSE + " ") * 400, "en", "a"),
    (11, "home | news | about | contact\nhome | news | about | contact\nclick here\n" + PROSE, "en", "a"),
    (12, "Released under the MIT License.\n" + PROSE, "en", "a"),
    (12, "Released under the MIT License.\n" + PROSE, "en", "a"),
    (None, PROSE, None, "a"),
    (14, PROSE, "en", "a"),
    (15, "!!! ### $$$ %%% ### $$$ " * 20, "en", "b"),
    (16, " ".join(f"word{i}" for i in range(120)) + ".", "en", "d"),
    (17, " ".join(f"word{i}" for i in range(118)) + " x y.", "en", "d"),
]

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for their own columns
        *(T.StructField(c, T.StringType()) for c in ("size", "key", "node", "shard", "spans", "kept", "email", "component", "unit", "bin")),
    ]
)


def table(spark, rows=None):
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *["x"] * 10) for i, t, lang, s in rows], SCHEMA)


def words(text):
    return re.findall(WORD, text or "")


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, list) else (True, "list", str(x)) for x in r))
