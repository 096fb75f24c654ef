"""Rows that any operator must stand: nulls, empty and long texts, ties, repeats, extra
columns with names that clash."""

LONG = " ".join(f"word{i % 977} lorem" for i in range(20_000))
ROWS = [
    (1, "The same text here, with words enough.", "en", "a", 1, "x"),
    (2, "The same  text here,\nwith words enough.", "en", "a", 1, "x"),
    (2, "The same  text here,\nwith words enough.", "en", "a", 1, "x"),
    (3, None, None, None, None, None),
    (4, "", "en", "b", 0, None),
    (5, " \t\n ", "en", "b", 3, "x"),
    (6, LONG, "en", "b", len(LONG), "x"),
    (None, "A text without an id.", "en", None, 1, "x"),
    (None, None, None, None, None, "x"),
    (7, "12 345 !!", "de", "c", 1, "x"),
    (8, "Ein deutscher Satz über Größe und Maß der Dinge.", "de", "c", 1, "x"),
    (9, "Straße 𝔘 中文 é é <|endoftext|> it's", "de", "\u00e9", 1, "x"),
]
SHAPE = "doc_id long, text string, lang string, source string, score long, keep_id string"


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SHAPE)
