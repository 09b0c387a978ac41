"""Rows that every operator must take: nulls, empty and very long texts, ties, repeats, clashing extra columns."""

TEXTS = [
    (1, "The cat sat on the mat. It's fine, isn't it?\nNew line here.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "  two  spaces\tand tab \n\n end ", "en"),
    (5, "naïve café — ελληνικά ΣΑΣ 日本語 é  nbsp \U0001f600", "fr"),
    (6, "<|endoftext|> spelled <|startoftext|> out <|endoftext|>", "en"),
    (7, "word " * 5000 + "end", "en"),
    (7, "a repeated id", "en"),
    (8, "The cat sat on the mat. It's fine, isn't it?\nNew line here.", "de"),
    (None, "a row without an id", "en"),
    (9, "x" * 3000, "en"),
    (10, "one", "en"),
    (-4, "12 345 6,789.00 $$ ## don't we'll THE The the", "en"),
]


def docs(spark, rows=TEXTS):
    """``documents`` with columns whose names operators use inside."""
    data = [(i, t, lang, "src0", len(t or ""), 0, "clash", 7) for i, t, lang in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, size int, key string, rank int").repartition(3)
