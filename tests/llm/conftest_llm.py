"""Rows that every operator must stand: nulls, blanks, repeated rows and ids, long texts."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two"), (None, "no id here at all"), (6, "é ß Σ ﬁ \U0001f642"),
    (7, "long " * 3000), (8, "dup text of five words"), (8, "dup text of five words"), (9, "dup text of five words"),
]
