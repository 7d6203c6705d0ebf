"""Rows that every operator must bear."""

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One  two"), (6, "one two three four"), (6, "one two three four"), (7, "onetwothreefour"),
    (None, "one two three four"), (None, None), (8, "größer ÉTÉ — 漢字 😀 l'été x"), (9, "a " * 30_000), (10, "word" * 20_000), (-5, "onetwo threefour "),
    (11, "12 34 !!"), (12, "\x0b\x0c\r"),
]


def got(df):
    return [tuple(r) for r in df.collect()]
