"""Rows that every operator has to stand: nulls, empty, blank, repeated and very long texts."""

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c d e f g h i j k l m n o p q r s t"), (4, "a b c d e f g h i j k l m n o p q r s t"), (4, "a b c d e f g h i j k l m n o p q r s t"), (5, "x\n" * 4000), (6, "é" * 70000), (7, "word " * 30000)]


def crafted(k):
    """Two words of 2 ** k letters that are equal under any polynomial hash modulo 2 ** 64, from k = 10 or so on."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b
