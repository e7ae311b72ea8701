"""Small documents with the cases that every operator must take."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, rid string, doc int, row string, ranges int, _pii int, n_chars long"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def edge_rows() -> list[tuple]:
    """Null text, null id, empty, white space, repeated rows, ties, a very long text, columns with clashing names."""
    a, b = prose(1, 120), prose(2, 90)
    texts = [
        (0, a), (1, None), (2, ""), (3, " \t\n "), (4, a), (4, a), (5, b + " " + a), (None, a), (None, None), (6, "é ünïcode   \x85 words " + b),
        (7, prose(3, 20_000, 50)), (8, "one"), (9, "one"), (10, "x" * 5000), (11, "ha " * 300), (12, "A" + a[1:]), (13, b), (14, a.upper()),
    ]
    return [(i, t, "r", 1, None, 7, 3, None if t is None else len(t)) for i, t in texts]


def edge_frame(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def key(row) -> tuple:
    return tuple((x is None, x) if not isinstance(x, bool) else (False, int(x)) for x in row)


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=key)
