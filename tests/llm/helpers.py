"""Small tables with everything that an operator must stand."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp string, line string, shard string, component string"


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("ab cd efg hij klmn opq rstu vwx yz".split()) + str(rng.randrange(40)) for _ in range(n)]


def odd_rows():
    """Null and empty texts, one word, blanks, a long text, ties, repeated rows, null ids, columns with the operators' own names."""
    base = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"),
        (3, None), (4, ""), (5, "word"), (6, " \t\n\x0b "), (7, " ".join(words(4000, 1))), (8, "ÄÖ " * 30), (9, "漢字\n漢字\n"), (10, "\x00 a b"),
        (11, " ".join(words(120, 2))), (11, " ".join(words(120, 2))), (None, " ".join(words(120, 2))), (None, None),
    ]
    return [(i, t, "en" if (i or 0) % 2 else None, None if i == 3 else f"s{(i or 0) % 3}", None if t is None else len(t), True, "x", "y", "z", None) for i, t in base]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


class Groups:
    """Union-find for brute-force answers."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
