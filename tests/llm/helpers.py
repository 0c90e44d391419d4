"""Small tables with the awkward cases, and plain Python versions of the operators."""

import hashlib
import random
import re

WORDS = "the of and anemone river Étoile straße ñandú wind, stone. light Ündér paper 42 x|y".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def awkward_documents(seed=7):
    """Rows (doc_id, text, lang, source, n_chars, _k1, h1, token): nulls, empties, copies, ties, long texts, clashing names."""
    rnd = random.Random(seed)
    body = [sentence(rnd, rnd.randint(1, 60)) + "\n" + sentence(rnd, rnd.randint(1, 60)) for _ in range(30)]
    texts = [None, "", " \n\t ", "a", "A b", *body, body[0], body[0].upper(), body[1] + "\n" + body[2], body[3] + " end"]
    texts += [sentence(rnd, 6000), "word " * 3000, "日本語のテキスト 😀 " * 40]
    rows = [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["s0", None]), len(t or ""), "clash", 3, None) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, body[4], "en", "s0", 1, None, None, "t"), (None, None, None, None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, h1 int, token string"


def documents(spark, rows=None):
    rows = awkward_documents() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_id(rows):
    """Sorted multiset of result rows."""
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


class Groups:
    """Union by smallest."""

    def __init__(self, items):
        self.parent = {i: i for i in items}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
