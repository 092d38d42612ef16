"""Plain-Python counterparts of the text-pipeline operators, and odd tables to run them on."""

import random
import re
from collections import Counter

CLASHES = ("ids", "decoded", "base", "spans", "key", "a", "b", "kept", "line", "node", "bucket", "mask",
           "lines", "is_toxic", "insult", "posterior", "quality", "words", "n_words", "h", "at", "place", "pos")

PROSE = "the cat sat on a mat while rain fell over old stone walls and nobody came home for supper today".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(PROSE) for _ in range(n))


def odd_rows(seed: int = 5) -> list[tuple]:
    """Nulls, empty and blank texts, a very long one, repeated rows, ties and odd characters."""
    rng = random.Random(seed)
    long = "\n".join(prose(rng, 40) + "." for _ in range(400))
    texts = [None, "", " \n\t ", "one", prose(rng, 60), prose(rng, 60), long, "é中　\x1c  !", "a" * 5000,
             "mail me at ann@example.com or +1 (212) 555-0100\nLicensed under CC BY-NC 4.0.", "\n\n\n", "x\nx\nx"]
    rows = [(k, t, "en", "s", 0 if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], rows[0], (None, texts[5], None, None, None), (None, None, None, None, None),
             (4, texts[5], "en", "s", 7)]
    return rows


def odd_documents(spark, empty: bool = False):
    """The odd rows with extra columns whose names clash with those the operators use."""
    from pyspark.sql import functions as F
    rows = [] if empty else odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(name).alias(name) for name in CLASHES]).repartition(3)


def shingle_counts(text: str) -> Counter:
    marks = ".,;:!?\"'()[]{}«»¿¡…-_*#"
    words = [w.lower().strip(marks) or w for w in text.split()]
    if not words:
        return Counter()
    if len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def jaccard(x: Counter, y: Counter) -> float:
    both = sum((x & y).values())
    every = sum((x | y).values())
    return both / every if every else 1.0


def classes(sets: dict) -> dict:
    """id -> smallest id of its component of links at 0.8, by all pairs."""
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            if jaccard(sets[x], sets[y]) >= 0.8:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {k: find(k) for k in ids}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def normal(line: str) -> str:
    return re.sub("[\\x09-\\x0D\\x20\\x85\\xA0]+", " ", line.lower()).strip(" ")


def dedup_lines(rows: list[tuple], least: int) -> dict:
    seen, out = [], {}
    for key, text in rows:
        kept = []
        for line in text.split("\n"):
            n = normal(line)
            again = n and any(n == s or (min(len(n), len(s)) >= least and one_edit(n, s)) for s in seen)
            if not again:
                kept.append(line)
            if n:
                seen.append(n)
        out[key] = "\n".join(kept)
    return out
