"""Plain-Python counterparts, used to check the operators by brute force."""

import random
import re

WORDS = "the cat dog sat ran home a in of river stone cloud light".split()


def sentences(text):
    body = text.strip(" \t\r\n")
    return [s for s in re.split(r"(?<=[.!?])[ \t\r\n]+", body) if s]


def words(sentence):
    return re.sub("[^a-zA-Z]", " ", sentence).lower().split()


def random_texts(n, seed=7, longest=40):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            size = rng.randint(0, longest)
            chosen = [rng.choice(WORDS[:rng.randint(1, len(WORDS))]) for _ in range(size)]
            parts.append(" ".join(chosen) + rng.choice([".", "!?", "..."]))
        texts.append("  " + " ".join(parts) + " \n")
    return texts


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
