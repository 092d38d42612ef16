"""Packing by patterns of lengths, and its tokens against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import odd_documents
from tokenizers import Tokenizer

from lexiframe.llm import pattern_packing as pp
from lexiframe.llm import queries
from lexiframe.sources.tables import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return pp.WordEnds(open(PATH, encoding="utf-8").read())


def same(own, library, texts):
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_easy_character(own, library):
    assert own.fast is not None
    letters = [chr(k) for k in range(0x250)]
    same(own, library, [f"a{c}b {c} {c}s x{c}{c} '{c}9{c}" for c in letters])
    rng = random.Random(1)
    same(own, library, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(4000)])


def test_any_text(own, library):
    parts = ["a", "É", "é", "é", " ", "  ", "\n", "\t", "'s", "'LL", "don't", "1", "23", "²", "<|endoftext|>",
             "<|startoftext|>", "!?", "　", "\x1c", "́", "The", "ΣΑΣ", "中文", "🙂", "\x00", "\xa0", "İ", "ß"]
    rng = random.Random(2)
    same(own, library, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [""])


def test_whole_texts(spark, small, library):
    fresh = pp.WordEnds(open(PATH, encoding="utf-8").read(), most=500)  # forgets between batches
    texts = [r["text"] for r in table(spark, small, "documents").collect()]
    for k in range(0, len(texts), 20):
        same(fresh, library, texts[k:k + 20])


def holds(rows, texts, library, window=4096):
    """Every id once, gapless sequences, only long documents cut; the number of sequences."""
    held, pieces = defaultdict(int), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        part = ids[r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and r["offset"] == held[r["sequence_id"]]
        assert r["start"] == r["piece"] * window and r["length"] == min(window, len(ids) - r["start"])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        held[r["sequence_id"]] += r["length"]
        pieces[r["doc_id"]].append((r["piece"], r["length"], len(ids)))
    assert pieces.keys() == texts.keys()
    for found in pieces.values():
        assert [p for p, _, _ in sorted(found)] == list(range(len(found)))
        assert sum(n for _, n, _ in found) == found[0][2]
    assert max(held.values(), default=0) <= window
    return len(held), sum(held.values())


def test_query(spark, small, library):
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    sequences, ids = holds(queries.op13_pattern_packing(spark, small).collect(), texts, library)
    assert sequences <= -(-ids // 4096) + 1


def decreasing(lengths, window):
    """Best-fit decreasing, one length after the other."""
    rooms = []
    for size in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= size]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= size
        else:
            rooms.append(window - size)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_patterns_use_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.choice([16, 100, 1024]))
    draw = [rng.integers(1, window + 1, 400), np.minimum(window, rng.lognormal(3, 1.2, 900).astype(int) + 1),
            rng.choice([window // 2, window // 3, window // 2 + 1], 300)][seed % 3]
    lengths = Counter(draw.tolist())
    patterns = pp.plan_patterns(dict(lengths), window)
    used = Counter()
    for pattern, times in patterns:
        assert times > 0 and sum(size * n for size, n in pattern.items()) <= window
        for size, n in pattern.items():
            used[size] += n * times
    assert used == lengths
    assert sum(times for _, times in patterns) <= decreasing(draw, window) * 1.02 + 1


def test_fit_is_the_least_squares_one():
    """Patterns with known repeats are found again, and an unreachable histogram gives no slope."""
    patterns = pp.enumerate_patterns(np.array([10, 30, 45, 55, 70, 90, 100]), 100)
    assert (100,) in patterns and (90, 10) in patterns and (70, 30) in patterns and (45, 45, 10) in patterns
    assert all(sum(p) == 100 for p in patterns)
    known = np.zeros(101)
    for pattern, times in {(90, 10): 500, (70, 30): 250, (55, 45): 40}.items():
        known[list(pattern)] += times
    x = pp.fit_counts(patterns, known, 3000)
    used = np.zeros(101)
    for pattern, n in zip(patterns, x):
        for size in pattern:
            used[size] += n
    assert (x >= 0).all() and np.abs(used - known).max() < 1


def test_odd_documents_and_places_by_join(spark, library):
    for empty in (False, True):
        docs = odd_documents(spark, empty)
        for limit in (1 << 26, 0):  # places broadcast, places joined
            rows = pp.pack(docs, PATH, limit=limit).collect()
            assert sum(r["piece"] == 0 for r in rows) == docs.count()
            held = defaultdict(int)
            for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
                assert r["offset"] == held[r["sequence_id"]] and len(r["ids"]) == 4 * r["length"]
                held[r["sequence_id"]] += r["length"]
            assert all(n <= 4096 for n in held.values())
