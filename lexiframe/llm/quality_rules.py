"""Quality rules: base counts of a text, and its distance from its language's usual histograms.

References are counted over all documents: per language the shares of character classes and of
the most common words. A document is compared by the Jensen-Shannon distance (base 2, 0 to 1).
Only Column expressions. The references are written first, a few words per language: Spark sees
the size of the written table and broadcasts it only while that is small, so texts never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import text_of
from lexiframe.plans.layout import written

# White space between words, symbols, and the character classes of the histogram
BLANK = r"\x20\x09-\x0D"
SYMBOLS = r"#*$%&|<>"
# (no two of which share a character).
CLASSES = {"letters": r"\p{L}", "digits": r"\p{N}", "blanks": BLANK, "symbols": SYMBOLS,
           "marks": r".,;:!?'\"()\-"}

WINDOW = 8  # a power of two
SLOTS = 512  # by the low bits of a word's hash, a power of two


def class_counts(rows: DataFrame) -> DataFrame:
    """Adds `in_<class>`, the characters (code points) of each class in `text`, and `n_chars_all`.

    The classes share no character, so each is counted and taken out of what the earlier left."""
    left, out = rows.withColumn("left_0", F.col("text")), []
    for k, (name, kind) in enumerate(CLASSES.items()):
        left = left.withColumn(f"left_{k + 1}", F.regexp_replace(f"left_{k}", f"[{kind}]+", ""))
        out.append((F.length(f"left_{k}") - F.length(f"left_{k + 1}")).cast("long").alias(f"in_{name}"))
    return left.select(*rows.columns, *out, F.length("text").cast("long").alias("n_chars_all"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")


def repeated_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more; windows are hashes by start.

    Sorted by hash, a repeated window equals a neighbour; the starts found cover
    min(WINDOW, gap to the next start) words each. Linear after the sort.
    """
    def starts(ranked: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(ranked, k)["h"] == p["h"], F.lit(False))
        return F.array_sort(F.transform(
            F.filter(F.transform(ranked, lambda p, k: F.struct(
                p["i"].alias("i"), (same(p, k - 1) | same(p, k + 1)).alias("again"))),
                lambda p: p["again"]),
            lambda p: p["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    held = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        held(ranked, lambda r: held(starts(r), covered)))


def window_hashes(hashes: Column) -> Column:
    """A hash of the WINDOW words from each start, by doubling: of two words, of four, of eight."""
    width = 1
    spans = hashes
    while width < WINDOW:
        spans = F.zip_with(spans, F.slice(spans, width + 1, F.size(hashes)), lambda x, y: F.xxhash64(x, y))
        width *= 2
    return F.when(F.size(hashes) >= WINDOW, F.slice(spans, 1, F.greatest(F.lit(0), F.size(hashes) - (WINDOW - 1))))


def base_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id, `words` and their `hashes`, the base counts and `base_failed`; null text counts as no words."""
    text = F.col("text")
    rows = docs.select(*keep, text_of().alias("text"))
    rows = rows.withColumn("words", words_of(text))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "windows": window_hashes(F.col("hashes")),
        "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))})
    rows = class_counts(rows).withColumns({
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.coalesce(repeated_words(F.col("windows")), F.lit(0)).cast("long")})
    return rows.select(
        *keep, "words", "hashes", "n_words", (F.col("n_chars_all") - F.col("in_blanks")).alias("word_chars"),
        F.col("in_symbols").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .alias("base_failed"), "n_chars_all", *[f"in_{name}" for name in CLASSES])


def _tongue() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def references(docs: DataFrame, top: int = 24) -> DataFrame:
    """Per language over all its documents: shares of the character classes and of the `top`
    most frequent words (ties by word), and the words counted. A null language is ''."""
    texts = docs.select(_tongue().alias("lang"), text_of().alias("text"))
    letters = class_counts(texts).groupBy("lang").agg(
        F.sum("n_chars_all").alias("chars"), *[F.sum(f"in_{name}").alias(name) for name in CLASSES])
    words = (texts.select("lang", F.explode(words_of(F.col("text"))).alias("word"))
             .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    common = _most_common(words, top)
    share = lambda n: F.when(F.col("chars") > 0, n / F.col("chars")).otherwise(0.0)
    rest = F.col("chars") - sum((F.col(name) for name in CLASSES), F.lit(0))
    return letters.join(common, "lang", "left").select(
        "lang", F.array(*[share(F.col(name)) for name in CLASSES], share(rest)).alias("ref_classes"),
        F.coalesce("ref_words", F.lit(0)).alias("ref_words"),
        F.coalesce(F.transform("best", lambda b: b["word"]), F.array().cast("array<string>")).alias("ref_top"),
        F.coalesce(F.transform("best", lambda b: b["n"] / F.col("ref_words")),
                   F.array().cast("array<double>")).alias("ref_shares"))


def _most_common(words: DataFrame, top: int) -> DataFrame:
    """The `top` words of each language, through many salted partial tops: no language's
    vocabulary meets in one task."""
    ordered = lambda c: F.slice(F.sort_array(F.collect_list(c), asc=True), 1, top)
    entry = F.struct((-F.col("n")).alias("less"), "word", "n")
    salted = words.groupBy("lang", F.pmod(F.xxhash64("word"), F.lit(1024)).alias("salt")).agg(
        F.sum("n").alias("n"), ordered(entry).alias("part"))
    total = salted.groupBy("lang").agg(F.sum("n").alias("ref_words"))
    best = (salted.select("lang", F.explode("part").alias("e"))
            .groupBy("lang").agg(ordered(F.col("e")).alias("best")))
    return total.join(best, "lang")


def divergence(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two aligned histograms of shares."""
    def half(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    terms = F.zip_with(shares, reference, lambda p, q: half(p, q) + half(q, p))
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def slots_of(top: Column) -> Column:
    """Per slot of a word's hash the place (from 1) of the reference word there; 0: none, -1: several."""
    def slot(s: Column) -> Column:
        here = F.filter(F.transform(top, lambda w, k: F.when(_slot(F.xxhash64(w)) == s, k + 1)), lambda k: k.isNotNull())
        return F.when(F.size(here) > 1, F.lit(-1)).otherwise(F.coalesce(F.get(here, F.lit(0)), F.lit(0)))

    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), slot)


def _slot(value: Column) -> Column:
    return value.bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def word_shares(words: Column, hashes: Column, top: Column, slots: Column, n: Column) -> Column:
    """Shares of the reference words in a document: place each word, sort, count the runs. A word
    is compared with the reference word of its slot; with all of them where several share one."""
    place = lambda w, s: F.when(s > 0, F.when(F.get(top, s - 1) == w, s).otherwise(0)).when(
        s < 0, F.array_position(top, w).cast("int")).otherwise(0)
    places = F.zip_with(words, F.transform(hashes, lambda h: F.get(slots, _slot(h))), place)
    places = F.sort_array(F.filter(places, lambda p: p > 0))
    held = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def counted(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda p, k: F.when(
            ~F.coalesce(F.get(s, k + 1) == p, F.lit(False)), k + 1)), lambda e: e.isNotNull())
        runs = held(ends, lambda e: F.transform(e, lambda x, k: F.struct(
            F.get(s, x - 1).alias("at"), (x - F.coalesce(F.get(e, k - 1), F.lit(0))).alias("n"))))
        return held(runs, lambda r: F.transform(top, lambda _, k: F.coalesce(
            F.get(F.filter(r, lambda x: x["at"] == k + 1), F.lit(0))["n"], F.lit(0)) / n))

    return held(places, counted)


def quality_rules(docs: DataFrame, top: int = 24, min_words: int = 50, min_reference: int = 1000,
                  max_class_distance: float = 0.28, max_word_distance: float = 0.42) -> DataFrame:
    """One row per document: doc_id, base counts, `base_failed`, both distances and `kept`.

    `kept` is false when the base rules fail or a distance exceeds its limit. Texts under
    `min_words` words, and languages with fewer than `min_reference` words, have no distances
    (NULL) and only the base rules decide. Null text counts as empty (fails: under 20 words); a
    null language has a reference of its own; repeated rows are judged one by one; extra columns
    are ignored; an empty table gives no rows.
    """
    refs = written(references(docs, top), "language_references")
    return _judged(docs, refs, min_words, min_reference, max_class_distance, max_word_distance)


def _judged(docs, refs, min_words, min_reference, max_class_distance, max_word_distance):
    rows = base_counts(docs.select("doc_id", "text", _tongue().alias("lang")), ["doc_id", "lang"])
    rows = rows.join(refs.withColumn("ref_slots", slots_of(F.col("ref_top"))), "lang", "left")
    long_enough = (F.col("n_words") >= min_words) & (F.col("ref_words") >= min_reference)
    classes = [F.col(f"in_{name}") for name in CLASSES]
    rest = F.col("n_chars_all") - sum(classes, F.lit(0))
    rest_of = lambda a: F.greatest(F.lit(0.0), 1 - F.aggregate(a, F.lit(0.0), lambda s, x: s + x))
    rows = rows.withColumn("shares", F.when(long_enough, word_shares(
        F.col("words"), F.col("hashes"), F.col("ref_top"), F.col("ref_slots"), F.col("n_words"))))
    rows = rows.withColumns({
        "class_distance": F.when(long_enough, divergence(
            F.transform(F.array(*classes, rest), lambda c: c / F.col("n_chars_all")), F.col("ref_classes"))),
        "word_distance": F.when(long_enough, divergence(
            F.concat("shares", F.array(rest_of(F.col("shares")))),
            F.concat("ref_shares", F.array(rest_of(F.col("ref_shares"))))))})
    usual = (F.coalesce(F.col("class_distance") <= max_class_distance, F.lit(True))
             & F.coalesce(F.col("word_distance") <= max_word_distance, F.lit(True)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", (~F.col("base_failed") & usual).alias("kept"),
                       "class_distance", "word_distance")
