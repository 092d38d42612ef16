"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are alike when their normal forms (lower case, blanks collapsed) are at most one edit
apart. Lines become hashes and places; texts do not move until the end. A line can only have a
neighbour if it shares its first or last half with another line, then everything but one part of
64 characters; only such parts emit their deletion variants as hashed keys. All lines under one
variant key (place of the deletion included) are at most one edit apart, so linking each to the
earliest loses nothing, and no pairs within a group are made.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import free, row_key, text_of
from lexiframe.plans.layout import written

OTHER_BLANK = r"\x09-\x0D\x{85}\x{A0}"
BLANK = r"\x20" + OTHER_BLANK
PART = 64
PLACES = 1 << 20  # values of the bounded pre-filter


def normal(line: Column) -> Column:
    # a single space is no match: most lines are left as they are
    return F.trim(F.regexp_replace(F.lower(line), f"[{BLANK}]{{2,}}|[{OTHER_BLANK}]", " "))


def has_words(line: Column) -> Column:
    """Whether the normal form is not empty."""
    return line.rlike(f"[^{BLANK}]")


def _hash(*parts) -> Column:
    """128 bits as a struct."""
    return F.struct(F.xxhash64(F.lit(11), *parts).alias("a"), F.xxhash64(F.lit(12), *parts).alias("b"))


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line, with words or not: `at` (order of occurrence: id, row key, position), `raw`."""
    rows = docs.select("doc_id", row_key().alias("key"), F.posexplode(F.split(text_of(), "\n")).alias("pos", "raw"))
    return rows.select(F.struct("doc_id", F.col("key.a").alias("a"), F.col("key.b").alias("b"), "pos").alias("at"), "raw")


def _substr(text: Column, start: Column | int, size: Column) -> Column:
    return F.substring(text, F.lit(start) if isinstance(start, int) else start, size)


def _half_keys() -> Column:
    """The line without its first or second half, as the longer or the shorter of a pair.

    A pair one edit apart has lengths (m, m) or (m, m - 1). Cut at m // 2: the edit lies in one
    part, so what is left of it or right of it agrees, counted from that end.
    """
    size = F.length("line")
    keys = []
    for more in (0, 1):
        m = size + more
        cut = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(m, F.lit(0), _substr(F.col("line"), 1, cut)),
                 F.xxhash64(m, F.lit(1), F.right(F.col("line"), m - cut))]
    return F.array(*keys)


def distinct_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """hash, `at` of the first occurrence, half keys (empty for lines under `min_chars`)."""
    # a test of the normal form would run its expressions twice, in the filter and behind it
    lines = _lines(docs).filter(has_words(F.col("raw"))).select("at", normal(F.col("raw")).alias("line"))
    lines = lines.select("at", _hash("line").alias("h"), F.when(
        F.length("line") >= min_chars, _half_keys()).otherwise(F.array().cast("array<bigint>")).alias("keys"))
    four = [F.get("keys", F.lit(k)).alias(f"k{k}") for k in range(4)]
    return (lines.select("h", "at", *four).groupBy("h")
            .agg(F.min("at").alias("at"), *[F.min(f"k{k}").alias(f"k{k}") for k in range(4)]))


def _shared(rows: DataFrame, key: str, line: str) -> DataFrame:
    """Rows whose key belongs to two different lines or more. Counts are combined before they
    move, and the join can be split where a key is hot."""
    name = free(rows, "hot")[0]
    hot = (rows.groupBy(F.col(key).alias(name))
           .agg(F.min(line).alias("low"), F.max(line).alias("high")).filter("low != high").select(name))
    return rows.join(hot, rows[key] == hot[name]).drop(name)


def near_lines(docs: DataFrame, firsts: DataFrame, min_chars: int) -> DataFrame:
    """`at` of first occurrences that have an earlier line one edit away."""
    keyed = firsts.filter("k0 IS NOT NULL").select(
        F.col("h.a").alias("line_id"), "at", F.explode(F.array("k0", "k1", "k2", "k3")).alias("k"))
    likely = written(_shared(keyed, "k", "line_id").select("at").distinct(), "likely_lines")
    place = lambda at: F.pmod(F.xxhash64(at["a"], at["b"], at["pos"]), F.lit(PLACES))
    places = likely.select(place(F.col("at")).alias("place")).distinct()  # at most PLACES rows
    lines = _lines(docs)
    lines = (lines.withColumn("place", place(F.col("at"))).join(F.broadcast(places), "place").drop("place")
             .join(likely, "at"))  # not a semi-join: Spark would move that below the pre-filter
    lines = lines.dropDuplicates(["at"]).select("at", normal(F.col("raw")).alias("line"))  # of these few lines only
    parts = written(_parts(lines), "line_parts")
    variants = _variants(_shared(parts, "part", "line_id"))
    earliest = variants.groupBy("variant").agg(F.min(F.struct("at", "mid")).alias("first"))
    pairs = variants.join(earliest, "variant").filter(
        (F.col("first.at") < F.col("at")) & (F.levenshtein("mid", F.col("first.mid")) <= 1))
    return pairs.select("at").distinct()


def _parts(lines: DataFrame) -> DataFrame:
    """Each line without each of its parts: `part` is a hash of all but the part, `mid` the part."""
    size = F.length("line")
    rows = lines.select("at", "line", F.xxhash64(F.lit(13), "line").alias("line_id"),
                        F.explode(F.array(size, size + 1)).alias("m"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / PART).cast("int"))).alias("p"))
    start = F.col("p") * PART
    rest = F.greatest(F.lit(0), F.col("m") - start - PART)  # characters after the part
    rows = rows.withColumns({
        "part": _hash("m", "p", _substr(F.col("line"), 1, start), F.right(F.col("line"), rest)),
        "mid": _substr(F.col("line"), start + 1, F.length("line") - start - rest),
        "width": F.least(F.lit(PART), F.col("m") - start),
        "whole": F.length("line") == F.col("m")})
    return rows.select("at", "line_id", "part", "mid", "width", "whole")


def _variants(parts: DataFrame) -> DataFrame:
    """The longer lines' parts with each character deleted; the shorter ones' as they are, once
    for each place where the other may have one more."""
    rows = parts.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("i"))
    cut = F.when(F.col("whole"), F.concat(
        _substr(F.col("mid"), 1, F.col("i")), F.substring(F.col("mid"), F.col("i") + 2, F.lit(PART)))
    ).otherwise(F.col("mid"))
    return rows.select("at", "mid", _hash(F.col("part.a"), F.col("part.b"), "i", cut).alias("variant"))


def dedup_lines(docs: DataFrame, min_chars: int = 16, counts: bool = False) -> DataFrame:
    """`docs` without lines that an earlier line repeats.

    A line goes if an earlier one (by doc_id, then position) has the same normal form, or, both
    having at least `min_chars` characters, one that differs by one edit. Blank lines stay. A null
    text stays null and counts as empty. Rows equal in doc_id and text are one document: they keep
    the same lines; rows of one id with different texts are ordered by a hash of the text; a null
    id comes first. Other columns pass through, `n_chars` is counted anew if it is there. An empty
    table gives no rows. `counts` adds n_lines and n_kept (lines with words; clashing names get an
    underscore).
    """
    firsts = written(distinct_lines(docs, min_chars), "distinct_lines")
    gone = near_lines(docs, firsts, min_chars)
    kept = (firsts.select("at").join(gone, "at", "left_anti")
            .groupBy(F.col("at.a").alias("a"), F.col("at.b").alias("b"))
            .agg(F.sort_array(F.collect_list(F.col("at.pos"))).alias("kept")))
    key, a, b, mask, lines, n_lines, n_kept = free(
        docs, "key", "a", "b", "mask", "lines", "n_lines", "n_kept")
    kept = kept.select(F.col("a").alias(a), F.col("b").alias(b), F.encode(F.array_join(F.transform(
        "kept", lambda p, k: F.concat(F.repeat(F.lit("0"), p - F.coalesce(F.get("kept", k - 1), F.lit(-1)) - 1),
                                      F.lit("1"))), ""), "UTF-8").alias(mask))  # a byte per line: 1 stays
    rows = docs.withColumn(key, row_key()).withColumns({a: F.col(f"{key}.a"), b: F.col(f"{key}.b")}).drop(key)
    rows = rows.join(kept, [a, b], "left").withColumn(lines, F.split(text_of(), "\n"))
    stays = lambda x, k: (F.coalesce(F.substring(F.col(mask), k + 1, F.lit(1)), F.lit(b"")) == F.lit(b"1")) | ~has_words(x)
    text = F.array_join(F.filter(lines, stays), "\n")
    out = {"text": F.when(F.col("text").isNotNull(), text).alias("text")}
    columns = [out.get(c, F.col(c)) for c in docs.columns]
    if counts:
        held = F.coalesce(F.length(F.regexp_replace(F.decode(F.col(mask), "UTF-8"), "0", "")), F.lit(0))
        columns += [F.size(F.filter(lines, has_words)).cast("long").alias(n_lines),
                    held.cast("long").alias(n_kept)]
    rows = rows.select(*columns)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(
            docs.schema["n_chars"].dataType))
    return rows
