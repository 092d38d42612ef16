"""Near-duplicate documents by BagMinHash over the multiset of their five-word shingles.

A shingle's weight is how often it occurs. Each shingle owns Poisson processes over its
discretised weight, by intervals of doubling width; points below the weight compete for a random
component of the signature, and the earliest wins. Equal components estimate the weighted Jaccard
similarity without bias. Signatures are cut into bands; documents that share a band meet. Where
they meet, a byte of each component tells how many are equal, and a pair with fewer than one at the
threshold would have once in a million goes no further; the others are verified on 64-bit hashes of
the shingles themselves. So a passage that many documents share makes them meet, but moves nothing.

Meetings are not expanded into all pairs: a growing number of pivots per bucket is compared, each
once, with the later members that are of another component at that moment. Rounds go on until
every member has been a pivot or every bucket is one component. So of any two members the earlier
meets the later, unless they are of one component by then, and no link is lost inside a bucket.
The members of a large bucket meet in blocks: a task holds a bounded block of pivots and one of
members, compares their signatures, and only for those that may be alike their shingles; it gives
the links that join its parts, so that no pair of a large group is a row.
"""

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import Lookup, chunks, free, row_key, ship, text_of
from lexiframe.llm.packing import spans
from lexiframe.plans.layout import written
from lexiframe.plans.lookup import table_size

WORDS = 5
MARKS = ".,;:!?\"'()[]{}«»¿¡…-_*#"
_odd = np.random.default_rng(20).integers(1 << 62, 1 << 63, 16, dtype="u8") | np.uint64(1)
PLACES, MOST_PLACES = 1 << 26, 1 << 20
SMALL_WEIGHTS = 16 << 20
LEFT_OUT = 1e-6  # of the pairs at the threshold
LARGE = 32  # members; buckets of more meet in blocks, so a large group makes few rows of pairs
BLOCK, BLOCK_SHINGLES = 512, 1 << 20  # members of a block, and its shingles where texts are long


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes() -> Lookup:
    """word as written -> hash of its lower-case form without marks at its ends."""
    return Lookup(lambda w: xxhash.xxh64_intdigest(
        (w.lower().strip(MARKS) or w).encode("utf-8", "surrogatepass")))


def shingles(text: str, table: Lookup) -> np.ndarray:
    """Hashes of all five-word windows; a shorter text is one shingle, one without words none."""
    words = text.split()
    h = np.fromiter(map(table.__getitem__, words), "u8", len(words))
    if not len(h):
        return h
    if len(h) < WORDS:
        h = np.concatenate([h, np.full(WORDS - len(h), len(h), "u8")])
    n = len(h) - WORDS + 1
    return mix(sum(h[k:k + n] * _odd[k] for k in range(WORDS)))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash signatures (n by m) of weighted sets: rows of `owner`, `shingle`, `weight`."""
    levels = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(int)
    own = np.repeat(np.arange(len(shingle)), levels)
    level = np.arange(len(own)) - np.repeat(np.cumsum(levels) - levels, levels)
    owner, weight = owner[own], weight[own]
    seed = mix(shingle[own] + level.astype("u8") * _odd[6])
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)  # the level's interval of weights
    rate = np.where(level > 0, low, 1.0)  # its width, and so its rate of points
    time, used = np.zeros(len(own)), np.zeros(len(own), "i8")
    best, value = np.full(n * m, np.inf), np.zeros(n * m, "u8")
    while len(owner):
        many = np.bincount(owner, minlength=n)
        points = np.clip(-(-m // np.maximum(many, 1)), 1, 64)[owner]
        at = np.repeat(np.arange(len(owner)), points)
        first = np.cumsum(points) - points
        number = used[at] + np.arange(len(at)) - np.repeat(first, points) + 1
        h = mix(seed[at] + number.astype("u8") * _odd[7])
        gap = -np.log(((h >> np.uint64(11)).astype("f8") + 0.5) / 2.0 ** 53) / rate[at]
        run = np.cumsum(gap)
        t = run - np.repeat(run[first] - gap[first] - time, points)
        g = mix(h + _odd[8])
        slot = owner[at] * m + ((g >> np.uint64(32)) % np.uint64(m)).astype("i8")
        inside = low[at] + (g & np.uint64(0xFFFFFFFF)).astype("f8") / 2.0 ** 32 * rate[at] < weight[at]
        take = np.flatnonzero(inside & (t < best[slot]))
        np.minimum.at(best, slot[take], t[take])
        won = take[t[take] == best[slot[take]]]
        value[slot[won]] = h[won]
        time, used = t[first + points - 1], used + points
        live = np.flatnonzero(time < best.reshape(n, m).max(1)[owner])
        owner, seed, low, rate, weight, time, used = (
            x[live] for x in (owner, seed, low, rate, weight, time, used))
    return value.reshape(n, m)


def bands_of(signature: np.ndarray, bands: int) -> np.ndarray:
    n, m = signature.shape
    parts = signature.reshape(n, bands, m // bands)
    return mix(sum(parts[:, :, k] * _odd[k] for k in range(m // bands)) + _odd[9]).view("i8")


def marks_of(signature: np.ndarray) -> np.ndarray:
    """A byte of each component, seven to a whole number; bytes that are left are zero."""
    n, m = signature.shape
    out = np.zeros((n, -(-m // 7) * 7), "i8")
    out[:, :m] = mix(signature + _odd[12]) & np.uint64(255)
    return (out.reshape(n, -1, 7) << (8 * np.arange(7))).sum(2)


def equal_marks(x: str, y: str, m: int) -> Column:
    """How many components two signatures share, by their marks: an unequal pair of bytes leaves
    its high bit when 127 is added to its lower bits, an equal pair does not."""
    low, high = (sum(byte << (8 * k) for k in range(7)) for byte in (127, 128))
    words = -(-m // 7)
    equal = []
    for k in range(words):
        differ = F.col(x)[k].bitwiseXOR(F.col(y)[k])
        seen = (differ.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(differ)
        equal.append(7 - F.bit_count(seen.bitwiseAND(F.lit(high))))
    return reduce(Column.__add__, equal) - (words * 7 - m)


def least_equal(m: int, threshold: float) -> int:
    """The most equal components that a pair at the threshold misses once in a million at most."""
    missed, k = 0.0, 0
    while k <= m:
        missed += comb(m, k) * threshold ** k * (1 - threshold) ** (m - k)
        if missed > LEFT_OUT:
            return k
        k += 1
    return m


def _describe(texts: list[str], table: Lookup, bands: int, rows: int):
    """node (128 bits of the multiset), number of shingles and bands of each text."""
    sets = [np.unique(shingles(t, table), return_counts=True) for t in texts]
    sizes = [len(s) for s, _ in sets]
    every = np.concatenate([s for s, _ in sets])
    weight = np.concatenate([c for _, c in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    signed = signatures(owner, every, weight.astype("f8"), len(sets), bands * rows)
    keys = bands_of(signed, bands)
    node = []
    for s, c in sets:
        c = c.astype("u8")
        node.append((mix(s + _odd[10]) * c).sum(dtype="u8").tobytes() + (mix(s + _odd[11]) * c).sum(dtype="u8").tobytes())
    return node, [int(c.sum()) for _, c in sets], keys, marks_of(signed)


def describe(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, row key (a, b), node, total, bands and marks of every document."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", row_key().alias("key"), text_of().alias("text")).select(
        F.col("doc_id").cast("string").alias("doc"), F.col("key.a").alias("a"), F.col("key.b").alias("b"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = word_hashes()
        for batch in batches:
            every = batch["text"].tolist()
            for part in chunks(every):
                node, total, keys, marks = _describe(every[part], table, bands, rows)
                yield pd.DataFrame({"doc": batch["doc"].iloc[part].to_numpy(), "a": batch["a"].iloc[part].to_numpy(),
                                    "b": batch["b"].iloc[part].to_numpy(), "node": node, "total": total,
                                    "bands": list(keys), "marks": list(marks)})

    found = texts.mapInPandas(run, "doc string, a long, b long, node binary, total long, bands array<long>, marks array<long>")
    return found.withColumn("doc", F.col("doc").cast(kind))


def _weights(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its shingles (sorted 64-bit hashes) with counts, for the wanted (node, a, b), written.

    While they are few, their places among many go out first, so that other texts do not shuffle.
    """
    texts = docs.select(row_key().alias("key"), text_of().alias("text")).select(
        F.col("key.a").alias("a"), F.col("key.b").alias("b"), "text")
    if wanted.count() <= MOST_PLACES:
        place = lambda a, b: F.pmod(F.xxhash64(F.col(a), F.col(b)), F.lit(PLACES))
        places = wanted.select(place("a", "b").alias("place")).distinct()
        texts = texts.withColumn("place", place("a", "b")).join(F.broadcast(places), "place").drop("place")
    texts = texts.join(wanted, ["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = word_hashes()
        for batch in filter(len, batches):
            sets = [np.unique(shingles(t, table), return_counts=True) for t in batch["text"]]
            yield pd.DataFrame({"node": batch["node"], "items": [s.astype("<u8").tobytes() for s, _ in sets],
                                "counts": [c.astype("<u1" if c.max(initial=0) < 256 else "<u4").tobytes() for _, c in sets]})

    return (texts.select("node", "text").mapInPandas(run, "node binary, items binary, counts binary")
            .dropDuplicates(["node"]))


def _verified(pairs: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """The pairs (x, y) whose weighted Jaccard similarity reaches the threshold.

    A small table of shingles goes to the pairs, so that those of one large group do not carry
    theirs through two shuffles; a larger one is joined.
    """
    small = table_size(weights)[1] <= SMALL_WEIGHTS
    @F.pandas_udf("boolean")
    def alike(xi: pd.Series, xc: pd.Series, yi: pd.Series, yc: pd.Series) -> pd.Series:
        out = []
        for a, ac, b, bc in zip(xi, xc, yi, yc):
            a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            ac, bc = (np.frombuffer(c, "<u1" if len(c) == len(s) else "<u4").astype("i8") for c, s in ((ac, a), (bc, b)))
            _, p, q = np.intersect1d(a, b, True, True)
            both = int(np.minimum(ac[p], bc[q]).sum())
            out.append(both >= threshold * (int(ac.sum()) + int(bc.sum()) - both) - 1e-9)
        return pd.Series(out)

    side = lambda n: weights.select(F.col("node").alias(n), F.col("items").alias(f"{n}_items"),
                                    F.col("counts").alias(f"{n}_counts"))
    sent = F.broadcast if small else (lambda rows: rows)
    return (pairs.join(sent(side("x")), "x").join(sent(side("y")), "y")
            .filter(alike("x_items", "x_counts", "y_items", "y_counts")).select("x", "y"))


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component of links (x, y).

    Large-star and small-star rounds: every round is two aggregations and joins, hot nodes count
    through partial aggregates, and nothing is gathered anywhere.
    """
    edges = written(links.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
                    .filter("u != v").distinct(), "edges")
    edge = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    while True:
        # two edges of a row, not a union: that would double the plan each time
        both = edges.select(F.inline(F.array(edge("u", "v"), edge("v", "u"))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u != v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))  # every edge has u < v
        small = large.join(low, "v")
        new = written(small.select(F.inline(F.array(edge("m", "v"), edge("m", "u")))).filter("u != v").distinct(), "edges")
        # stars: no node is both a centre and a leaf, and each leaf has one centre
        stars = new.groupBy("v").count().filter("count > 1").isEmpty() and \
            new.join(new.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()
        edges = new
        if stars:
            leaves = edges.select(F.col("v").alias("node"), F.col("u").alias("label"))
            return leaves.unionAll(edges.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())


def _open(members: DataFrame, labels: DataFrame | None, low: int) -> DataFrame:
    """The members that have not been pivots, of buckets with several components, with their
    `label`, and `minor` for those outside the bucket's main component. Written: a round reads them
    several times, and each copy of their joins would be planned, and its small tables held, on the driver."""
    rows = members.filter(F.col("place") >= low)  # the earlier ones have met all others
    if labels is not None:
        rows = rows.join(labels.withColumnRenamed("label", "root"), "node", "left")
        rows = rows.withColumn("label", F.coalesce("root", "node")).drop("root")
    else:
        rows = rows.withColumn("label", F.col("node"))
    main = (rows.groupBy("bucket", "label").count().groupBy("bucket")
            .agg(F.max(F.struct("count", "label")).alias("most"), F.count(F.lit(1)).alias("labels"))
            .filter("labels > 1").select("bucket", F.col("most.label").alias("main")))
    return written(rows.join(main, "bucket").withColumn("minor", F.col("label") != F.col("main")).drop("main"), "open_members")


def _round(members: DataFrame, labels: DataFrame | None, low: int, high: int, m: int, least: int) -> DataFrame:
    """Pairs (x, y) of different components with `least` equal components or more: pivots of this
    round with the later members of their buckets. Members of a bucket's main component are joined
    only with pivots outside it."""
    rows = _open(members, labels, low)
    pivots = rows.filter(F.col("place") < high).select(
        "bucket", F.col("node").alias("x"), F.col("label").alias("x_label"), F.col("place").alias("x_place"),
        F.col("minor").alias("x_minor"), F.col("marks").alias("x_marks"))
    rows = rows.select("bucket", F.col("node").alias("y"), F.col("label").alias("y_label"),
                       F.col("place").alias("y_place"), "minor", F.col("marks").alias("y_marks"))
    # the test of marks is part of the join: pairs that fail it are never rows
    alike = F.expr("x_label != y_label AND (x_place < y_place OR (x_place = y_place AND x < y))") & (
        equal_marks("x_marks", "y_marks", m) >= least)
    met = rows.filter("minor").join(pivots, "bucket").filter(alike).select("x", "y").unionByName(
        rows.filter("NOT minor").join(pivots.filter("x_minor"), "bucket").filter(alike).select("x", "y"))
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


BLOCK_KEY = ["bucket", "p", "q"]


def _large(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members of large buckets with their bands, and `each`, the size of their bucket's blocks."""
    rows = members.filter(F.col("n") > LARGE).join(nodes.select("node", "bands", "total"), "node")
    longest = F.greatest(F.max("total"), F.lit(1))
    each = F.greatest(F.lit(4), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / longest))).cast("int")
    return rows.join(rows.groupBy("bucket").agg(each.alias("each")), "bucket").drop("total")


def _meet(left: pd.DataFrame, right: pd.DataFrame, m: int, least: int) -> pd.DataFrame:
    """The pairs of a block of pivots and a block of members that may be alike, in one row: its
    nodes, and pairs of their numbers. A pair is of the first band that it shares."""
    none = pd.DataFrame({"bucket": pd.Series(dtype="i8"), "p": pd.Series(dtype="i8"), "q": pd.Series(dtype="i8"),
                         "nodes": pd.Series(dtype=object), "pairs": pd.Series(dtype=object)})
    if not len(left) or not len(right):
        return none
    label = pd.factorize(pd.concat([left["label"], right["label"]]))[0]
    nodes, number = np.unique(np.array([*left["node"], *right["node"]], object), return_inverse=True)
    n, band = len(left), int(left["band"].iloc[0])
    marks, bands = ([np.array(side[c].tolist(), "i8") for side in (left, right)] for c in ("marks", "bands"))
    seen = [x.view("u1").reshape(len(x), -1) for x in marks]
    spare = seen[0].shape[1] - m  # bytes that no component has
    place, minor = ([side[c].to_numpy() for side in (left, right)] for c in ("place", "minor"))
    out = []
    for k in range(0, n, 32):
        s = slice(k, k + 32)
        x, y = number[:n][s, None], number[None, n:]
        later = (place[0][s, None] < place[1]) | ((place[0][s, None] == place[1]) & (x < y))
        wanted = later & (label[:n][s, None] != label[None, n:]) & (minor[0][s, None] | minor[1])
        a, b = np.nonzero(wanted)
        if len(a):
            a += k
            first = (bands[0][a] == bands[1][b]).argmax(1) == band
            a, b = a[first], b[first]
            close = (seen[0][a] == seen[1][b]).sum(1) - spare >= least
            out.append(np.stack([number[:n][a[close]], number[n:][b[close]]], 1))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), "i8")
    if not len(pairs):
        return none
    used, short = np.unique(pairs, return_inverse=True)
    key = left[BLOCK_KEY].iloc[0].tolist()
    return pd.DataFrame([[*key, nodes[used].tolist(), short.reshape(-1, 2).astype("<i4").tobytes()]], columns=none.columns)


def _blocks(large: DataFrame, labels: DataFrame | None, low: int, high: int, m: int, least: int) -> DataFrame:
    """Blocks (bucket, p, q) of pivots of this round and later members, with what may be alike."""
    rows = _open(large, labels, low).withColumn("own", F.floor(F.col("place") / F.col("each"))).select(
        "bucket", "band", "node", "marks", "bands", "label", "minor", "place", "own",
        F.floor(F.lit(low) / F.col("each")).alias("begin"),
        F.floor((F.least(F.lit(high), F.col("n")) - 1) / F.col("each")).alias("end"),
        F.floor(F.col("n") / F.col("each")).alias("last"))
    pivots = rows.filter(F.col("place") < high).withColumn("p", F.col("own")).withColumn(
        "q", F.explode(F.sequence("own", "last")))
    others = rows.filter(F.col("begin") <= F.least("own", "end")).withColumn("q", F.col("own")).withColumn(
        "p", F.explode(F.sequence("begin", F.least("own", "end"))))
    others = others.toDF(*others.columns)  # its own columns: the two sides come from the same rows
    return pivots.groupBy(BLOCK_KEY).cogroup(others.groupBy(BLOCK_KEY)).applyInPandas(
        lambda left, right: _meet(left, right, m, least),
        "bucket long, p long, q long, nodes array<binary>, pairs binary")


def _links(nodes: list, pairs: np.ndarray, sets: list, weights: list, threshold: float) -> list:
    """Pairs of nodes whose weighted Jaccard similarity reaches the threshold, as many as join the
    parts of a block: a pair of one part already is not compared."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every, weight = np.concatenate(sets), np.concatenate(weights).astype("i8")
    total = np.bincount(owner, weight, len(sets))
    order = np.argsort(every, kind="stable")
    every, owner, weight = every[order], owner[order], weight[order]
    part, found = np.arange(len(sets)), []
    order = np.argsort(pairs[:, 0], kind="stable")
    starts = np.flatnonzero(np.diff(pairs[order, 0], prepend=-1))
    for rows in np.split(pairs[order], starts[1:]):
        x, ys = rows[0, 0], np.unique(rows[:, 1])
        ys = ys[part[ys] != part[x]]
        if not len(ys):
            continue
        low, high = np.searchsorted(every, sets[x], "left"), np.searchsorted(every, sets[x], "right")
        at = spans(low, high)
        both = np.bincount(owner[at], np.minimum(weight[at], np.repeat(weights[x].astype("i8"), high - low)), len(sets))[ys]
        for y in ys[both >= threshold * (total[x] + total[ys] - both) - 1e-9]:
            if part[y] != part[x]:
                part[part == part[y]] = part[x]
                found.append((nodes[x], nodes[y]))
    return found


def _verified_blocks(blocks: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """The links (x, y) that join the parts of each block; a block's task gets its nodes' shingles once."""
    asked = blocks.select(*BLOCK_KEY, F.explode("nodes").alias("node"))
    table = F.broadcast(weights) if table_size(weights)[1] <= SMALL_WEIGHTS else weights

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nodes = list(left["nodes"].iloc[0])
        by = {node: k for k, node in enumerate(right["node"])}
        rows = [by[node] for node in nodes]
        sets = [np.frombuffer(right["items"].iloc[k], "<u8") for k in rows]
        counts = [np.frombuffer(c, "<u1" if len(c) == len(s) else "<u4")
                  for c, s in ((right["counts"].iloc[k], s) for k, s in zip(rows, sets))]
        pairs = np.frombuffer(left["pairs"].iloc[0], "<i4").reshape(-1, 2)
        return pd.DataFrame(_links(nodes, pairs, sets, counts, threshold), columns=["x", "y"])

    held = asked.join(table, "node")
    return blocks.groupBy(BLOCK_KEY).cogroup(held.toDF(*held.columns).groupBy(BLOCK_KEY)).applyInPandas(
        run, "x binary, y binary")


def near_groups(docs: DataFrame, threshold: float = 0.8, bands: int = 24, rows: int = 4) -> DataFrame:
    """One row per row of `docs`: doc_id, its key (a, b), class_id and the key of the class's
    first document (class_a, class_b; smallest doc_id, then key).

    Documents whose multisets of five-word shingles have a weighted Jaccard similarity of
    `threshold` or more are linked, and classes are the connected components. With 24 bands of 4
    a pair at 0.8 is missed about three times in a million, and once more by its marks. Words are lower-cased and lose marks
    at their ends. Texts without words (null, empty, blank) are copies of one another and form one
    class; a text under five words is one shingle. A null id sorts first. Repeated rows share a
    class; other columns are ignored. An empty table gives no rows.
    """
    found = written(describe(docs, bands, rows), "signatures")
    nodes = written(found.groupBy("node").agg(
        F.min(F.struct("doc", "a", "b")).alias("first"), F.first("bands").alias("bands"),
        F.first("marks").alias("marks"), F.first("total").alias("total")), "nodes")
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key")).select(
        "node", "band", F.xxhash64("band", "key").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a member's place in its bucket: random, about uniform over 0 .. n; a node comes early in all
    # its buckets or in none, so buckets of one group have the same pivots and a pair meets once
    places = keyed.join(sizes, "bucket").withColumn(
        "place", F.pmod(F.xxhash64("node"), F.lit(1 << 40)) / float(1 << 40) * F.col("n"))
    members = written(places.join(nodes.select("node", "marks"), "node"), "members")
    largest = members.agg(F.max("n")).first()[0] or 0
    small = members.filter(F.col("n") <= LARGE)
    large = written(_large(members, nodes), "large_buckets") if largest > LARGE else None
    labels = None
    m, links, low, high = bands * rows, None, 0, 16
    least = least_equal(m, threshold)
    while low < largest:
        pairs = written(_round(small, labels, low, high, m, least), "pairs") if low < LARGE else None
        blocks = written(_blocks(large, labels, low, high, m, least), "blocks") if large is not None else None
        sides = [] if pairs is None else [pairs.select(F.col(s).alias("node")) for s in ("x", "y")]
        sides += [blocks.select(F.explode("nodes").alias("node"))] if blocks is not None else []
        either = written(reduce(DataFrame.unionAll, sides).distinct(), "candidates")
        if not either.isEmpty():
            wanted = written(either.join(nodes, "node").select(
                "node", F.col("first.a").alias("a"), F.col("first.b").alias("b")), "wanted")
            weights = written(_weights(docs, wanted), "weights")
            found_now = [] if pairs is None else [_verified(pairs, weights, threshold)]
            found_now += [_verified_blocks(blocks, weights, threshold)] if blocks is not None else []
            new = written(reduce(DataFrame.unionAll, found_now), "links")
            if not new.isEmpty():
                links = new if links is None else links.unionAll(new)
                labels = written(components(links), "labels")
        low, high = high, high * 32
    classes = nodes.select("node", "first")
    if labels is not None:
        classes = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        firsts = classes.groupBy("label").agg(F.min("first").alias("lead"))
        classes = classes.join(firsts, "label").select("node", F.col("lead").alias("first"))
    return found.join(classes, "node").select(
        F.col("doc").alias("doc_id"), "a", "b", F.col("first.doc").alias("class_id"),
        F.col("first.a").alias("class_a"), F.col("first.b").alias("class_b"))


def drop_near(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each class, its first; the columns stay. Rows equal in id and
    text are one document, of which one row stays."""
    keep = (near_groups(docs, **options).filter("a = class_a AND b = class_b")
            .select("a", "b").distinct())
    key, a, b = free(docs, "key", "a", "b")
    rows = docs.withColumn(key, row_key()).withColumns({a: F.col(f"{key}.a"), b: F.col(f"{key}.b")}).drop(key)
    keep = keep.select(F.col("a").alias(a), F.col("b").alias(b))
    return rows.join(keep, [a, b]).dropDuplicates([a, b]).select(*docs.columns)
