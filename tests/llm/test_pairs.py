"""Line dedup, near-duplicates and search against brute force; SQL for what SQL can say."""

import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import difference, tables, type_difference
from lexiframe.llm import line_dedup, near_dup, queries, search
from lexiframe.plans.layout import written
from lexiframe.sources.tables import table


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, small, name):
    got = queries.QUERIES[name](spark, small)
    want = tables(small).sql(queries.ORACLE[name])
    assert type_difference(got, want) is None
    assert difference(got.toPandas(), want.df()) is None


@pytest.mark.parametrize("least", [16, 3])
def test_line_dedup(spark, least):
    rng = random.Random(2)
    base = ["the quick brown fox", "lazy dog sleeps", "a" * 70 + "bcd", "x y z " * 30, "short", "", "  ",
            "éàü ñandú größe", "0123456789" * 13]

    def changed(line):
        out = list(line)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k, kind = rng.randrange(len(out) + 1), rng.random()
            if kind < 0.4:
                out.insert(k, rng.choice("abé z"))
            elif kind < 0.7 and k < len(out):
                out[k] = rng.choice("abq")
            elif k < len(out):
                del out[k]
        return "".join(out)

    rows = [(i, "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 9)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, least).collect()}
    assert got == brute.dedup_lines(rows, least)


def test_lines_are_made_normal_once(spark):
    docs = spark.createDataFrame([(1, "a line with some words")], "doc_id long, text string")
    plan = line_dedup.distinct_lines(docs, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        ids = rng.integers(0, 1 << 62, 200, dtype="u8")
        a = rng.integers(0, 9, 200)
        b = np.where(rng.random(200) < 0.6, a, rng.integers(0, 9, 200))
        owner = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        signed = near_dup.signatures(owner, np.concatenate([ids[a > 0], ids[b > 0]]),
                                     np.concatenate([a[a > 0], b[b > 0]]).astype(float), 2, 512)
        errors.append((signed[0] == signed[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.035


def near_texts(seed=6):
    """Families of copies: exact, near, and just beyond the threshold."""
    rng, texts = random.Random(seed), []
    for _ in range(12):
        words = [rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 12)):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = "z" + str(rng.randrange(400))
            texts.append(" ".join(w.upper() if rng.random() < 0.05 else w for w in own))
    return list(enumerate(texts))


def test_near_duplicates(spark):
    rows = near_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_groups(docs).collect()}
    want = brute.classes({k: brute.shingle_counts(t) for k, t in rows})
    assert got == want
    assert {r["doc_id"] for r in near_dup.drop_near(docs).collect()} == set(want.values())


def test_one_large_group(spark):
    """A bucket of many near copies becomes one class, without all pairs."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for k in range(400):
        own = list(words)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(150)] = f"q{rng.randrange(500)}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_groups(docs).collect()}
    assert got == brute.classes({k: brute.shingle_counts(t) for k, t in rows})


def star_texts():
    """Groups of a base and 4 to 29 copies: alike to the base, mostly not to each other."""
    texts = []
    for seed in range(80):
        rng = random.Random(100 + seed)
        words = [f"s{seed}w{k}" for k in range(100)]
        group = [words]
        for c in range(rng.choice([4, 4, 9, 19, 29])):
            own = list(words)
            for k in rng.sample(range(8, 92), 2):
                own[k] = f"s{seed}c{c}k{k}"
            group.append(own)
        rng.shuffle(group)
        texts.append([" ".join(own) for own in group])
    return texts


def test_stars(spark):
    """A base that was a pivot early still meets every copy."""
    rows, want = [], {}
    for group in star_texts():
        own = [(len(rows) + k, t) for k, t in enumerate(group)]
        want |= brute.classes({k: brute.shingle_counts(t) for k, t in own})  # groups share no word
        rows += own
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_groups(docs).collect()}
    assert got == want


def loose_texts(seed, n=60):
    """Copies of one base with up to twelve words changed: some are alike to many, some to none."""
    rng = random.Random(seed)
    words = [f"b{rng.randrange(90)}" for _ in range(120)]
    texts = []
    for k in range(n):
        own = list(words)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 4, 6, 12])):
            own[at] = f"c{k}x{at}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("block, shingles", [(5, 1 << 20), (1000, 1 << 20), (1000, 1)])
def test_blocks_of_large_buckets(spark, monkeypatch, block, shingles):
    """Buckets of four members or more meet in blocks and give the classes of all pairs."""
    for name, value in (("LARGE", 3), ("BLOCK", block), ("BLOCK_SHINGLES", shingles)):
        monkeypatch.setattr(near_dup, name, value)
    rows, want = [], {}
    for group in [*star_texts()[::8], *map(loose_texts, range(4))]:
        own = [(len(rows) + k, t) for k, t in enumerate(group)]
        rows += own
    want = brute.classes({k: brute.shingle_counts(t) for k, t in rows})
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_groups(docs).collect()}
    assert got == want


def test_links_of_a_block_join_what_is_alike():
    """As many links as join the parts that all pairs at the threshold make."""
    rng = random.Random(2)
    sets = [brute.shingle_counts(t) for t in loose_texts(9, 40)]
    number = {s: k for k, s in enumerate(sorted({s for own in sets for s in own}))}
    pairs = [(a, b) for a in range(40) for b in range(40) if a != b and rng.random() < 0.6]
    items = [np.array(sorted(number[s] for s in own), "u8") for own in sets]
    name = sorted(number, key=number.get)
    counts = [np.array([own[name[int(i)]] for i in ids], "u1") for own, ids in zip(sets, items)]
    found = near_dup._links(list(range(40)), np.array(pairs), items, counts, 0.8)
    alike = [(a, b) for a, b in pairs if brute.jaccard(sets[a], sets[b]) >= 0.8]
    assert set(found) <= set(alike)

    def parts(links):
        part = list(range(40))
        for a, b in links:
            part = [part[a] if p == part[b] else p for p in part]
        return {frozenset(k for k in range(40) if part[k] == p) for p in part}

    assert parts(found) == parts(alike) and len(found) == 40 - len(parts(alike))


def test_every_pair_of_a_bucket_meets(spark):
    """Rounds over one bucket with random links find the same components as all pairs."""
    for seed in range(6):
        rng = random.Random(seed)
        n = rng.randint(5, 30)
        names = [bytes([k]) for k in range(n)]
        hub = rng.randrange(n)
        linked = {frozenset((names[hub], x)) for x in names if x != names[hub] and rng.random() < 0.8}
        members = spark.createDataFrame([(1, x, rng.random() * n, n, [0]) for x in names],
                                        "bucket long, node binary, place double, n long, marks array<long>")
        label = {x: x for x in names}
        for low, high in ((0, 4), (4, 32)):
            labels = spark.createDataFrame([(k, v) for k, v in label.items()], "node binary, label binary")
            met = near_dup._round(members, labels if low else None, low, high, 7, 7).collect()
            for x, y in met:
                if frozenset((bytes(x), bytes(y))) in linked:
                    a, b = sorted((label[bytes(x)], label[bytes(y)]))
                    label = {k: a if v == b else v for k, v in label.items()}
        assert all(len({label[x] for x in link}) == 1 for link in linked)


@pytest.mark.parametrize("m", [7, 96, 30])
def test_equal_marks(spark, m):
    """Marks count equal components, but for a byte in 256 that is equal by chance."""
    rng = np.random.default_rng(m)
    a = rng.integers(0, 1 << 62, (50, m), dtype="u8")
    b = np.where(rng.random((50, m)) < rng.random((50, 1)), a, rng.integers(0, 1 << 62, (50, m), dtype="u8"))
    frame = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(near_dup.marks_of(a), near_dup.marks_of(b))],
                                  "x array<long>, y array<long>")
    got = [r[0] for r in frame.select(near_dup.equal_marks("x", "y", m)).collect()]
    want = (near_dup.mix(a + near_dup._odd[12]) & np.uint64(255)) == (near_dup.mix(b + near_dup._odd[12]) & np.uint64(255))
    assert got == want.sum(1).tolist() and (np.array(got) >= (a == b).sum(1)).all()


def test_least_equal_misses_one_in_a_million():
    rng = np.random.default_rng(1)
    for m, j in ((96, 0.8), (40, 0.5)):
        least = near_dup.least_equal(m, j)
        drawn = rng.binomial(m, j, 4_000_000)
        assert (drawn < least).mean() < 1e-5 < (drawn < least + 3).mean() * 20


def test_shared_passages_move_nothing(spark):
    """Many texts share half their words: they meet in buckets, but hardly a pair is verified."""
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(120)]
    rows = [(k, " ".join(passage + [f"d{k}w{j}" for j in range(110)])) for k in range(200)]
    rows += [(1000 + k, rows[k][1] + f" more{k}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_groups(docs).collect()}
    assert got == {k: k % 1000 for k, _ in rows}
    found = near_dup.describe(docs, 24, 4).selectExpr("node", "explode(bands) AS bucket", "marks").distinct()
    members = found.selectExpr("*", "0D AS place", "count(*) OVER (PARTITION BY bucket) AS n").filter("n > 1")
    pairs = [near_dup._round(members, None, 0, 1, 96, least).count() for least in (0, near_dup.least_equal(96, 0.8))]
    assert pairs[0] > 2000 and pairs[1] < pairs[0] / 20


def test_a_round_reads_its_members_once_made(spark):
    """The joins that tell which members are still open are not planned again for each use."""
    rows = [(1, 0, "a", [0] * 7, [1], 0.0, 2.0, 4), (1, 0, "b", [0] * 7, [1], 1.0, 2.0, 4)]
    members = spark.createDataFrame(rows, "bucket long, band int, node string, marks array<long>, bands array<long>, "
                                          "place double, n double, each int").withColumn("node", F.col("node").cast("binary"))
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    met = near_dup._round(members, None, 0, 16, 49, 49)
    assert plan(met).count("Join Inner") == 2 and met.count() == 1
    assert "Join" not in plan(near_dup._blocks(members, None, 0, 16, 49, 49))


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    root = {k: k for link in links for k in link}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in near_dup.components(
        spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {k: find(k) for a, b in links if a != b for k in (a, b)}


def test_frequencies_of_any_size():
    for numbers in ([], [1, 2**32 - 1], [7, 2**32, 2**40]):
        packed = search.narrow(numbers)
        assert packed.tolist() == numbers
        assert packed.itemsize == (8 if max(numbers, default=0) >= 2**32 else 4)


@pytest.mark.parametrize("shard, block", [(60, 7), (1000, 1000)])
def test_search(spark, small, shard, block):
    docs = table(spark, small, "documents").select("doc_id", "text")
    got = {}
    for r in search.search(docs, every=5, shard_docs=shard, block_queries=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], round(r["score"] * search.UNIT)))
    table_ = search.term_hashes()
    terms = {r["doc_id"]: dict(zip(*(x.tolist() for x in search.terms_of(r["text"], table_)))) for r in docs.collect()}
    df = Counter(t for own in terms.values() for t in own)
    n, mean = len(terms), sum(sum(own.values()) for own in terms.values()) / len(terms)
    for q in (k for k in terms if k % 5 == 0):
        scores = {}
        for d, own in terms.items():
            norm = search.K1 * (1 - search.B + search.B * sum(own.values()) / mean)
            score = sum(round(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * own[t] * (search.K1 + 1) / (own[t] + norm)
                              * search.UNIT) for t in terms[q] if t in own)
            if score:
                scores[d] = score
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10]
        assert sorted(got.get(q, [])) == [(k + 1, d, s) for k, (d, s) in enumerate(best)]


def test_search_moves_no_copies(spark):
    """Shards meet blocks where they lie, in small batches; equal rows of several shards are one document."""
    rows = [(i % 40, f"w{i % 40} w{i % 40 % 7} all common words") for i in range(400)] + [(None, "w1 all"), (2**60 + 1, "w2 all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = search.search(docs.repartition(7), shard_docs=16, block_queries=1)
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().toString()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    few = sorted(map(tuple, got.collect()), key=str)
    assert few == sorted(map(tuple, search.search(docs.coalesce(1)).collect()), key=str)
    assert len({r[:2] for r in few}) == len(few) == 20
    assert [r[2] for r in few if r[0] == 0][0] == 0


def test_query_terms_keep_their_frequencies(spark):
    df = spark.createDataFrame([(5, 2), (-1, 2**40), (9, 1)], "term long, df long")
    one = spark.createDataFrame([(0, 1, 2, np.array([9, 2**64 - 1, 5], "<u8").tobytes())],
                                "doc_id long, a long, b long, terms binary")
    row = search.weighted_queries(one, df).first()
    assert sorted(map(tuple, row["q"])) == [(-1, 2**40), (5, 2), (9, 1)]


def test_pipeline_stages(spark, small):
    """Each stage against brute force on what the one before it kept."""
    docs = table(spark, small, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, small), f"test_{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "line_dedup":
            assert after == brute.dedup_lines(sorted(before.items()), 16)
        if name == "near_dedup":
            want = brute.classes({k: brute.shingle_counts(t) for k, t in before.items()})
            assert set(after) == set(want.values()) and all(after[k] == before[k] for k in after)
        if name == "pii":
            assert set(after) == set(before) and not any("@mail" in t for t in after.values())
        before = kept[name] = after
    pieces = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in pieces} == set(kept["pii"])


def test_repeated_run_agrees(spark, small):
    docs = table(spark, small, "documents")
    runs = [sorted(map(tuple, near_dup.near_groups(docs.repartition(n)).select("doc_id", "class_id").collect()))
            for n in (1, 5)]
    assert runs[0] == runs[1]


def test_middling_group_makes_few_pairs(spark, monkeypatch):
    seen, verified = [], near_dup._verified

    def counted(pairs, weights, threshold):
        seen.append(pairs.count())
        return verified(pairs, weights, threshold)

    monkeypatch.setattr(near_dup, "_verified", counted)
    body = " ".join(f"word{k}" for k in range(200))
    docs = spark.createDataFrame([(k, f"{body} end{k}") for k in range(150)], "doc_id long, text string")
    assert {r["class_id"] for r in near_dup.near_groups(docs).collect()} == {0}
    assert sum(seen) < 150  # 16 pivots with all others before


def test_normal_form_skips_single_spaces(spark):
    blanks = [" ", "  ", "\t", " \t", " ", "\u0085 ", "\x0b\x0c", "\r"]
    rng = random.Random(8)
    lines = ["", *blanks] + ["".join(rng.choice([*blanks, "A", "b", "Éx", " "]) for _ in range(rng.randint(1, 9)))
                             for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select(
        "x", line_dedup.normal(F.col("x")).alias("form"), line_dedup.has_words(F.col("x")).alias("held"))
    for r in rows.collect():
        want = re.sub("[\x09-\x0d\x20\x85\xa0]+", " ", r["x"].lower()).strip(" ")
        assert (r["form"], r["held"]) == (want, want != "")
