"""Near copies by five-word shingles, against brute force."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import near_copies
from siltstone.llm.graph import components
from tests.llm.cases import TEXTS, documents


def brute_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def brute_kept(rows):
    """The least id of each component of texts whose sets are alike to 0.8; ids aren't null."""
    sets = [brute_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and (sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(i for (i, _), h in zip(rows, group, strict=True) if h == g) for g in set(group))


def planted(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    line = " ".join(word() for _ in range(20))
    texts = [line + " " + " ".join(word() for _ in range(r.randint(50, 150))) for _ in range(40)]  # strangers with a common line

    def edited(text, n):
        words = text.split()
        for k in r.sample(range(len(words)), n):
            words[k] = word()
        return " ".join(words)

    for base in texts[:20]:
        texts += [edited(base, n) for n in (1, 2, 3, 4, 6)]  # on both sides of 0.8
        texts.append(base.upper())
    chain = " ".join(word() for _ in range(200))
    for _ in range(12):  # the ends have little in common
        texts.append(chain := edited(chain, 3))
    star = " ".join(word() for _ in range(300))
    texts += [edited(star, 4) for _ in range(60)]  # like their origin, less like each other
    texts.append(star)
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows


def test_stage_finds_all_near_copies(spark, sf):
    rows = planted()
    want = brute_kept(rows)
    assert 40 < len(want) < 150
    kept = corpus_pipeline.near_dedup_stage(spark, documents(spark, rows), sf)
    assert sorted(x["doc_id"] for x in kept.collect()) == want


def test_odd_documents(spark):
    rows = [(i, t) for i, t in TEXTS if i is not None and i != 11]
    got = near_copies.drop_near_copies(documents(spark, rows + rows))
    assert sorted(x["doc_id"] for x in got.collect()) == brute_kept(rows)
    assert near_copies.drop_near_copies(documents(spark, [])).count() == 0
    assert near_copies.drop_near_copies(documents(spark, [(None, None)] * 5)).count() == 1


def test_pairs_below_the_threshold_dont_meet(spark):
    """Copies of one text with two words of their own each are at 0.76 to one another: sketches leave all pairs, parities only those that are alike."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(60):
        words = list(base)
        for k in r.sample(range(5, 145), 2):
            words[k] = f"own{i}at{k}"
        texts.append(" ".join(words))
    sets = [brute_set(t) for t in texts]
    like = {(i, j) for i in range(60) for j in range(i + 1, 60) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    prints = near_copies.prints_of(documents(spark, list(enumerate(texts))), 5, "doc_id", "text").cache()
    met = prints.alias("a").join(prints.alias("b"), F.col("a._id") < F.col("b._id")).where(near_copies._may_be_like("a", "b"))
    got = {(x[0], x[1]) for x in met.select("a._id", "b._id").collect()}
    assert like <= got
    assert len(got) < len(like) + 150 < 1000


def test_balls_link_without_bands(spark):
    """Sets whose SimHash fingerprints are 3 bits apart at most are linked by their balls alone, where they are alike."""
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(1500)]
    texts = [" ".join([*base[:k], f"own{k}", *base[k + 1 :]]) for k in range(20, 1500, 100)] + [" ".join(f"{c}{i}" for i in range(1500)) for c in "abcdef"]
    held = {}
    for t in texts:
        s = near_copies.shingle_set(t)
        bits = sum((2 * sum(int(h) >> i & 1 for h in s) > len(s)) << i for i in range(64))
        held[bits, s.tobytes()] = t
    group = {t: t for t in texts}
    for (a, _), t in held.items():
        for (b, _), o in held.items():
            if (a ^ b).bit_count() <= 3 and group[t] != group[o]:
                old, new = group[t], group[o]
                group = {k: new if g == old else g for k, g in group.items()}
    want = sorted(sorted(t for t in texts if group[t] == g) for g in set(group.values()))
    assert any(len(g) > 3 for g in want) and any(len(g) == 1 for g in want)
    nodes = near_copies.prints_of(documents(spark, list(enumerate(texts))), 5, "doc_id", "text").withColumn("_bands", F.expr("cast(array() as array<long>)"))
    nodes = spark.createDataFrame(nodes.collect(), nodes.schema)
    of = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string").join(nodes, "_id").select("_fp", "_text")
    fps = {x["_fp"]: x["_text"] for x in of.collect()}
    found = near_copies.links(nodes, lambda some: of.join(some, "_fp"), 5).collect()
    got = {t: t for t in texts}
    for u, v in found:
        old, new = got[fps[u]], got[fps[v]]
        got = {k: new if g == old else g for k, g in got.items()}
    assert sorted(sorted(t for t in texts if got[t] == g) for g in set(got.values())) == want


def test_components_take_few_tasks(spark):
    """The driver keeps what it knows of each task: a round of components needs few of them, and repeated links change nothing."""
    chains = [(100 * c + i + 1, 100 * c + i) for c in range(40) for i in range(c % 7 + 1)]
    want = {n: 100 * (n // 100) for link in chains for n in link}
    links = spark.createDataFrame(chains + [(v, u) for u, v in chains] + [(u, u) for u, _ in chains], "u long, v long")
    tracker = spark.sparkContext.statusTracker()
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        before = set(tracker.getJobIdsForGroup(None))
        got = {x["node"]: x["root"] for x in components(links).collect()}
        jobs = set(tracker.getJobIdsForGroup(None)) - before
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want
    tasks = sum(tracker.getStageInfo(s).numCompletedTasks for j in jobs for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s))
    assert 0 < tasks < 1000
