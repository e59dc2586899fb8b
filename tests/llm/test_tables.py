"""URL filter, preferences, toxicity, the pipeline and the entry points."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import preference, queries, simhash, toxicity, url_filter
from tests.llm.cases import _EXTRA, PLAIN, TEXTS, documents

URLS = [
    "http://a.com/x", "HTTP://Sub.Example.COM/en/1?q#f", "https://www.example.com/en/", "https://x.www.example.com/en/a", "http://b.net/es/1", "http://net/fr/", "http://c.net/de/1", "http://badcom/en/",
    "ftp://spam-farm.org", "http://www.spam-farm.org/a//", "http://m.spam-farm.org/a", "http://ok.org/", "nothing", "", None, "://", "http://?q", "http://d.com", "http://e.net/es", "http://a.com/x", "x://y://z/w",
]


def pages(spark, urls=URLS):
    return spark.createDataFrame([(i if i != 3 else None, u, "h", "r", "v", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, verdict string, _key string")


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for h, p, v in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best


def test_urls(spark):
    listed = spark.createDataFrame([("spam-farm.org/a",), ("spam-farm.org",), (None,), ("spam-farm.org",)], "u string")
    got = url_filter.filter_urls(pages(spark), listed).drop("by").collect()
    want = []
    for i, u in enumerate(URLS):
        host, path, best = brute_url(u)
        short = host[4:] if host.startswith("www.") else host[2:] if host.startswith("m.") else host
        verdict = best[1] if best else "block" if host and short + path.rstrip("/") in ("spam-farm.org/a", "spam-farm.org") else "allow"
        want.append((i if i != 3 else None, host, path, best and best[0], verdict))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert url_filter.filter_urls(pages(spark, []), listed).count() == 0
    assert url_filter.filter_urls(pages(spark), listed.limit(0)).where("verdict = 'block' and rule is null").count() == 0


def test_the_join_removes_what_a_full_filter_lets_through(spark):
    """One word of 64 bits for 300 URLs: the filter passes everything, and the verdicts stay the same."""
    rows = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 50, F.lit(".org/p"), "id").alias("url"))
    listed = rows.where("page_id % 13 = 0").select(F.concat(F.lit("h"), F.col("page_id") % 50, F.lit(".org/p"), "page_id"))
    narrow, wide = (url_filter.filter_urls(rows, listed, most_blocks=n) for n in (1, 1 << 10))
    of = lambda df: {r["by"]: r["count"] for r in df.groupBy("by").count().collect()}
    assert of(narrow) == {"list": 308, "join": 3692}
    assert of(wide)["list"] == 308 and of(wide)["filter"] > 3500
    assert sorted(map(tuple, narrow.drop("by").collect())) == sorted(map(tuple, wide.drop("by").collect()))
    assert narrow.where("verdict = 'block'").where("page_id % 13 <> 0").count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_the_list_decides_rows_of_the_query(spark, size):
    got = queries.op1_url_filter(spark, f"/root/testdata/{size}")
    assert got.where("rule is null and verdict = 'block'").count() > 0 and got.where("rule is null and verdict = 'allow'").count() > 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("_key"))
    bloom = url_filter.BlockedBloom.of(keys)
    held = np.array([r[0] for r in keys.select(F.xxhash64("_key")).collect()])
    others = np.array([r[0] for r in spark.range(20_000, 60_000).select(F.xxhash64(F.concat(F.lit("u"), "id"))).collect()])
    assert bloom.may_hold(held).all() and bloom.may_hold(others).mean() < 0.05


def test_rules_are_checked(spark):
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages(spark), pages(spark).select("url"), rules=(("a", "/", "allow"), ("a", "/", "block")))


# Preferences ----------------------------------------------------------------------------------------------


def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string, _id string, turns string")


def test_preferences(spark):
    x = ("x", "y")
    chosen = [(1, 0, "user", "hi", *x), (1, 1, "assistant", "yes", *x), (1, 2, "user", None, *x), (2, 0, "user", "q", *x), (2, 1, "assistant", "a", *x), (3, 0, "user", "only", *x), (None, 0, "user", "lost", *x), (4, None, None, None, *x), (4, 0, "assistant", "é😀", *x), (1, 1, "assistant", "yes", *x)]
    rejected = [(1, 0, "user", "hi", *x), (1, 1, "assistant", "no", *x), (2, 0, "user", "q", *x), (2, 1, "assistant", "a", *x), (2, 2, "user", "more", *x), (4, None, "", "", *x), (4, 0, "assistant", "", *x)]
    got = {r["pair_id"]: r for r in preference.format_preferences(turns(spark, chosen), turns(spark, rejected)).collect()}
    assert set(got) == {1, 2, 4}
    one = got[1]
    assert one["n_prompt_turns"] == 1 and one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert [one["chosen"][a:b] for a, b in one["chosen_mask"]] == ["yes<|im_end|>"] and [one["rejected"][a:b] for a, b in one["rejected_mask"]] == ["no<|im_end|>"]
    assert one["chosen"].endswith("<|im_start|>user\n<|im_end|>\n")
    two = got[2]
    assert two["n_prompt_turns"] == 2 and two["chosen"] == "" and two["chosen_mask"] == [] and two["rejected"] == "<|im_start|>user\nmore<|im_end|>\n" and two["rejected_mask"] == []
    assert got[4]["n_prompt_turns"] == 1 and [got[4]["chosen"][a:b] for a, b in got[4]["chosen_mask"]] == ["é😀<|im_end|>"]
    assert preference.format_preferences(turns(spark, []), turns(spark, [])).count() == 0


def test_no_python_on_the_main_path(spark, sf):
    plan = queries.op4_preference_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Toxicity -------------------------------------------------------------------------------------------------


def labelled(spark, n=400, seed=1):
    r = random.Random(seed)
    syllables = "ba ko ri mu te na so li pa ve du ga".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 4)))
    insults = ["grubnak", "smelvork", "dufflejak", "plonkerish"]
    common = [word() for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [r.choice(common) for _ in range(60)]
        if toxic:
            for _ in range(3):
                w = r.choice(insults)
                if r.random() < 0.5:
                    k = r.randrange(1, len(w))
                    w = r.choice((w[:k] + "x" + w[k:], w[:k] + "-" + w[k:], w[:k] + w[k] + w[k:]))
                words[r.randrange(60)] = w
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic), 0))
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int, _id int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.95
    import zlib

    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)


def test_kernel_tolerates_gaps():
    def kernel(a, b):
        row, code, weight = toxicity.subsequences([a, b])
        x, y = (dict() for _ in range(2))
        for r, c, w in zip(row, code, weight, strict=True):
            d = x if r == 0 else y
            d[c] = d.get(c, 0) + w
        return sum(v * y.get(c, 0) for c, v in x.items())

    near = min(kernel("grubnak", w) for w in ("grubxnak", "grubnnak", "gruxbnak"))
    far = max(kernel("grubnak", w) for w in ("kangaroo", "umbrella", "nakedness"))
    assert near > 2 * far
    assert "idiot" in toxicity.words_of("you i d i o t") and "idiot" in toxicity.words_of("i-d-i-o-t!")


def test_landmarks_give_the_kernel_machine():
    """With all words as landmarks the machine's margins are those of the exact kernel machine."""
    r = random.Random(3)
    words = sorted({"".join(r.choice("abcdeklmnorst") for _ in range(r.randint(4, 9))) for _ in range(70)})
    y = np.array([1.0 if "a" in w[:3] else -1.0 for w in words])
    row, code, weight = toxicity.subsequences(words)
    dense = np.zeros((len(words), 1 << toxicity.HASHED), np.float32)
    np.add.at(dense, (row, code), weight)
    gram = (dense @ dense.T).astype(float)
    codes, phi, root = toxicity.nystrom(words)
    z = toxicity._kernel(words, codes, phi) @ root
    assert np.abs(z @ z.T - gram).max() < 1e-3
    w = toxicity._svm(z, y, np.full(len(words), 20.0))
    # the exact one: squared hinge in the span of all kernel rows, by plain gradient steps on a, with margins gram @ a + b
    a, b = np.zeros(len(words)), 0.0
    for _ in range(200):
        on = y * (gram @ a + b) < 1
        k = np.block([[np.eye(on.sum()) / 20.0 + gram[np.ix_(on, on)], np.ones((on.sum(), 1))], [np.ones((1, on.sum())), np.zeros((1, 1))]])
        s = np.linalg.solve(k, np.append(y[on], 0.0))
        a, b = np.zeros(len(words)), s[-1]
        a[on] = s[:-1]
    exact, own = gram @ a + b, np.hstack([z, np.ones((len(z), 1))]) @ w
    assert np.abs(exact - own).max() < 0.05


def test_repeated_ids_give_one_model(spark):
    docs, labels = labelled(spark, 120)
    twice = docs.unionByName(docs.withColumn("text", F.concat(F.lit("zz "), "text"))).repartition(7)
    one, two = (toxicity.train(d, labels) for d in (docs, twice))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.logistic, two.logistic)


def test_driver_does_not_fit_the_model(spark, monkeypatch):
    """What a fit holds in memory is a task's: the driver gets the model alone."""
    docs, labels = labelled(spark, 120)
    monkeypatch.setattr(toxicity, "fit", lambda toxic, clean: toxicity.Model(np.ones(4, np.float32), float(os.getpid()), np.array([1.0, 2.0, 3.0])))
    model = toxicity.train(docs, labels)
    assert model.bias != os.getpid()
    assert model.weights.tolist() == [1.0] * 4 and model.weights.dtype == np.float32 and model.logistic.tolist() == [1.0, 2.0, 3.0]


def test_toxicity_of_odd_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    odd = documents(spark)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    none = toxicity.train(docs, labels.limit(0))
    assert none is None and toxicity.score(odd, none).where("score <> 0").count() == 0 and toxicity.drop_toxic(odd, none).count() == len(TEXTS)
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_held_out_labels_are_never_read(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(map(tuple, toxicity.score(docs, toxicity.train(docs, x)).collect())) for x in (labels, flipped))
    assert one == two


# Queries and pipeline -------------------------------------------------------------------------------------


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_says_the_same(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf), con.execute(queries.oracle_sql()[name])
    assert canonical(got.columns, map(tuple, got.collect())) == canonical([c[0] for c in want.description], want.fetchall())


def test_every_query_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == before.columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert docs.count() <= before.count() and (name != "pii" or docs.count() == before.count())
    whole = corpus_pipeline.run(spark, sf)
    drop = ("sequence_id", "offset")
    assert sorted(map(tuple, whole.drop(*drop).collect())) == sorted(map(tuple, docs.drop(*drop).collect()))
    assert whole.select("sequence_id").distinct().count() == docs.select("sequence_id").distinct().count()


def test_stages_take_odd_documents(spark, sf):
    """Whatever other columns are called, they keep what they hold."""
    for rows in (TEXTS, [], [(None, None)] * 5, [(1, PLAIN)] * 5):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            got = out.collect()
            if name == "packing":
                continue
            assert out.columns == docs.columns and out.schema == docs.schema
            assert {tuple(r)[5:] for r in got} == ({_EXTRA} if got else set())
    kept = simhash.drop_near_duplicates(documents(spark))
    assert kept.columns == documents(spark).columns and {tuple(r)[5:] for r in kept.collect()} == {_EXTRA}
