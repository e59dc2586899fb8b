"""PII, quality rules, tokens, packing and fingerprints against brute force, on texts that try them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from siltstone.llm import merkle, packing, pii, quality, simhash, token_counts, word_bpe
from tests.llm.cases import TEXTS, documents, plain

BLANK = "[^\\x20\\x09-\\x0D]+"


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def fuzz(seed, n):
    r = random.Random(seed)
    parts = ["a", "B", "é", "ß", "Σ", " ", "  ", "\n", "\t", "1", "23", "'s", "'LL", "…", "—", "ﬁ", "한", "😀", "<|endoftext|>", "the", " the", "ing", "\u00a0", "\u0301", "İ", "!!", "zzq", "\x00", "\x0b", "_", "-"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


# PII ------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0
    good = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good[k](m[0])]


def test_base_spans_are_the_patterns():
    r = random.Random(3)
    texts = [t or "" for _, t in TEXTS if len(t or "") < 10_000]
    texts += ["".join(r.choice("a@.-_+ 0123456789()") for _ in range(80)) for _ in range(3000)]
    texts += ["".join(r.choice("0123456789.. -") for _ in range(60)) for _ in range(2000)]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


def test_pii_query(spark):
    got = pii.find_pii(documents(spark)).collect()
    assert len(got) == len(TEXTS)
    want = sorted((i or -1, hashlib.sha256(pii.listed(brute_spans(t or "")).encode()).hexdigest()) for i, t in TEXTS)
    assert sorted((r["doc_id"] or -1, r["base_sha256"]) for r in got) == want
    for r in got:
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"] == len([s for s in r["spans"].split(",") if s])
    assert pii.find_pii(documents(spark, [])).count() == 0


def test_field_adds_what_patterns_miss():
    crf = pii.Crf.train(pii.labelled_table())
    unseen = pii.labelled_table(seed=1234, times=5)
    hit = miss = wrong = 0
    for (text, marked), (base, every) in zip(unseen, pii.find([t for t, _ in unseen], crf), strict=True):
        assert set(base) <= set(every)
        hit += len(set(marked) & set(every))
        miss += len(set(marked) - set(every))
        wrong += len([s for s in every if s not in base and s not in marked])
    assert hit / (hit + miss) > 0.9, (hit, miss)
    assert wrong < 0.05 * hit, wrong


def measured_on(crf, table):
    hit = miss = wrong = 0
    for (_, marked), (base, every) in zip(table, pii.find([t for t, _ in table], crf), strict=True):
        hit += len(set(marked) & set(every))
        miss += len(set(marked) - set(every))
        wrong += len([s for s in every if s not in base and s not in marked])
    return hit, miss, wrong


def test_field_reads_templates_it_has_not_seen():
    """Of each fifth of the templates by a field trained on the others: forms that it was never shown."""
    total = np.zeros(3, int)
    for fold in range(5):
        crf = pii.Crf.train(pii.labelled_table(only=lambda i, fold=fold: i % 5 != fold))
        total += measured_on(crf, pii.labelled_table(seed=77, times=10, only=lambda i, fold=fold: i % 5 == fold))
    hit, miss, wrong = total
    assert hit / (hit + miss) > 0.6 and hit / (hit + wrong) > 0.85, total


def test_field_reads_marked_documents(spark, sf):
    """Spelt addresses, phones and cards put between the words of documents."""
    r = random.Random(21)
    crf = pii.Crf.train(pii.labelled_table())
    texts = [x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").where("length(text) between 200 and 4000").limit(150).collect()]
    snippets = [(t[a:b], k) for t, marked in pii.labelled_table(seed=4242, times=3) for k, a, b in marked]
    table = []
    for t in texts:
        words = t.split(" ")
        k = r.randint(5, len(words) - 5)
        snippet, kind = r.choice(snippets)
        before = " ".join(words[:k]) + " "
        table.append((before + snippet + " " + " ".join(words[k:]), [(kind, len(before), len(before) + len(snippet))]))
    hit, miss, _ = measured_on(crf, table)
    assert hit / (hit + miss) >= 0.9, (hit, miss)


def test_windows_find_what_whole_texts_do():
    crf = pii.Crf.train(pii.labelled_table(times=4))
    r = random.Random(31)
    filler = "the house on that hill was sold at noon. Version 3.2 of it, they said, is no better".split()
    texts = [t for t, _ in pii.labelled_table(seed=5, times=3)]
    texts = [" ".join(r.choice(filler) for _ in range(r.randint(0, 80))) + " " + t + " " + " ".join(r.choice(filler) for _ in range(r.randint(0, 80))) for t in texts]
    for n in (20, 60, 110, 400):  # no length is too long
        local = ".".join(["abcde"] * (n // 6))
        texts += [f"please write to {local} at mailhost dot com for more of it", f"we were told {local} (at) mailhost (dot) org is theirs", "1 " * n + "x", "1.2." * n, "@" * n, "(at) " * n]
    for t, windowed, whole in zip(texts, pii.decoded(texts, crf), pii.decoded(texts, crf, [[(0, len(t))] for t in texts]), strict=True):
        base = pii.base_spans(t)
        assert pii.spans_of(t, base, windowed) == pii.spans_of(t, base, whole), t
    long = f"please write to {'.'.join(['abcde'] * 20)} at mailhost dot com for more of it"
    assert ("email", 16, len(long) - len(" for more of it")) in pii.find([long], pii.Crf.train(pii.labelled_table()))[0][1]


def test_viterbi_finds_the_best_path():
    import itertools

    r = np.random.default_rng(1)
    k = len(pii.LABELS)
    crf = pii.Crf(r.normal(size=(pii.WIDTH + 1, k)).astype(np.float32), r.normal(size=(k, k)).astype(np.float32), r.normal(size=k).astype(np.float32))
    feats = [r.integers(0, pii.WIDTH, size=(n, 12)) for n in (1, 3, 4, 2)]
    for f, path in zip(feats, crf.viterbi(feats), strict=True):
        def total(p, f=f):
            return crf.begin[p[0]] + sum(crf.emit[f[i]].sum(axis=0)[p[i]] for i in range(len(p))) + sum(crf.step[a, b] for a, b in itertools.pairwise(p))
        best = max(itertools.product(range(k), repeat=len(f)), key=total) if len(f) < 4 else None
        assert best is None or abs(total(best) - total(path)) < 1e-4


def test_mask_keeps_the_rest(spark):
    got = pii.mask_pii(documents(spark))
    assert got.columns == documents(spark).columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[10]["text"].startswith("mail <EMAIL>, <EMAIL> ip <IP> 999.1.1.1 card <CARD> call <PHONE>")
    assert rows[4]["text"] is None and rows[1]["text"] == TEXTS[0][1] and rows[10]["n_chars"] == len(rows[10]["text"])


# Quality --------------------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = re.findall(BLANK, text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(lines)


def test_measures():
    for t in [t for _, t in TEXTS] + fuzz(1, 500):
        assert quality.measure(t or "") == brute_quality(t)


def brute_hosts(failures):
    """failures: host and whether a document of it fails some rule. The verdict of each host, by the definition."""
    by = defaultdict(list)
    for host, some in failures:
        by[host].append(some)
    rates = [np.mean(v) for v in by.values()]
    mean = min(max(np.mean(rates), 1e-6), 1 - 1e-6)
    chance = mean * (1 - mean) * np.mean([1 / len(v) for v in by.values()])
    weight = min(max(mean * (1 - mean) / max(np.var(rates) - chance, 1e-12) - 1, 1e-3), 1e3)
    out = {}
    for host, v in by.items():
        n = len(v) + weight
        rate = (sum(v) + mean * weight) / n
        off = 2 * (rate * (1 - rate) / (n + 1)) ** 0.5
        out[host] = "rejected" if rate - off > mean + (1 - mean) / 3 else "trusted" if rate + off < mean / 2 else "watched"
    return out


def check_quality(spark, rows, docs):
    """rows: id, text, host."""
    m = [brute_quality(t) for _, t, _ in rows]
    base = [x[0] < 50 or 100 * x[4] > 50 * x[0] for x in m]
    some = [b or 100 * x[2] > 10 * x[0] or 100 * x[3] > 30 * x[5] for b, x in zip(base, m, strict=True)]
    verdict = brute_hosts((h, s) for (_, _, h), s in zip(rows, some, strict=True))
    good = [not b and {"rejected": False, "trusted": True, "watched": not s}[verdict[h]] for (_, _, h), b, s in zip(rows, base, some, strict=True)]
    got = quality.judge(docs).collect()
    want = [(i, *x[:5], b, k, verdict[h]) for (i, _, h), x, b, k in zip(rows, m, base, good, strict=True)]
    assert plain(got) == plain(want)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == sorted((i or -1, t or "") for (i, t, _), k in zip(rows, good, strict=True) if k)
    return verdict, Counter(zip(base, some, good, strict=True))


def test_quality_query(spark):
    rows = TEXTS * 3
    check_quality(spark, [(i, t, ("src0", "src1", None)[k % 3]) for k, (i, t) in enumerate(rows)], documents(spark, rows))
    assert quality.judge(documents(spark, [])).count() == 0 and quality.keep(documents(spark, [])).count() == 0


def test_hosts_decide(spark):
    """A bad host goes as a whole, a good one keeps documents that others lose, and a bad document or two condemn no small host."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    fine = lambda: " ".join(word() for _ in range(60))
    soft = lambda: fine() + " #### $$$$ ####"
    shares = {"bad": (120, 100), "good": (400, 2), "tiny": (2, 2), **{f"usual{i}": (100, 15 + i) for i in range(8)}}
    rows = [(i, soft() if k < n else fine(), host) for i, (host, k, n) in enumerate((h, k, n) for h, (all_, n) in shares.items() for k in range(all_))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdict, decided = check_quality(spark, rows, docs)
    assert verdict["bad"] == "rejected" and verdict["good"] == "trusted" and verdict["tiny"] == verdict["usual3"] == "watched"
    assert decided[False, False, False] == 20 and decided[False, True, True] == 2


def test_a_small_host_is_shrunk_to_the_mean():
    a, b = quality.beta_prior(0.1, 0.005)
    assert (1 + a) / (1 + a + b) < 0.5 < (60 + a) / (60 + a + b)
    assert quality.beta_prior(None, None) == (1.0, 1.0) and all(x > 0 for m in (0, 0.5, 1) for v in (0, 0.2, 0.25) for x in quality.beta_prior(m, v))


# SimHash --------------------------------------------------------------------------------------------------


def brute_simhash(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(BLANK, low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: list of numbers; the group of each."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_simhash_is_the_definition():
    for t in [t for _, t in TEXTS if len(t or "") < 10_000] + fuzz(2, 300):
        assert simhash.simhash(t or "") == brute_simhash(t)


def test_near_duplicates(spark):
    rows = TEXTS + [(100 + i, TEXTS[0][1].replace(w, w + "x", 1)) for i, w in enumerate(("fox", "lazy", "peace", "many"))] + [(200 + i, TEXTS[0][1]) for i in range(50)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = [brute_simhash(t) for _, t in rows]
    group = brute_components(prints)
    least = {g: min((i for (i, _), h in zip(rows, group, strict=True) if h == g and i is not None), default=None) for g in group}
    want = [(i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group, strict=True)]
    assert plain(got) == plain(want)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    kept = simhash.drop_near_duplicates(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns and kept.count() == len(set(group))
    ids = {r["doc_id"] for r in kept.collect()}
    assert {x for x in least.values() if x is not None} <= ids


def test_links_and_chains(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    prints, now = [base], base
    for _ in range(40):  # a chain, each three bits on
        for b in r.sample(range(64), 3):
            now ^= 1 << b
        prints.append(now)
    prints += [r.getrandbits(64) for _ in range(200)] + [0, 1, 7, 15, (1 << 64) - 1, (1 << 64) - 8]
    prints += [base ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in ((0, 1, 2), (61, 62, 63), (0, 32, 63), (31, 32, 33))]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "_fp long")
    got = {tuple(x) for x in simhash.links(nodes).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got <= want
    from siltstone.llm.graph import components

    found = {x["node"]: x["root"] for x in components(simhash.links(nodes)).collect()}
    group = brute_components(prints)
    least = {g: min(s for s, h in zip(signed, group, strict=True) if h == g) for g in group}
    alone = Counter(group)
    assert found == {s: least[g] for s, g in zip(signed, group, strict=True) if alone[g] > 1}


def test_variants_meet_within_three_bits_only():
    r = random.Random(8)
    for _ in range(300):
        a = r.getrandbits(64) if r.random() < 0.8 else r.choice((0, (1 << 64) - 1))
        b = a
        for bit in r.sample(range(64), r.randint(0, 6)):
            b ^= 1 << bit
        at, number = simhash.variants(np.array([a, b], np.uint64))
        masks = simhash.MASKS[number]
        one, two = ({x ^ m for m in masks[at == i].tolist()} for i, x in enumerate((a, b)))
        near = any(min((k ^ a).bit_count(), (k ^ b).bit_count()) <= 1 for k in one & two)
        assert near == ((a ^ b).bit_count() <= 3)
        u, v = simhash.stars(np.array([a, b], np.uint64)[at], number)
        assert (len(u) > 0) == (a != b and near)
    assert len(simhash.variants(np.array([0xFFFFFFFF], np.uint64))[0]) == 1 + 64 + 32 * 31 // 2
    top = np.array([(1 << 63) - 1, (1 << 63) - 2], np.uint64)
    at, number = simhash.variants(top)
    assert len(simhash.stars(top[at], number)[0]) > 0


def test_dealt_variants_are_all_variants():
    prints = np.array(sorted(random.Random(1).getrandbits(64) for _ in range(300)), np.uint64)
    for tasks in (1, 7, 100_000):
        batch = simhash.dealt(prints, tasks)
        fp, n, variant = (batch.column(i).flatten().to_numpy() for i in (1, 2, 3))
        at, number = simhash.variants(prints)
        assert sorted(zip(np.repeat(fp, n).view(np.uint64).tolist(), variant.tolist(), strict=True)) == sorted(zip(prints[at].tolist(), number.tolist(), strict=True))


def test_a_half_that_all_share_makes_no_pairs(spark):
    """Fingerprints that have 32 bits in common but are strangers, and one cluster in which all are near each other."""
    r = random.Random(6)
    strangers = [r.getrandbits(32) for _ in range(3000)]
    cluster = [(1 << 63) ^ (1 << a) for a in range(63)] + [1 << 63]
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in {*strangers, *cluster}], "_fp long")
    got = simhash.links(nodes).collect()
    assert all(((u ^ v) & ((1 << 64) - 1)).bit_count() <= 3 for u, v in got) and len(got) < 4000
    from siltstone.llm.graph import components

    assert len({x["root"] for x in components(simhash.links(nodes)).collect() if x["node"] < 0}) == 1


# Tokens ---------------------------------------------------------------------------------------------------


def test_word_bpe_is_the_library(spark):
    t = library("word_bpe_49k.json")
    got = word_bpe.encode_decode(documents(spark)).collect()
    want = []
    for i, text in TEXTS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert plain(got) == plain(want)
    assert word_bpe.encode_decode(documents(spark, [])).count() == 0


def test_word_bpe_on_odd_strings():
    t, own = library("word_bpe_49k.json"), word_bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(9)
    texts = fuzz(4, 1500) + ["".join(r.choice("abcdefghijklmnopqrstuvwxyzaeiou") for _ in range(r.randint(1, 30))) for _ in range(3000)]
    for text, (raw, shown) in zip(texts, own.encode(texts), strict=True):
        ids = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids, text
        assert shown == t.decode(ids, skip_special_tokens=False), text
    assert 0 < own.merged < own.proposed  # some proposals fail, most hold


def test_token_counts_are_the_library(spark):
    t = library("byte_bpe_50k.json")
    got = token_counts.token_counts(documents(spark)).collect()
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x in TEXTS]
    assert plain(got) == plain(want)
    counter = token_counts.TokenCounter(public_tokenizers.path("byte_bpe_50k.json"), token_counts.whole_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    for x in fuzz(6, 2000):
        assert counter.count(x) == len(t.encode(x, add_special_tokens=False).ids), x


def test_files_with_rules_of_their_own_are_counted_by_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    counter, t = token_counts.TokenCounter(path, token_counts.whole_tokens(path)), library("word_bpe_49k.json")
    for x in fuzz(14, 200):
        assert counter.count(x) == len(t.encode(x, add_special_tokens=False).ids)


def test_the_proof_holds():
    path = public_tokenizers.path("byte_bpe_50k.json")
    solo, t = token_counts.whole_tokens(path), library("byte_bpe_50k.json")
    vocab = t.get_vocab(with_added_tokens=False)
    assert 0.9 < len(solo) / len(vocab) <= 1 and solo <= vocab.keys()


# Packing --------------------------------------------------------------------------------------------------


def test_packing(spark):
    rows = TEXTS + [(1000 + i, "word " * (i * 37 % 900)) for i in range(300)]
    got = packing.pack(documents(spark, rows)).collect()
    t = library("byte_bpe_50k.json")
    coded = Counter()
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (a, n) in enumerate(packing.pieces_of(len(ids))):
            coded[i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == coded
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert len(by) == packing.plan(Counter(r["length"] for r in got)).sequences
    bound = -(-sum(r["length"] for r in got) // packing.CAPACITY)
    assert bound <= len(by) <= bound + 1
    assert packing.pack(documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 4096, 5000])
def test_pieces_cover_a_document(n):
    got = packing.pieces_of(n)
    assert sum(k for _, k in got) == n and all(k == 2048 for _, k in got[1:]) and [a for a, _ in got] == [sum(k for _, k in got[:i]) for i in range(len(got))]


def test_plans_hold_the_histogram():
    r = random.Random(2)
    for case in range(25):
        cap = r.choice((10, 64, 300))
        histogram = {r.randint(1, cap): r.randint(1, 10 ** r.randint(0, 5)) for _ in range(r.randint(1, 40))}
        plan = packing.plan(histogram, cap).configurations
        used = Counter()
        for chosen, times in plan:
            assert sum(k * n for k, n in chosen.items()) <= cap and times > 0
            for k, n in chosen.items():
                used[k] += n * times
        assert used == Counter(histogram), case
        slots = packing.Slots.of(plan)
        for k, n in histogram.items():
            ranks = np.arange(min(n, 2000))
            seq, off = slots.place(np.full(len(ranks), k), ranks)
            assert len(set(zip(seq.tolist(), off.tolist(), strict=True))) == len(ranks)


# Fingerprints ---------------------------------------------------------------------------------------------


def brute_leaves(text):
    """Leaves of each line, by scanning characters."""
    out = []
    for line in text.split("\n"):
        sentences, at = [], 0
        for i in range(1, len(line)):
            if line[i] not in " \t" and line[i - 1] in " \t" and line[:i].rstrip(" \t")[-1:] in (".", "!", "?"):
                sentences.append(line[at:i])
                at = i
        sentences.append(line[at:])
        leaves = []
        for s in sentences:
            if s.count(" ") < 16:
                leaves.append(s)
                continue
            words, run = re.findall(r"\S+\s*|\s+", s), ""
            n = 0
            for w in words:
                run, n = run + w, n + 1
                if (xxhash.xxh32_intdigest(w) % 8 == 0 and n > 2) or n >= 32:
                    leaves.append(run)
                    run, n = "", 0
            if run:
                leaves.append(run)
        out.append(leaves)
    return out


def brute_fingerprint(text):
    digest = lambda level, parts: hashlib.blake2b(b"".join(parts), digest_size=16, person=level).digest()
    lines = text.split("\n")
    sections, now = [], []
    for line, leaves in zip(lines, brute_leaves(text), strict=True):
        now.append([xxhash.xxh3_128_digest(x) for x in leaves])
        if not line.strip() or xxhash.xxh32_intdigest(line, 1) % 8 == 0:
            sections.append(now)
            now = []
    sections += [now] if now else []
    nodes = [[digest(b"paragraph", p) for p in s] for s in sections]
    tops = [digest(b"section", s) for s in nodes]
    shown = [".".join([t.hex()[:12], *(n.hex()[:12] + "".join(x.hex()[:8] for x in p) for n, p in zip(ns, s, strict=True))]) for t, ns, s in zip(tops, nodes, sections, strict=True)]
    return digest(b"root", tops).hex() + "/" + ",".join(shown)


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_likeness(a, b):
    x, y = ([leaf for line in brute_leaves(t) for leaf in line] for t in (a, b))
    return 2 * longest_common(x, y) / (len(x) + len(y))


def brute_edited(rows):
    """doc_id, n_chars, edited_sha256, fingerprints and the highest likenesses there can be, for rows in order."""
    out = []
    for k, (i, t) in enumerate(rows):
        mine, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(mine) // 2
        edited = mine[: len(mine) - half] + after[:half]
        most = [min(1.0, brute_likeness(mine, x)) if len(mine) < 10_000 else None for x in (edited, after)]
        out.append(((i, len(mine), hashlib.sha256(edited.encode()).hexdigest(), brute_fingerprint(mine), brute_fingerprint(edited)), most, (mine, edited, after)))
    return out


def check_edited(got, rows):
    want = brute_edited(rows)
    digests = lambda r: (r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"])
    assert plain(map(digests, got)) == plain(x for x, _, _ in want)
    most = {x: (m, texts) for x, m, texts in want}
    for r in got:
        (one, two), (mine, edited, after) = most[digests(r)]
        for near, top, other in ((r["near_edited"], one, edited), (r["near_next"], two, after)):
            assert 0 <= near <= 1 and (near == 1) == (mine == other)
            assert top is None or 0.8 * top - 0.05 <= near <= top + 1e-9, (near, top)
        assert (r["edited_leaves"] == "") == (mine == edited)


@pytest.mark.parametrize("buckets", [1, 7, None])
def test_edit_fingerprints(spark, buckets):
    rows = sorted(((i, t) for i, t in TEXTS if i is not None), key=lambda r: r[0])
    check_edited(merkle.edit_fingerprints(documents(spark, rows), buckets=buckets).collect(), rows)


@pytest.mark.parametrize("first", [2**53 - 50, 2**60, -(2**63), 2**63 - 100, None])
def test_the_next_one_goes_by_the_whole_id(spark, first):
    """Ids that doubles can't tell apart, also at the ends of their range, and any 64 bits."""
    r = random.Random(11)
    ids = sorted({r.getrandbits(64) - (1 << 63) for _ in range(100)}) if first is None else [first + i for i in range(100)]
    rows = [(i, f"Text number {r.random()}. It is one of many.") for i in ids]
    shuffled = rows[:]
    r.shuffle(shuffled)
    check_edited(merkle.edit_fingerprints(documents(spark, shuffled), buckets=13).collect(), rows)


def test_ranges_keep_the_order():
    r = np.random.default_rng(5)
    for _ in range(50):
        ids = np.sort(r.integers(-20, 20, 300)) + (1 << 60)
        ids[50:200] = ids[50]
        ids.sort()
        ties = r.integers(-(1 << 63), (1 << 63) - 1, 300)
        order = np.lexsort((ties, ids))
        cuts = ids[(np.arange(1, 12) * 300) // 12]
        at = merkle.bucket_of(ids[order], ties[order], cuts)
        assert (np.diff(at) >= 0).all() and len(np.unique(at)) > 4
        assert max(Counter(at.tolist()).values()) < 120  # an id that half of the rows have is cut


def test_every_row_has_a_next_one(spark):
    for rows in (TEXTS, TEXTS[:1], [(5, "same")] * 40, [(None, "x")] * 3, []):
        got = merkle.edit_fingerprints(documents(spark, rows), buckets=5)
        assert sorted((r["doc_id"] or -1) for r in got.collect()) == sorted((i or -1) for i, _ in rows)
    assert merkle.fingerprints(documents(spark)).count() == len(TEXTS)


def test_roots_are_equal_only_of_equal_texts():
    texts = {t or "" for _, t in TEXTS} | {"a. b", "a.  b", "a.\nb", "a.b", "a. \nb", "\n", "\n\n", " ", "a. b.\n", "A. b"} | set(fuzz(12, 400))
    assert len({merkle.fingerprint(t)[:32] for t in texts}) == len(texts)
    for t in texts:
        if len(t) < 10_000:
            assert merkle.fingerprint(t) == brute_fingerprint(t)
            assert str(merkle.Tree.parse(merkle.fingerprint(t))) == merkle.fingerprint(t)
    assert merkle.fingerprint(None) == merkle.fingerprint("")


def test_differing_finds_the_edit():
    lines = [f"Line {i} says this and that. It has a second sentence." for i in range(200)]
    a = "\n".join(lines)
    lines[77] = "Line 77 was changed. It has a second sentence."
    b = "\n".join(lines)
    x, y = merkle.fingerprint(a), merkle.fingerprint(b)
    assert x != y and merkle.differing(x, x) == [] and merkle.likeness(x, x) == 1.0 and 0.95 < merkle.likeness(x, y) < 1
    assert merkle.differing(x, y) == [((154, 155), (154, 155))] and merkle.listed(merkle.differing(x, y)) == "154:155>154:155"
    assert merkle.likeness(x, merkle.fingerprint("nothing alike")) < 0.01
    assert merkle.likeness(merkle.fingerprint("One. Two. Three."), merkle.fingerprint("Three. Two. One.")) < 0.5  # order counts


def test_what_is_outside_of_the_ranges_is_equal():
    r = random.Random(13)
    for _ in range(200):
        words = [f"{r.choice('abcdefgh')}{r.randint(0, 9)}" + r.choice((" ", " ", ". ", "\n", ".\n\n")) for _ in range(r.randint(0, 200))]
        other = words[:]
        for _ in range(r.randint(0, 5)):
            k = r.randint(0, len(other))
            other[k : k + r.randint(0, 3)] = [f"new{r.randint(0, 99)}. "] * r.randint(0, 2)
        a, b = "".join(words), "".join(other)
        x, y = ([leaf for line in brute_leaves(t) for leaf in line] for t in (a, b))
        apart = merkle.differing(merkle.fingerprint(a), merkle.fingerprint(b))
        p = q = 0
        for (i1, i2), (j1, j2) in [*apart, ((len(x), len(x)), (len(y), len(y)))]:
            assert x[p:i1] == y[q:j1] and (i1, j1) >= (p, q)
            p, q = i2, j2
        assert (not apart) == (a == b)
        assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) <= brute_likeness(a, b) + 1e-9 or a == b


def test_comparing_takes_no_square_of_the_length():
    import time

    def seconds(n):
        a, b = ("\n".join(f"Line {i} of {k}." for i in range(n)) for k in "ab")
        x, y = merkle.Tree.of(a + "\n".join(["same"] * n)), merkle.Tree.of(b + "\n".join(["same"] * n))
        start = time.process_time()
        merkle.differing(x, y)
        return time.process_time() - start

    assert seconds(16_000) < 12 * max(seconds(2000), 0.01)
