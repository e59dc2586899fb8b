"""The pipeline against a version that does each step by plain definitions, on documents of which it is known what they are."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_texts import brute_hosts, brute_quality, brute_spans


def corpus(seed=17):
    """(doc_id, text, source) and which ids are toxic. Kinds: clean, toxic, short, repeating, symbols, with personal data; some with copies and edits."""
    r = random.Random(seed)
    syllables = "ba ko ri mu te na so li pa ve du ga fi lo".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 4)))
    common = [word() for _ in range(400)]
    prose = lambda n: " ".join(r.choice(common) for _ in range(n))
    insults = ["grubnak", "smelvork", "dufflejak", "plonkerish"]
    texts, toxic = [], set()
    for i in range(420):
        kind = i % 7
        text = prose(r.randint(70, 180))
        if kind in (1, 4):
            toxic.add(len(texts))
            words = text.split()
            for k in r.sample(range(len(words)), 3):
                w = r.choice(insults)
                cut = r.randrange(1, len(w))
                words[k] = r.choice((w, w[:cut] + "x" + w[cut:], w[:cut] + "-" + w[cut:]))
            text = " ".join(words)
        elif kind == 2:
            text = r.choice((prose(20), f"{prose(8)} " * 12, text.replace(" ", " #$% ", 40), ""))
        elif kind == 3:
            at = text.index(" ", 40)
            text = f"{text[:at]} mail {word()}.{word()}@{word()}.example.org or +49 30 {r.randint(1000000, 9999999)} from 10.{r.randint(0, 255)}.3.4{text[at:]}"
        texts.append(text)
        if kind == 5:
            words = text.split()
            for n in (0, 1, 2):  # copies and near copies
                for k in r.sample(range(len(words)), n):
                    words[k] = word()
                texts.append(" ".join(words))
    return [(i, t, f"src{i % 5}") for i, t in enumerate(texts)], toxic


def masked(text):
    out, at = [], 0
    for kind, a, b in sorted(brute_spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def brute(rows, toxic):
    """doc_id and masked text of what is kept."""
    calm = [x for x in rows if x[0] not in toxic]
    m = {i: brute_quality(t) for i, t, _ in calm}
    base = {i: x[0] < 50 or 100 * x[4] > 50 * x[0] for i, x in m.items()}
    some = {i: base[i] or 100 * x[2] > 10 * x[0] or 100 * x[3] > 30 * x[5] for i, x in m.items()}
    verdict = brute_hosts((h, some[i]) for i, _, h in calm)
    good = [(i, t) for i, t, h in calm if not base[i] and {"rejected": False, "trusted": True, "watched": not some[i]}[verdict[h]]]
    held = set(brute_kept(good))
    return {i: masked(t) for i, t in good if i in held}


def test_run_is_the_brute_force_version(spark, tmp_path):
    rows, toxic = corpus()
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _, _ in rows if i % 3], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = brute(rows, toxic)
    assert 150 < len(want) < 300
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    pieces = Counter()
    for i, t in want.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert len(ids) <= 2048
        pieces[i, 0, 0, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in got) == pieces
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        ends = 0
        for offset, n in sorted(places):
            assert offset == ends
            ends += n
        assert ends <= 2048
    assert len(held) == -(-sum(n for _, _, _, n, _ in pieces) // 2048)
    assert not any(re.search(r"@|\+49", t) for t in want.values())
