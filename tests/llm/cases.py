"""Documents that try every operator: nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with inner ones."""

LONG = "one of the very long lines that go on and on without much sense 12 +49 30 1234567 a.b@c.example.org\n" * 3000
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _id string, _fp string, _KEY string, _text int, _host string, _NAME boolean, score string, "
    "spans double, kept string, _task string, _rank string, length string, sequence_id string, _bucket string, _TIE string, fingerprint string, "
    "`a.b` string, _KEY0 string, _NAME0 int, _TIE0 string, _MARKED string, _Failed string, _MASKED string, `c``d` string, _ROW string, _any string, Verdict string"
)
_EXTRA = ("x", "y", "z", 1, "h", True, "s", 0.5, "k", "t", "r", "l", "q", "b", "i", "f", "ab", "k0", 7, "t0", "m", "fa", "ma", "cd", "ro", "an", "ve")
WORDS = "the quick brown fox jumps over a lazy dog while many other animals watch it from far away and think about what to do next in this place of peace".split()
PLAIN = " ".join(WORDS + [w + "s" for w in WORDS])
TEXTS = [
    (1, PLAIN), (2, PLAIN), (3, PLAIN + " end"), (4, None), (5, ""), (6, " \t\n "), (7, LONG), (8, "one"), (9, "Naïve café — Straße ΣΑΣ İstanbul 𝒳 \u2028 \u0085 x\x0by"),
    (10, "mail a.b+c@d-e.example.org, b@c.d ip 1.2.3.4 999.1.1.1 card 4111 1111 1111 1111 call +1 (212) 555-0199 <|endoftext|> <|startoftext|>"), (None, "no id"), (None, None),
    (11, PLAIN.upper()), (11, PLAIN.upper()), (12, "word " * 500), (13, "same line here\n" * 60), (14, "x" * 5000), (15, "#$%& " * 30), (16, "a\u0301 \u00e1 \ufb01 \u1e9e \ud55c\uad6d\uc5b4 \U0001f600 's 've it's"),
]


def documents(spark, rows=None):
    rows = TEXTS if rows is None else rows
    sources = ("src0", "src1", None)
    return spark.createDataFrame([(i, t, "en", sources[k % 3], len(t or ""), *_EXTRA) for k, (i, t) in enumerate(rows)], SCHEMA)


def plain(rows):
    """Rows as tuples, sorted with nulls first."""
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
