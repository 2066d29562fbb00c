"""The likelihood ratio of secrets against a plain count, and on planted strings of several kinds."""

import math
import random
import re
import string
from collections import defaultdict

from pyspark.sql import functions as F

from talkloom.llm import decontaminate, secrets

WORDS = "how to plan a trip with your best friends and what you need for cheap travel in winter light garden recipes from home quick guide review city museum weekend summer healthy breakfast".split()


def planted(n=50):
    r = random.Random(3)
    make = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    slug = lambda: "-".join(r.choice(WORDS) for _ in range(r.randint(4, 7)))
    kinds = {
        "letters": lambda: make(string.ascii_letters, 32),
        "characters": lambda: make(string.ascii_letters + string.digits, 17),
        "lower with digits": lambda: make(string.ascii_lowercase + string.digits, 32),
        "lower": lambda: make(string.ascii_lowercase, 32),
        "path": lambda: f"articles/2024/{r.randint(1, 12):02d}/{slug()}-{r.randint(1, 9)}",
        "slug": slug,
        "snake": lambda: "_".join(r.choice(WORDS) for _ in range(5)),
    }
    return [(kind, f"see {f()} for more") for kind, f in kinds.items() for _ in range(n)]


def plain_ratio(samples):
    n = {0: defaultdict(float), 1: defaultdict(float)}
    for text, label, weight in samples:
        chars = ["", *text, ""]
        for a, b in zip(chars, chars[1:], strict=False):
            n[label][a, b] += weight
    first = {k: defaultdict(float) for k in n}
    for k, pairs in n.items():
        for (a, _), w in pairs.items():
            first[k][a] += w
    log = lambda k, a, b: math.log((n[k][a, b] + secrets.SMOOTH) / (first[k][a] + secrets.SMOOTH * 68))
    return lambda t: sum(log(1, a, b) - log(0, a, b) for a, b in zip(["", *t], [*t, ""], strict=True))


def test_planted_strings_and_plain_ratio(spark):
    prose = random.Random(1)
    rows = [(i, "prose", " ".join(prose.choices(WORDS, k=60))) for i in range(40)]
    rows += [(100 + i, kind, text) for i, (kind, text) in enumerate(planted())]
    docs = spark.createDataFrame(rows, "doc_id long, kind string, text string")
    got = {r.doc_id: r.spans for r in secrets.op2(docs).collect()}
    samples = secrets.generated_samples(spark).unionByName(secrets.word_samples(docs.select("text"))).collect()
    ratio = plain_ratio([(r.text, r.label, r.weight) for r in samples])
    found = defaultdict(int)
    for i, kind, text in rows:
        want = [f"markov:{m.start()}:{m.end()}" for m in re.finditer(secrets.CANDIDATE, text) if ratio(m[0]) >= secrets.MIN_NATS]
        assert got[i] == ",".join(want)
        found[kind] += bool(want)
    assert all(found[k] >= 45 for k in ("letters", "characters", "lower with digits", "lower"))
    assert all(found[k] <= 2 for k in ("path", "slug", "snake", "prose"))


def test_samples_have_both_kinds_with_and_without_digits(spark):
    s = secrets.generated_samples(spark).withColumn("digits", F.col("text").rlike("[0-9]"))
    assert {(r.label, r.digits) for r in s.select("label", "digits").distinct().collect()} == {(0, False), (0, True), (1, False), (1, True)}


def test_repeats_in_a_text_and_in_an_item_are_written_out_once():
    text, item = b"w " * 20_000 + b"x y z", b"w " * 1000
    q = decontaminate.Items(["a", "b"], [item, b"w " * 9])
    got = decontaminate.scan_shard([text, b"w " * 9 + b"q", b"w " * 8], q)
    assert got.n_hit.tolist() == [20_000, 9, 0] and got["items"].tolist() == [["a", "b"], ["b"], []]
    assert got.longest_words.tolist() == [1000, 9, 8]
