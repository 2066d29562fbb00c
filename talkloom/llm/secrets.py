"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

All in DataFrame functions. One pass over the whole texts takes the spans of the fixed patterns and of candidate strings
(runs of ``CANDIDATE``; a path is cut at its slashes) into a table of the shared folder, without the texts. Two first-order
character models, of random strings and of ordinary identifiers, are counted from labelled samples; a candidate is a secret if
its log-likelihood ratio over the whole string is ``MIN_NATS`` or more, whatever its characters are. Spans found so add to
those of the patterns and never overlap them.

Labelled samples (text, label, weight): by default random strings of seven alphabets and identifiers generated by rule (1 and
0), and the corpus's own words as ordinary (0): all runs of 2 to ``LONGEST_WORD`` letters that occur three times or more, by
their number, plain and in the styles of names, together as heavy as ``N_WORDS`` samples, so that the ratio doesn't
hang on the corpus's size. The counts are one row per pair of characters.

The span of a match of ``assign`` is the whole match. Positions are code points, ends exclusive.

Defined cases: null text is empty and has no spans; rows that repeat a doc_id, or have none, are reported each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm.rows import ROW
from talkloom.sources.scratch import cut

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Whole runs of the needed length: the same matches as all runs with the short ones dropped.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+_=-]{16,}"
MIN_ASSIGN = 12
#: Characters of candidates; a pair is coded as first * 128 + second, and 0 stands for either end.
CODES = 128
SMOOTH = 0.5
MIN_NATS = 11.0
LONGEST_WORD = 15
N_WORDS = 30_000

VERBS = "get set load parse write update remove count merge split check build create fetch handle render select format".split()
NOUNS = (
    "user account record message index buffer customer document session response transaction configuration network version product manager service window object request value number history "
    "template button payment category language example question journey keyboard"
).split()
N_RANDOM = 600


def generated_samples(spark: SparkSession) -> DataFrame:
    """(text, label, weight): digests in base 64, hex, and letters of either case or one, with digits and without; and names of a
    verb and nouns in seven styles, some with a number."""
    digest = lambda salt: F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    b64 = F.concat(*[F.regexp_replace(F.base64(F.unhex(digest(x))), "[/=]", "") for x in ("sample", "more")])
    mixed, letters = F.regexp_replace(b64, "[+]", ""), F.regexp_replace(b64, "[^A-Za-z]", "")
    cut32 = lambda x: F.substring(x, 1, 32)
    kinds = [cut32(b64), F.substring(digest("hex"), 1, 40), cut32(mixed), cut32(letters), cut32(F.lower(mixed)), cut32(F.lower(letters)), cut32(F.upper(mixed))]
    random = spark.range(N_RANDOM).select(F.explode(F.array(*kinds)).alias("text"), F.lit(1).alias("label"))
    words = lambda x, name: F.explode(F.array(*[F.lit(w) for w in x])).alias(name)
    names = spark.range(1).select(words(VERBS, "v")).select("v", words(NOUNS, "a")).select("v", "a", words(NOUNS, "b")).where("a != b")
    number = F.pmod(F.crc32(F.concat("a", "v", "b")), F.lit(100)).cast("string")
    joined = [F.concat_ws("_", "v", "a", "b"), F.concat_ws("-", "v", "a", "b"), F.concat("v", F.initcap("a"), F.initcap("b")), F.concat_ws("_", "v", "a", "b", number), F.concat_ws("-", "a", "b", number), F.upper(F.concat_ws("_", "v", "a", "b")), F.concat("v", "a", "b")]
    plain = names.select(F.explode(F.array(*joined)).alias("text"), F.lit(0).alias("label"))
    return random.unionByName(plain).withColumn("weight", F.lit(1.0))


def word_samples(texts: DataFrame) -> DataFrame:
    """(text, label, weight) of the words of a column ``text``: ordinary, by how often each occurs."""
    runs = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)), lambda w: F.length(w) <= LONGEST_WORD)
    counts = texts.select(F.explode(runs).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n >= 3")
    counts = cut(counts, "secrets-words")
    total = F.coalesce(counts.agg(F.sum("n").alias("t")).scalar(), F.lit(1))
    low, high, between = F.lower("w"), F.upper("w"), lambda mark, w: F.concat(F.lit(mark), w, F.lit(mark))
    # words follow each other directly, with a capital, or with a mark between; a word after itself stands for any two
    styles = F.array("w", between("-", F.col("w")), between("_", F.col("w")), between("_", high), F.concat(low, F.initcap(low), F.initcap(low)), F.concat(low, low, low))
    return counts.select(F.explode(styles).alias("text"), F.lit(0).alias("label"), (F.col("n") * F.lit(N_WORDS / 6) / total).alias("weight"))


def pair_codes(text: Column) -> Column:
    """Codes of the pairs of neighbours in ``text`` with its ends; characters that candidates don't have count as an end."""
    code = F.transform(F.split(text, ""), lambda c: _once(F.ascii(c), lambda x: F.when(x < CODES, x).otherwise(0)))

    def pairs(whole: Column) -> Column:
        n = F.size(whole) - 1
        return F.zip_with(F.slice(whole, 1, n), F.slice(whole, 2, n), lambda a, b: a * CODES + b)

    return _once(F.concat(F.array(F.lit(0)), code, F.array(F.lit(0))), pairs)


def markov_ratio(samples: DataFrame) -> DataFrame:
    """One row, one column ``ratio``: log P(second | first) of random strings less that of ordinary ones, by pair code."""
    coded = samples.where(F.col("text").isNotNull()).select("label", "weight", F.explode(pair_codes(F.col("text"))).alias("code"))
    of = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("weight"))), F.lit(0.0)).alias(f"n{label}")
    counts = coded.groupBy("code").agg(of(1), of(0))
    every = samples.sparkSession.range(CODES * CODES).select(F.col("id").cast("int").alias("code")).join(counts, "code", "left").na.fill(0.0, ["n0", "n1"])
    first = every.groupBy(F.floor(F.col("code") / CODES).alias("first")).agg(F.sum("n1").alias("s1"), F.sum("n0").alias("s0"))
    joined = every.withColumn("first", F.floor(F.col("code") / CODES)).join(first, "first")
    # 67 characters and the end can follow; others are never looked up
    p = lambda n, s: F.log((F.col(n) + SMOOTH) / (F.col(s) + SMOOTH * 68))
    return joined.agg(F.transform(F.array_sort(F.collect_list(F.struct("code", (p("n1", "s1") - p("n0", "s0")).alias("r")))), lambda x: x["r"]).alias("ratio"))


def _once(value: Column, f) -> Column:
    """f(value), where ``value`` is worked out once, however often ``f`` uses it within lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(items: Column, zero: Column, step, emit, emitted: str) -> Column:
    """emit(state, item) for each item, where step(state, item) is the state that the next one meets.

    Appending to an array copies it, so results are gathered in blocks of about the square root of their number: n ** 1.5
    small values are copied, not n ** 2.
    """

    def whole(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(xs))).cast("int")

        def block(acc: Column, i: Column) -> Column:
            def one(a: Column, x: Column) -> Column:
                return F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(emit(a["at"], x))).alias("out"))

            start = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{emitted}>").alias("out"))
            part = F.aggregate(F.slice(xs, i * size + 1, size), start, one)
            return _once(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(p["out"])).alias("out")))

        start = F.struct(zero.alias("at"), F.array().cast(f"array<array<{emitted}>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), start, block, lambda acc: F.flatten(acc["out"]))

    return _once(items, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(F.array().cast(f"array<{emitted}>")))


def _spans(pieces: Column, matches: Column) -> Column:
    """Array of (s, e, m): where each of ``matches`` stands between the ``pieces`` that a split at them leaves."""

    def placed(ms: Column) -> Column:
        steps = F.zip_with(F.slice(pieces, 1, F.size(ms)), ms, lambda p, m: F.length(p) + F.length(m))
        ends = running(steps, F.lit(0), lambda at, x: at + x, lambda at, x: at + x, "int")
        return F.zip_with(ends, ms, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))

    return F.when(F.size(matches) > 0, _once(matches, placed)).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def _free(spans: Column, base: Column) -> Column:
    """Those of ``spans`` (in order, none within another) that no span of ``base`` overlaps: both in order of their starts, passed forwards
    with the furthest end so far and backwards with the nearest start to come."""
    tag = lambda x, own, i: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x["e"].alias("e"), i.alias("i"))

    def clear(both: Column) -> Column:
        none = F.lit((1 << 31) - 1)
        after = running(both, F.lit(0), lambda at, x: F.when(x["own"] == 0, F.greatest(at, x["e"])).otherwise(at), lambda at, x: at <= x["s"], "boolean")
        before = running(F.reverse(both), none, lambda at, x: F.when(x["own"] == 0, x["s"]).otherwise(at), lambda at, x: at >= x["e"], "boolean")
        marked = F.arrays_zip(both.alias("x"), after.alias("a"), F.reverse(before).alias("b"))
        return F.transform(F.filter(marked, lambda z: (z["x"]["own"] == 1) & z["a"] & z["b"]), lambda z: z["x"]["i"])

    def kept(own: Column) -> Column:
        both = F.array_sort(F.concat(F.transform(base, lambda x: tag(x, 0, F.lit(-1))), F.transform(own, lambda x, i: tag(x, 1, i))))
        return F.transform(_once(both, clear), lambda i: F.get(own, i))

    return _once(spans, kept)


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without their text as a struct, with arrays of spans ``_assign``, ``_access``, ``_hex`` and ``_candidate``."""
    rest = [ROW]
    patterns = {"_assign": ASSIGN, "_access": ACCESS, "_hex": HEX, "_candidate": CANDIDATE}
    others = [c for c in docs.columns if c != text]
    t = docs.select(F.struct(*[docs[c] for c in others]).alias(ROW), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = t.select("*", *[F.regexp_extract_all("_t", F.lit(p), F.lit(0)).alias(f"{k}_m") for k, p in patterns.items()])
    value = F.when(F.size("_assign_m") > 0, F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2)))
    t = t.select("*", value.alias("_value"), *[F.when(F.size(f"{k}_m") > 0, F.split("_t", p, -1)).alias(f"{k}_p") for k, p in patterns.items()])
    t = t.select(*rest, "_value", *[_spans(F.col(f"{k}_p"), F.col(f"{k}_m")).alias(k) for k in patterns])
    # the groups are kept beside their matches, as an expression they would be extracted again for each
    long_enough = _once(F.arrays_zip(F.col("_assign").alias("span"), F.coalesce("_value", F.array().cast("array<string>")).alias("v")), lambda z: F.filter(z, lambda x: F.length(x["v"]) >= MIN_ASSIGN))
    return t.withColumn("_assign", F.transform(long_enough, lambda x: x["span"])).drop("_value")


def _joined(spans: Column) -> Column:
    text = lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def scan(docs: DataFrame, samples: DataFrame | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without their text as a struct, with ``_base`` and ``_all``: spans (s, o, e, k) by start and then kind, where k names
    the kind and o its rank."""
    spark = docs.sparkSession
    table = cut(found(docs, text), "secrets-spans")
    if samples is None:
        samples = generated_samples(spark).unionByName(word_samples(docs.select(F.col(text).alias("text"))))
    elif "weight" not in samples.columns:
        samples = samples.withColumn("weight", F.lit(1.0))
    model = cut(markov_ratio(samples), "secrets-markov")
    ratio = model.select("ratio").scalar()
    table = table.withColumn("_ratio", ratio)

    def likely(x: Column) -> Column:
        return F.aggregate(pair_codes(x["m"]), F.lit(0.0), lambda acc, code: acc + F.get("_ratio", code)) >= MIN_NATS

    tag = lambda k, o: F.transform(k, lambda x: F.struct(x["s"].alias("s"), F.lit(o).alias("o"), x["e"].alias("e"), F.lit(k[1:]).alias("k")))
    table = table.withColumn("_base", F.array_sort(F.concat(tag("_assign", 0), tag("_access", 1), tag("_hex", 2))))
    # where a base span covers part of a candidate, the candidate adds nothing
    table = table.withColumn("_candidate", F.filter("_candidate", likely))
    table = table.withColumn("_candidate", F.when((F.size("_candidate") > 0) & (F.size("_base") > 0), _free(F.col("_candidate"), F.col("_base"))).otherwise(F.col("_candidate")))
    more = F.transform("_candidate", lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("o"), x["e"].alias("e"), F.lit("markov").alias("k")))
    return table.withColumn("_all", F.array_sort(F.concat("_base", more))).drop("_ratio")


def op2(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    out = scan(docs.select("doc_id", "text"))
    n = lambda k: F.size(f"_{k}").cast("long").alias(f"n_{k}")
    return out.select(F.col(ROW).getField("doc_id").alias("doc_id"), n("assign"), n("access"), n("hex"), F.size("_candidate").cast("long").alias("n_markov"), F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_all")).alias("spans"))
