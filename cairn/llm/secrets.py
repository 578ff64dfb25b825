"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: The kinds in their order, their patterns, and the least characters of the group that counts.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run is matched whole, so short ones can be left out here
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Candidates for the battery: whole runs of 16 characters or more with a digit and a letter.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}"
#: Encodings, the first that fits is inferred: name, pattern, alphabet.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", ".", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Departures of structured text from randomness, at least: how far its symbols' shares are from uniform (the sum of (share - 1/k)^2 k), the correlation of
#: neighbours, and how much of the random rate its class of characters changes at: that of 16 characters, more for each doubling (names of short words
#: change theirs often; a short token says too little to be told from them), at most.
UNEVEN, SERIAL = 1.25, 0.45
STRUCTURE, MORE, STRUCTURE_MOST = 0.22, 0.15, 0.5
#: Departures that a random text may have, as its encoding is only inferred, and where a test rejects randomness beyond them (two-sided 0.01).
SLIGHT, REJECT = 0.1, 2.58
#: False-discovery rate; steps of -log10 p, their number.
RATE, STEP, STEPS = 0.01, 16, 640


def class_shares(alphabet: str) -> list[float]:
    """Shares of lower case, upper case, digits and the rest in an alphabet."""
    parts = [sum(c in own for c in alphabet) for own in (LOWER, UPPER, DIGITS)]
    return [x / len(alphabet) for x in (*parts, len(alphabet) - sum(parts))]


def battery(tokens: DataFrame) -> DataFrame:
    """(token, encoding, n, z_chi, z_runs, z_serial, p_chi, p_runs, p_serial, p) of each distinct token.

    Three tests on the encoding inferred: chi-squared of the symbols' counts against uniformity; runs of characters of one class (lower case, upper case, digit, other); lag-1
    correlation of the symbols' values. The z say how far the text is from random, beyond a SLIGHT departure, in standard deviations for its length. The p are bounds on the
    chance that structured text (UNEVEN, STRUCTURE, SERIAL) of this length looks as random as this one: for the runs the binomial tail by its first term, for the others
    a normal one. ``p`` combines them by Fisher's method: what tells little at a length adds little.

    Memory grows with a token's length (its characters' values are an array), which is no more than that of its text.
    """

    def pick(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("__e"))

    which = F.coalesce(*[F.when(F.col("__body").rlike(pattern), F.lit(k + 1)) for k, (_, pattern, _) in enumerate(ENCODINGS)])
    shares = [class_shares(alphabet) for *_, alphabet in ENCODINGS]
    change = [1 - sum(x * x for x in own) for own in shares]
    twice = [sum(x * (1 - x) ** 2 for x in own) for own in shares]
    rows = C.cut(tokens.withColumn("__body", F.regexp_replace("token", "=+$", "")).withColumn("__e", which).withColumn("__alphabet", pick([a for *_, a in ENCODINGS])))
    # cut here and below, as lambdas would work out again for each element what a column before them says
    symbols = F.sequence(F.lit(1), F.length("__alphabet"))
    count = F.transform(symbols, lambda k: F.length("__body") - F.length(F.replace(F.col("__body"), F.substring("__alphabet", k, F.lit(1)), F.lit(""))))
    values = F.transform(F.filter(F.split("__body", ""), lambda c: c != ""), lambda c: F.instr(F.col("__alphabet"), c).cast("double"))
    rows = C.cut(rows.select("token", "__body", "__e", F.length("__body").cast("double").alias("n"), F.length("__alphabet").cast("double").alias("__k"), count.alias("__count"), values.alias("__v")))

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda t, v: t + v)

    n, freedom = F.col("n"), F.col("__k") - 1
    chi = F.col("__k") / n * total(F.transform("__count", lambda c: c.cast("double") * c)) - n
    runs = F.regexp_count("__body", F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")).cast("double")
    q, q2, pairs, changes = F.col("__q"), pick(twice), F.col("__pairs"), F.col("__changes")
    rows = rows.withColumn("__q", pick(change)).withColumn("__changes", runs - 1).withColumn("__pairs", n - 1)
    spread = F.sqrt(pairs * q * (1 - q) + 2 * (pairs - 1) * (q2 - q * q))
    # sums of products of neighbours, and of squares, about the mean
    sums, ends = total(F.col("__v")), F.element_at("__v", 1) + F.element_at("__v", -1)
    mean = sums / n
    products = total(F.zip_with(F.slice("__v", F.lit(1), F.size("__v") - 1), F.slice("__v", F.lit(2), F.size("__v") - 1), lambda x, y: x * y))
    together = products - mean * (2 * sums - ends) + pairs * mean * mean
    alone = total(F.transform("__v", lambda v: v * v)) - n * mean * mean
    rows = rows.withColumn("__chi", chi - freedom).withColumn("__r", F.when(alone > 1e-9, F.abs(together / alone)).otherwise(F.lit(1.0)))

    def above(excess: Column, slight: float) -> Column:
        return (F.col("__chi") - excess * slight) / F.sqrt(2 * freedom * pairs / n + 4 * excess * slight)

    def tail(z: Column) -> Column:
        """The normal distribution function: a logistic curve, and far below a bound on it."""
        far = F.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * -z)
        return F.when(z < -2, far).otherwise(1 / (1 + F.exp(-(1.5976 * z + 0.070565 * z * z * z))))

    share = F.least(F.lit(STRUCTURE_MOST), STRUCTURE + MORE * F.log2(n / 16))
    seen, rare = F.least(changes / pairs, F.lit(1 - 1e-9)), share * q
    divergence = seen * F.log(seen / rare) + (1 - seen) * F.log((1 - seen) / (1 - rare))
    first = F.exp(-pairs * divergence)
    term = first / F.sqrt(2 * math.pi * pairs * seen * (1 - seen)) * seen * (1 - rare) / (seen - rare)
    p_runs = F.when(seen > rare, F.least(first, F.when(changes < pairs, term).otherwise(first))).otherwise(F.lit(1.0))
    rows = rows.select(
        "token",
        pick([name for name, *_ in ENCODINGS]).alias("encoding"),
        "n",
        above(n, SLIGHT).alias("z_chi"),
        ((F.abs(changes - pairs * q) - SLIGHT * pairs * q) / spread).alias("z_runs"),
        ((F.col("__r") - SLIGHT) * F.sqrt("n")).alias("z_serial"),
        tail(above(pairs, UNEVEN)).alias("p_chi"),
        p_runs.alias("p_runs"),
        tail((F.col("__r") - SERIAL) * F.sqrt("n")).alias("p_serial"),
    )
    evidence = -sum((F.log(F.greatest(c, F.lit(1e-300))) for c in ("p_chi", "p_runs", "p_serial")), F.lit(0.0))
    return rows.withColumn("p", F.exp(-evidence) * (1 + evidence + evidence * evidence / 2))


def discoveries(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """The tokens taken for random, and so for secrets.

    The combined p must be small: by Benjamini and Hochberg's step-up at ``rate`` among all tested tokens of the same length class (a doubling each), so that the many
    short tokens, which can't be told apart well, don't loosen the threshold of the long ones, or the other way round. p-values are rounded up
    to a grid, whose counts are all that the classes need; this only makes the control stricter. And no test of the battery may find the token
    further from random than REJECT.
    """
    step = F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-300))) * STEP), F.lit(STEPS)).cast("int")
    rows = tested.withColumn("__length", F.floor(F.log2("n")).cast("int")).withColumn("__step", step)
    own = Window.partitionBy("__length")
    grid = rows.groupBy("__length", "__step").agg(F.count(F.lit(1)).alias("__n"))
    grid = grid.withColumn("__all", F.sum("__n").over(own)).withColumn("__found", F.sum("__n").over(own.orderBy(F.col("__step").desc())))
    passing = grid.filter(F.col("__all") * F.pow(F.lit(10.0), -F.col("__step") / STEP) <= rate * F.col("__found"))
    threshold = passing.groupBy("__length").agg(F.min("__step").alias("__least"))
    random = (F.col("z_chi") <= REJECT) & (F.col("z_runs") <= REJECT) & (F.col("z_serial") <= REJECT)
    return rows.join(F.broadcast(threshold), "__length").filter((F.col("__step") >= F.col("__least")) & random).select("token")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a row (row, id) for each row of ``df``, and (row, kind, start, end, value) for each secret in its whole text.

    Places count code points, the end is exclusive. Kinds: ``assign``, ``access`` and ``hex`` by pattern, leftmost and not overlapping within a
    kind; ``random`` by the battery, over the distinct candidates of all texts, where no other kind overlaps. Null texts have none.
    Each row is judged alone, whatever its id; an empty table gives no rows. Other columns of ``df`` are not read.
    """
    patterns = [ASSIGN, ACCESS, HEX, RUN]
    kinds = [*KINDS, "random"]

    def matches(order: int, pattern: str) -> Column:
        """A kind's matches, each with the length of what stands between it and the one before; null without any."""
        hits, gaps = F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)), F.split("__text", pattern, -1)
        both = F.zip_with(hits, gaps, lambda hit, gap: F.struct(hit.alias("value"), F.length(gap).alias("gap")))
        # behind the last match there is a gap more
        own = F.filter(both, lambda m: m["value"].isNotNull())
        return F.when(F.col("__text").rlike(pattern), F.struct(F.lit(order).alias("order"), own.alias("hits")))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("__text"))
    found = F.array_compact(F.array(*[matches(k, p) for k, p in enumerate(patterns)]))
    rows = C.cut(rows.select("row", "id", found.alias("found")))
    hits = rows.select("row", F.explode("found").alias("f")).select("row", F.col("f.order").alias("order"), F.posexplode("f.hits").alias("nth", "hit"))
    hits = hits.select("row", "order", "nth", "hit.value", (F.length("hit.value")).alias("__size"), F.col("hit.gap").alias("__gap"))
    so_far = Window.partitionBy("row", "order").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("end", F.sum(F.col("__gap") + F.col("__size")).over(so_far).cast("long")).withColumn("start", F.col("end") - F.col("__size"))
    counts = (F.col("order") > 0) | (F.length(F.regexp_extract("value", ASSIGN, 2)) >= LEAST["assign"])
    counts = counts & ((F.col("order") != 1) | (F.col("__size") >= LEAST["access"])) & ((F.col("order") != 2) | (F.col("__size") >= LEAST["hex"]))
    hits = hits.filter(counts).select("row", "order", "start", "end", "value")
    # base spans that reach into a candidate: an earlier one ends behind its start, or a later one starts before its end
    place = Window.partitionBy("row").orderBy("start", "order")
    base_end, base_start = F.when(F.col("order") < 3, F.col("end")), F.when(F.col("order") < 3, F.col("start"))
    hits = hits.withColumn("__reach", F.max(base_end).over(place.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__next", F.min(base_start).over(place.rowsBetween(0, Window.unboundedFollowing)))
    free = (F.coalesce("__reach", F.lit(-1)) <= F.col("start")) & (F.col("__next").isNull() | (F.col("__next") >= F.col("end")))
    hits = C.cut(hits.withColumn("__free", free).drop("__reach", "__next"))
    base, open_ = hits.filter("order < 3"), hits.filter("order = 3")
    secret = discoveries(C.cut(battery(open_.select(F.col("value").alias("token")).distinct())), rate)
    random = open_.filter("__free").join(secret, F.col("value") == F.col("token"), "left_semi")
    spans = base.unionByName(random).withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("order") + 1))
    return rows.select("row", "id"), spans.select("row", "order", "kind", "start", "end", "value")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts by pattern, the digest of their places, and all places."""
    rows, spans = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    entry = F.struct("start", "order", F.concat_ws(":", "kind", "start", "end").alias("said"))
    number = [F.count_if(F.col("order") == k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    lists = spans.groupBy("row").agg(*number, F.array_sort(F.collect_list(F.when(F.col("order") < 3, entry))).alias("__base"), F.array_sort(F.collect_list(entry)).alias("__all"))
    told = lambda c: F.coalesce(F.array_join(F.transform(c, lambda s: s["said"]), ","), F.lit(""))
    joined = rows.join(lists, "row", "left")
    counts = [F.coalesce(f"n_{kind}", F.lit(0)).alias(f"n_{kind}") for kind in KINDS]
    return joined.select(F.col("id").alias("doc_id"), *counts, F.sha2(told("__base"), 256).alias("base_sha256"), told("__all").alias("spans"))
