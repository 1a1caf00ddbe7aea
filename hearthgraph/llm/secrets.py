"""Secret scans: known patterns, and a battery of randomness tests for what no pattern names.

Everything here is DataFrame functions; no Python runs on the data.

Candidates are maximal runs of token characters. Each gets an encoding (hex, base32, base64 or
letters and digits) from the characters it has, and from that an alphabet of k characters. Three
statistics are taken of its n characters:

* chi-squared of the counts against the uniform alphabet. Ordinary names and words use few of the
  characters often, which adds about NATURAL * (k - 1) * n / k to what a random string has;
* runs: how many stretches of lower case, upper case, digits and signs there are. Ordinary names
  change class at CHANGES of their places at most;
* serial correlation of neighbouring characters, which only a random string keeps near zero.

A candidate must not be a plain number and must look random by the first and the third, and the p-value that it is ordinary all
the same is the larger of those of the first two, so that either explains it away. P-values of
the same length class go into one Benjamini-Hochberg cut at RATE: the short ones, of which there
are many and which show little, get no easier a threshold from the long ones. The cut is found
from a histogram (one row for each length class and p-value step), never from the candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table, unused

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters at least; shorter matches hold no longer one
HEX = r"[0-9a-f]{24,}"  # maximal runs, so the longer ones of all
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:int,kind:int,end:int>>"
RATE = 0.01
NATURAL = 2.2  # index of coincidence of words over 64 characters, relative to uniform, less one
CHANGES = 0.12
RUN = 64  # matches located at a time
STEPS = 20  # p-value steps for each power of ten
SEEMS_RANDOM = 3.0  # standard deviations that a random string may be off


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once: the one element of a list has a name."""
    return F.transform(F.array(value), use)[0]


def located(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of all matches, leftmost first, in code points; keep(match) drops some.

    The pieces between matches and the matches themselves give the places by their lengths."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(m).alias("n"), (keep(m) if keep else F.lit(True)).alias("k")))

    wide = lambda run: F.aggregate(run, F.lit(0), lambda n, x: n + x["g"] + x["n"])

    def inside(run, at):
        def step(acc, x):
            a = acc["at"] + x["g"]
            b = a + x["n"]
            span = F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("end")))
            return F.struct(b.alias("at"), F.when(x["k"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(run, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    # runs of RUN matches: the place of each run first, then the spans inside it, so that no list
    # grows match by match over a whole text
    def spans_of(found):
        return named(F.transform(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(RUN)), lambda i: F.slice(found, i, RUN)), placed)

    def placed(runs):
        place = F.aggregate(runs, F.array(F.lit(0)), lambda at, run: F.concat(at, F.array(F.element_at(at, -1) + wide(run))))
        return F.flatten(F.zip_with(runs, F.slice(place, 1, F.size(runs)), inside))

    spans = named(both, spans_of)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    return F.array_sort(F.concat(located(text, ASSIGN, 0, value), located(text, ACCESS, 1), located(text, HEX, 2)))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, within 2e-4."""
    z = F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def tested(token: Column) -> Column:
    """struct(len_class, step): the length class and the step of the p-value that the token is
    ordinary; null if it does not look random at all."""
    n = F.char_length(token).cast("double")
    k = (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16.0)
        .when(token.rlike("^[A-Z2-7]+=*$"), 32.0)
        .when(token.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), 36.0)
        .when(token.rlike("^[A-Za-z0-9]+$"), 62.0)
        .otherwise(64.0)
    )
    chars = F.split(token, "")
    square = lambda c: (F.char_length(token) - F.char_length(F.replace(token, c, F.lit("")))).cast("double")
    same = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + square(c) * square(c))
    chi = (k / n * same - n - (k - 1)) / F.sqrt(2 * (k - 1))
    spread = F.sqrt(2 * (k - 1) + 4 * NATURAL * n)
    p_chi = upper_tail((NATURAL * n * (k - 1) / k - chi * F.sqrt(2 * (k - 1))) / spread)
    runs = F.size(F.regexp_extract_all(token, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"), F.lit(0))).cast("double") - 1
    p_runs = upper_tail((runs - 0.5 - CHANGES * (n - 1)) / F.sqrt(CHANGES * (1 - CHANGES) * (n - 1)))
    codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    mean = F.aggregate(codes, F.lit(0.0), lambda s, x: s + x) / n
    centred = F.transform(codes, lambda x: x - mean)
    power = F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x)
    shifted = F.zip_with(centred, F.slice(centred, 2, F.size(centred) - 1), lambda x, y: x * F.coalesce(y, F.lit(0.0)))
    serial = F.coalesce(F.try_divide(F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x), power), F.lit(1.0)) * F.sqrt(n)
    # ordinary unless all of what would explain it fails: the larger p-value counts
    p = F.greatest(p_chi, p_runs)
    fit = ~token.rlike("^[0-9]+$") & (F.abs(chi) <= SEEMS_RANDOM) & (F.abs(serial + 1 / F.sqrt(n)) <= SEEMS_RANDOM)
    step = F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-20))) * STEPS), F.lit(20 * STEPS)).cast("int")
    return F.struct(F.floor(F.log2(n)).cast("int").alias("len_class"), F.when(fit, step).alias("step"))


def scanned(docs: DataFrame, base: str, more: str, text: str = "text") -> DataFrame:
    """docs with base (spans) and more (candidate spans with their tests); null text: empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    spans = located(whole, CANDIDATE, 3)
    tokens = F.when(F.size(spans) > 0, F.regexp_extract_all(whole, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    tests = F.zip_with(spans, tokens, lambda s, t: F.struct(s.alias("span"), tested(t).alias("test")))
    return docs.withColumns({base: base_spans(whole), more: tests})


def thresholds(found: DataFrame, more: str) -> dict[int, int]:
    """For each length class the least step that Benjamini-Hochberg lets through."""
    cells = found.select(F.explode(more).alias("m")).groupBy("m.test.len_class", F.coalesce("m.test.step", F.lit(-1)).alias("step")).agg(F.count("*").alias("n"))
    one = Window.partitionBy("len_class")  # at most 20 * STEPS + 2 rows for each of 31 classes
    down = one.orderBy(F.desc("step"))
    ranked = cells.withColumns({"total": F.sum("n").over(one), "up_to": F.sum("n").over(down)})
    passed = ranked.where((F.col("step") >= 0) & (F.pow(F.lit(10.0), -F.col("step") / STEPS) * F.col("total") <= RATE * F.col("up_to")))
    return {r.len_class: r.step for r in passed.groupBy("len_class").agg(F.min("step").alias("step")).collect()}  # at most 31 rows


def decided(base: str, more: str, limit: dict[int, int]) -> Column:
    """All base spans, and the discoveries that no base span overlaps, by start and kind."""
    picked = F.filter(more, lambda m: m["test"]["step"].isNotNull() & _reaches(m["test"], limit))
    new = F.transform(picked, lambda m: m["span"])
    meets = lambda b, s: (b["start"] < s["end"]) & (s["start"] < b["end"])

    # base spans in runs, each with its extent, so that a new span looks into few of them
    def alone(runs: Column) -> Column:
        return F.filter(new, lambda s: ~F.exists(runs, lambda g: meets(g, s) & F.exists(g["run"], lambda b: meets(b, s))))

    extent = lambda run: F.struct(run[0]["start"].alias("start"), F.array_max(run["end"]).alias("end"), run.alias("run"))
    free = F.when(F.size(base) > 0, named(F.transform(in_runs(F.col(base)), extent), alone)).otherwise(new)
    return F.array_sort(F.concat(base, free))


def in_runs(spans: Column) -> Column:
    """A list in runs as long as their number, so that no work on it grows with its square; one at
    least, empty for an empty list."""
    n = F.greatest(F.size(spans), F.lit(1))
    length = F.ceil(F.sqrt(n)).cast("int")
    return F.transform(F.sequence(F.lit(1), n, length), lambda i: F.slice(spans, i, length))


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """text with each span replaced by the mark, overlapping ones as one. spans by start, not empty.
    The text is cut once for each run of spans and that piece for each span of the run."""

    def of_run(run: Column, at: Column) -> Column:
        """What the run makes of the text from at (the end of all spans before) to its last start."""

        def piece(block: Column, s: Column, j: Column) -> Column:
            done = F.greatest(at, F.coalesce(F.array_max(F.slice(run, 1, j)["end"]), at))
            return named(done, lambda d: F.when(s["start"] >= d, F.concat(F.substring(block, d - at + 1, s["start"] - d), F.lit(mark))).otherwise(""))

        block = F.substring(text, at + 1, F.greatest(F.array_max(run["start"]) - at, F.lit(0)))
        return named(block, lambda b: F.array_join(F.transform(run, lambda s, j: piece(b, s, j)), ""))

    def whole(runs: Column) -> Column:
        ends = F.aggregate(runs, F.array(F.lit(0)), lambda at, run: F.concat(at, F.array(F.greatest(F.element_at(at, -1), F.array_max(run["end"])))))
        return named(ends, lambda e: F.concat(F.array_join(F.zip_with(runs, F.slice(e, 1, F.size(runs)), of_run), ""), F.substring(text, F.element_at(e, -1) + 1, F.lit(1 << 30))))

    return named(in_runs(spans), whole)


def _reaches(test: Column, limit: dict[int, int]) -> Column:
    out = F.lit(False)
    for len_class, step in sorted(limit.items()):
        out = out | ((test["len_class"] == len_class) & (test["step"] >= step))
    return out


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs with spans (start, kind as a place in KINDS, end), by start.

    Rows and other columns stay as they are (a column named spans is replaced); null and empty
    texts have no spans. The rows are written with what was found once, and read again for the
    spans; columns of any name may be there."""
    base, more = unused(docs, "_base", "_more")
    found = stored(scanned(docs, base, more), "secrets")
    return found.withColumn("spans", decided(base, more, thresholds(found, more))).drop(base, more)


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each span of text replaced by the mark, and n_chars of what is left.

    Overlapping spans are replaced as one. Texts without spans stay as they are, null included.
    Repeated rows, null ids and columns of any name stay; an empty table gives none."""
    cols, (base, more, spans) = docs.columns, unused(docs, "_base", "_more", "_spans")
    found = stored(scanned(docs, base, more), "secrets")
    found = found.withColumn(spans, decided(base, more, thresholds(found, more)))
    text = replaced(F.col("text"), F.col(spans), mark)
    found = found.withColumn("text", F.when(F.size(spans) > 0, text).otherwise(F.col("text")))
    if "n_chars" in cols:
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(cols)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Spans of the whole documents table by find_secrets' parts, with the counts and the digest
    of the base spans. Null and empty texts: counts 0, the digest of nothing, empty spans.
    Repeated rows and null ids stay; an empty table gives none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = stored(scanned(docs, "base", "more").drop("text"), "secrets")
    spans = decided("base", "more", thresholds(found, "more"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(spans).alias("spans"))
