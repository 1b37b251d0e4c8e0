"""Secrets in whole texts: fixed patterns, and a randomness test battery with false-discovery control.

Built-in functions only. The base patterns find assignments, access keys and
long hex. The battery looks at every long run of key characters, infers its
encoding from the characters it has, and asks of each

* uniformity: chi-squared of the counts of the alphabet's characters,
* runs: of characters in the upper and lower half of the alphabet,
* serial correlation: of neighbouring places in the alphabet.

A run that passes all three could be drawn at random. That it was not written
by hand is told by an e-value: how much likelier uniform characters make it than
the character frequencies of writing do, which grows with the length. Over all
runs of the corpus the e-values pass the Benjamini-Hochberg procedure (e-BH),
which bounds the share of false discoveries whatever depends on what; the levels
are powers of two, so the corpus is one small histogram.

Spans are code points, end exclusive. Cases: null and empty texts have none.
Repeated rows give equal results. Rows without an id are kept. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The base patterns, and the least length of what they must hold.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

#: Runs that the battery looks at.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Each test may refuse a random run this often; the share of false discoveries.
REFUSED = 0.001
FALSE_SHARE = 0.01

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Inferred encodings: what the run must match, and the alphabet.
_ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef"),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567"),
    (r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", _DIGITS + _LOWER),
    (r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", _DIGITS + _UPPER),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: Frequencies of letters in writing, in thousandths; a capital is as rare as SHARE_UPPER
#: says, digits have a share in all, and so have other characters.
_LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
_THOUSANDTHS = (120, 91, 81, 77, 73, 70, 63, 59, 60, 43, 40, 27, 29, 26, 21, 23, 20, 21, 18, 15, 11, 7, 1, 2, 1, 1)
_SHARE_LOWER, _SHARE_UPPER, _SHARE_DIGIT, _SHARE_OTHER = 0.75, 0.1, 0.13, 0.02


def _phi(z: Column) -> Column:
    """Normal distribution function, within 2e-4."""
    return F.lit(1.0) / (1.0 + F.exp(F.greatest(F.least(-1.5976 * z - 0.070565988 * z * z * z, F.lit(700.0)), F.lit(-700.0))))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * _phi(-F.abs(z)))


def _body(run: Column) -> Column:
    return F.rtrim(run, F.lit("="))


def alphabet(body: Column) -> Column:
    """The alphabet of the inferred encoding; null where there is none."""
    out = F.lit(None).cast("string")
    for pattern, letters in reversed(_ENCODINGS):
        out = F.when(body.rlike(pattern), F.lit(letters)).otherwise(out)
    return out


def randomness(body: Column, letters: Column) -> Column:
    """The least probability that the three tests give a run of uniform characters, by Bonferroni."""
    n = F.length(body).cast("double")
    k = F.length(letters).cast("double")
    squares = F.aggregate(
        F.split(letters, ""),
        F.lit(0.0),
        lambda acc, c: acc + F.pow((F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double"), F.lit(2.0)),
    )
    chi = squares * k / n - n
    uniform = 1.0 - _phi((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))

    places = F.transform(F.split(body, ""), lambda c: F.instr(letters, c).cast("double"))
    # (count above the middle, changes, last side, sum of products, last place, sum, sum of squares)
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("runs"), F.lit(-1).alias("side"), F.lit(0.0).alias("products"), F.lit(0.0).alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("squares"))

    def walk(acc: Column, p: Column) -> Column:
        side = (p > k / 2).cast("int")
        return F.struct(
            (acc["up"] + side).alias("up"),
            (acc["runs"] + (side != acc["side"]).cast("double")).alias("runs"),
            side.alias("side"),
            (acc["products"] + p * acc["last"]).alias("products"),
            p.alias("last"),
            (acc["sum"] + p).alias("sum"),
            (acc["squares"] + p * p).alias("squares"),
        )

    def probability(acc: Column) -> Column:
        up, down = acc["up"], n - acc["up"]
        mean = 2 * up * down / n + 1
        spread = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
        runs = F.when((up == 0) | (down == 0), F.lit(0.0)).otherwise(_two_sided((acc["runs"] - mean) / F.sqrt(spread)))
        middle = acc["sum"] / n
        variance = F.greatest(acc["squares"] / n - middle * middle, F.lit(1e-9))
        first = F.instr(letters, F.substring(body, 1, 1)).cast("double")
        covariance = (acc["products"] - middle * (2 * acc["sum"] - first - acc["last"]) + (n - 1) * middle * middle) / (n - 1)
        serial = _two_sided(covariance / variance * F.sqrt(n))
        return F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial))

    return F.aggregate(places, start, walk, probability)


def evidence_bits(body: Column, letters: Column) -> Column:
    """Base-2 logarithm of the e-value against writing by hand."""
    table = F.array(*[F.lit(float(t) / sum(_THOUSANDTHS)) for t in _THOUSANDTHS])

    def hand(c: Column) -> Column:
        letter = F.instr(F.lit(_LETTERS), F.lower(c))
        share = F.when(c == F.lower(c), F.lit(_SHARE_LOWER)).otherwise(F.lit(_SHARE_UPPER))
        p = F.when(letter > 0, share * F.get(table, letter - 1)).when(c.between("0", "9"), F.lit(_SHARE_DIGIT / 10)).otherwise(F.lit(_SHARE_OTHER))
        return F.log2(p)

    writing = F.aggregate(F.split(body, ""), F.lit(0.0), lambda acc, c: acc + hand(c))
    return -F.length(body) * F.log2(F.length(letters)) - writing


def _level(run: Column) -> Column:
    """Whole bits of evidence of a run that could be random; null of one that could not."""
    body = _body(run)
    letters = alphabet(body)
    return F.when(letters.isNotNull(), F.when(randomness(body, letters) > REFUSED, F.floor(evidence_bits(body, letters))))


def _spans(text: Column, pattern: str, group: int, keep) -> Column:
    """(start, end, found) of the matches that ``keep`` keeps; ``found`` is the group."""
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(
        F.transform(F.slice(gaps, 1, F.size(gaps) - 1), lambda g: F.length(g)).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m)).alias("size"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("found"),
    )
    span = "array<struct<start:int,end:int,found:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + m["size"]
        own = F.struct(begin.alias("start"), end.alias("end"), m["found"].alias("found"))
        return F.struct(end.alias("at"), F.when(keep(m["found"]), F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _where(text: Column, hint: Column, spans: Column) -> Column:
    """Spans of the texts that can have any."""
    return F.when(hint, spans).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def threshold(docs: DataFrame, text_col: str = "text") -> int | None:
    """Least level of e-BH over all runs of the corpus; None where nothing is found."""
    runs = docs.where(F.col(text_col).rlike(RUN)).select(F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"))
    levels = runs.select(_level(F.col("run")).alias("level")).groupBy("level").agg(F.count("*").alias("n"))
    # A few hundred levels. A level is a discovery if 2**level >= all / (share * those not below it).
    every = Window.partitionBy()
    above = Window.orderBy(F.desc_nulls_last("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        levels.withColumn("all", F.sum("n").over(every))
        .withColumn("upto", F.sum("n").over(above))
        .where(F.col("level").isNotNull() & (F.col("level") + F.log2(F.col("upto")) >= F.log2(F.col("all") / F.lit(FALSE_SHARE))))
    )
    return found.agg(F.min("level")).first()[0]


def secrets_found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of every row."""
    least = threshold(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    t = F.col("text")
    random = F.array().cast("array<struct<start:int,end:int,found:string>>")
    if least is not None:
        random = _where(t, t.rlike(RUN), _spans(t, RUN, 0, lambda run: _level(run) >= least))
    found = plain.select(
        "doc_id",
        _where(t, t.rlike("[:=]") & t.rlike(ASSIGN), _spans(t, ASSIGN, 1, lambda m: F.length(m) >= LEAST_ASSIGNED)).alias("assign"),
        _where(t, t.contains("AKIA"), _spans(t, ACCESS, 0, lambda m: F.length(m) >= LEAST_ACCESS)).alias("access"),
        # Runs of hex digits that are too short are never looked at.
        _where(t, t.rlike(f"[0-9a-f]{{{LEAST_HEX}}}"), _spans(t, f"[0-9a-f]{{{LEAST_HEX},}}", 0, lambda m: F.lit(True))).alias("hex"),
        random.alias("random"),
    )

    def named(kinds: tuple[str, ...]) -> Column:
        def ranked(kind: str) -> Column:
            rank = F.lit(KINDS.index(kind))
            return F.transform(kind, lambda s: F.struct(s["start"], rank.alias("kind"), s["end"]))

        each = [ranked(k) for k in kinds]
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(named(KINDS[:3]), 256).alias("base_sha256"),
        named(KINDS).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
