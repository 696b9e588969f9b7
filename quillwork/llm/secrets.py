"""Secret scans by a randomness test battery (operator 3), in DataFrame functions alone.

Three fixed patterns (assignments, access keys, long hexadecimal runs) give base spans.  The battery adds spans: every
run of at least 20 token characters is tested for randomness over the alphabet of its inferred encoding: a chi-squared
test of uniformity, a runs test about a cut of the alphabet and a test of serial correlation.  Fisher's method combines
the three into one p-value under "drawn at random".  A base64 token uses the standard or the URL-safe alphabet; one that
mixes both has no encoding and is no candidate.  Padding belongs to a token's span but is not tested.  Alphabets of
letters alone begin with the vowels and are cut after them, for words alternate vowels and consonants.

False discoveries are controlled by encoding and length band.  Random tokens have uniform p-values, so those above one
half tell how many there are; a threshold is the least at which the tokens kept beyond that number are at most `FDR` of
all kept.  Only counts by encoding, band and bin of p leave the rows: at most 8 x 6 x 50 of them, whatever the corpus.

All steps are linear in a text's length, up to a logarithm of the number of matches or characters.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # equals "AKIA[A-Z0-9]+, then 16 characters or more": a run that is too short holds no other
HEX = r"[0-9a-f]{32,}"
_ANY = r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{32}"
_TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
_VOWELS, _CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_ALNUM = "0123456789" + _LETTERS.upper() + _LETTERS
#: Encoding: its pattern, its alphabet, and the cut of the runs test.  The first pattern that fits is inferred.
ENCODINGS = {
    "digits": ("^[0-9]+$", "0123456789", 5),
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 8),
    "lower": ("^[a-z]+$", _VOWELS + _CONSONANTS, 6),
    "upper": ("^[A-Z]+$", (_VOWELS + _CONSONANTS).upper(), 6),
    "base32": ("^[A-Z2-7]+$", "234567" + _LETTERS.upper(), 16),
    "letters": ("^[A-Za-z]+$", _VOWELS + _VOWELS.upper() + _CONSONANTS + _CONSONANTS.upper(), 12),
    "alnum": ("^[A-Za-z0-9]+$", _ALNUM, 31),
    "base64": ("^[A-Za-z0-9+/]+$", _ALNUM + "+/", 32),
    "base64url": ("^[A-Za-z0-9_-]+$", _ALNUM + "-_", 32),
}
BANDS = (28, 36, 48, 72, 128)
BINS, FDR, LEAST_P = 50, 0.1, 0.005
#: Steps of a scan and how their reach grows: 8**9 matches or spans a text, more than a string can hold.
_STEPS, _REACH = 9, 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _scan(values: Column, join: Callable[..., Column]) -> Column:
    """The array of all prefixes joined, by steps of growing reach; steps beyond the array's size are skipped.

    `join` takes columns, of which some are null beyond the array's start.
    """

    def step(reach: int) -> Callable[[Column], Column]:
        joined = lambda x: F.transform(x, lambda v, i: join(v, *(F.get(x, i - k * reach) for k in range(1, _REACH))))
        return lambda x: F.when(F.size(x) > reach, joined(x)).otherwise(x)

    for k in range(_STEPS):
        values = _let(values, step(_REACH**k))
    return values


def _sum(*values: Column) -> Column:
    return sum((F.coalesce(v, F.lit(0)) for v in values[1:]), values[0])


def _placed(text: Column, pattern: str, extra: int | None = None) -> Column:
    """array<struct<start, s, g>> of the pattern's matches, leftmost and not overlapping, in code points.

    The pieces that a split leaves between the matches give the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(extra)) if extra is not None else found
    before = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))

    def place(p: Column) -> Column:
        # the gap before each match and the match: their running sum is where it ends
        steps = F.transform(p["m"], lambda s, i: F.get(p["b"], i) + F.length(s))
        return _let(
            _scan(steps, _sum),
            lambda ends: F.transform(p["m"], lambda s, i: F.struct((F.get(ends, i) - F.length(s)).alias("start"), s.alias("s"), F.get(p["g"], i).alias("g"))),
        )

    return _let(F.struct(found.alias("m"), groups.alias("g"), before.alias("b")), place)


def _spans(kind: int, placed: Column) -> Column:
    return F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["s"])).alias("end")))


_SPANS = "array<struct<start:long,kind:int,end:long>>"


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution (Abramowitz and Stegun 7.1.26)."""

    def half(c: Column) -> Column:
        z, t = c["z"], c["t"]
        poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        out = poly * F.exp(-z * z / 2) / 2
        return F.when(z >= 0, out).otherwise(1 - out)

    t = lambda z: 1 / (1 + 0.3275911 * F.abs(z) / math.sqrt(2))
    return _let(_let(z, lambda z: F.struct(z.alias("z"), t(z).alias("t"))), half)


def _by_encoding(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in values.items() for v in kv])


def _encoding(s: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (pattern, _, _) in reversed(ENCODINGS.items()):
        out = F.when(s.rlike(pattern), name).otherwise(out)
    return out


def _tested(token: Column) -> Column:
    """struct<e, b, p>: encoding, length band and combined p-value of a token; nulls if it has no encoding."""
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    alphabets = _by_encoding({e: a for e, (_, a, _) in ENCODINGS.items()})
    cuts = _by_encoding({e: float(c) for e, (_, _, c) in ENCODINGS.items()})

    def first(s: Column) -> Column:
        e = _encoding(s)
        return F.struct(F.when(e == "hex", F.lower(s)).otherwise(s).alias("s"), e.alias("e"))

    def stats(c: Column) -> Column:
        letters = F.split(c["s"], "")
        start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sq"))

        def step(a: Column, ch: Column) -> Column:  # a symbol's k-th standing adds 2k - 1 to the sum of squared counts
            run = F.when(a["last"] == ch, a["run"] + 1).otherwise(F.lit(1.0))
            return F.struct(ch.alias("last"), run.alias("run"), (a["sq"] + 2 * run - 1).alias("sq"))

        squares = F.aggregate(F.array_sort(letters), start, step, lambda a: a["sq"])
        return _let(
            alphabets[c["e"]],
            lambda a: F.struct(
                c["e"].alias("e"), F.length(c["s"]).cast("double").alias("n"), F.length(a).cast("double").alias("k"), cuts[c["e"]].alias("cut"),
                squares.alias("sq"), F.transform(letters, lambda ch: (F.instr(a, ch) - 1).cast("double")).alias("x"),
            ),
        )

    def sums(c: Column) -> Column:
        x, cut = c["x"], c["cut"]
        rest = F.slice(x, F.lit(2), F.size(x))
        high = add(F.transform(x, lambda v: (v >= cut).cast("double")))
        turns = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), rest, lambda u, v: ((u >= cut) != (v >= cut)).cast("double"))
        lag = add(F.zip_with(x, F.concat(rest, F.slice(x, 1, 1)), lambda u, v: u * v))
        return F.struct(
            c["e"].alias("e"), c["n"].alias("n"), c["k"].alias("k"), c["sq"].alias("sq"), high.alias("h"), (add(turns) + 1).alias("r"), lag.alias("l"),
            add(x).alias("s1"), add(F.transform(x, lambda v: v * v)).alias("s2"),
        )

    def combine(c: Column) -> Column:
        n, k, h = c["n"], c["k"], c["h"]
        # the statistic has mean k - 1 and variance 2(k - 1)(n - 1)/n: a gamma distribution of these moments, by its cube root
        scale = (n - 1) / n
        free = (k - 1) / scale
        chi = (k / n * c["sq"] - n) / scale
        spread = 2 / (9 * free)
        p1 = _tail((F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
        both = 2 * h * (n - h)
        spread = F.sqrt(both * (both - n) / (n * n * (n - 1)))
        p2 = F.when(spread > 0, F.least(F.lit(1.0), 2 * _tail(F.greatest(F.abs(c["r"] - both / n - 1) - 0.5, F.lit(0.0)) / spread))).otherwise(0.0)
        base = n * c["s2"] - c["s1"] * c["s1"]
        r = F.when(base > 0, (n * c["l"] - c["s1"] * c["s1"]) / base).otherwise(1.0)
        p3 = 2 * _tail(F.abs((r + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n))
        y = -sum((F.log(F.greatest(p, F.lit(1e-300))) for p in (p1, p2, p3)), F.lit(0.0))
        band = sum((n >= b).cast("int") for b in BANDS)
        p = _let(y, lambda y: F.least(F.lit(1.0), F.exp(-y) * (1 + y + y * y / 2)))
        return F.struct(c["e"].alias("e"), band.alias("b"), p.alias("p"))

    return _let(_let(_let(_let(F.rtrim(token, F.lit("=")), first), stats), sums), combine)


_CANDIDATES = "array<struct<start:long,s:string,t:struct<e:string,b:int,p:double>>>"


def _candidates(text: Column) -> Column:
    tested = F.transform(_placed(text, _TOKEN), lambda x: F.struct(x["start"].alias("start"), x["s"].alias("s"), _tested(x["s"]).alias("t")))
    return F.coalesce(F.when(text.rlike(_TOKEN), tested), F.array().cast(_CANDIDATES))


def thresholds(docs: DataFrame, text_col: str = "text", fdr: float = FDR) -> dict[tuple[str, int], float]:
    """The least p-value kept, by encoding and length band, from counts over all documents."""
    found = docs.select(F.explode_outer(_candidates(F.col(text_col))).alias("c")).where("c.t.e is not null").select("c.t.*")
    bins = found.groupBy("e", "b", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin")).count().collect()
    counts: dict[tuple[str, int], list[int]] = {}
    for r in bins:
        counts.setdefault((r.e, r.b), [0] * BINS)[r.bin] = r["count"]
    out = {}
    for key, n in counts.items():
        random = 2 * sum(n[BINS // 2 :])
        ok = [k for k in range(BINS) if (kept := sum(n[k:])) and 1 - random * (1 - k / BINS) / kept <= fdr]
        out[key] = max(LEAST_P, (ok[0] if ok else BINS - 1) / BINS)
    return out


def scan(docs: DataFrame, text_col: str = "text", *, limits: dict[tuple[str, int], float] | None = None, out: str = "spans") -> DataFrame:
    """`docs` with `out`, array<struct<start, kind, end>> sorted by start, then kind (a place in KINDS), in code points.

    A null text counts as empty and has no spans; repeated rows are judged alike; an empty table gives no rows.  A
    column of `docs` that is already called `out` is replaced.  `limits` are `thresholds()` of the same rows by default.
    """
    limits = thresholds(docs, text_col) if limits is None else limits
    text = F.col(text_col)
    assign = F.filter(_placed(text, ASSIGN, 2), lambda x: F.length(x["g"]) >= 8)
    base = F.concat(_spans(0, assign), _spans(1, _placed(text, ACCESS)), _spans(2, _placed(text, HEX)))
    least = _by_encoding({f"{e}{b}": p for (e, b), p in sorted(limits.items())}) if limits else None
    more = F.array().cast(_SPANS)
    if least is not None:
        kept = F.filter(_candidates(text), lambda x: x["t"]["p"] >= F.coalesce(least[F.concat(x["t"]["e"], x["t"]["b"].cast("string"))], F.lit(1.0)))
        more = _spans(3, kept)
    found = F.concat(F.coalesce(F.when(text.rlike(_ANY), base), F.array().cast(_SPANS)), more)
    return docs.withColumn(out, F.array_sort(found))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span's characters replaced by one mark; overlapping spans share it.  `spans` are sorted."""

    def cut(p: Column) -> Column:
        # in UTF-32 a piece is found by its place alone
        piece = lambda a, b: F.decode(F.substring(p["u"], (4 * a + 1).cast("int"), (4 * (b - a)).cast("int")), "UTF-32")
        reached = lambda i: F.when(i > 0, F.get(p["e"], i - 1)).otherwise(F.lit(0).cast("long"))
        parts = F.transform(
            p["s"], lambda s, i: F.when((i == 0) | (s["start"] >= reached(i)), F.concat(piece(reached(i), s["start"]), F.lit(mark))).otherwise("")
        )
        rest = piece(F.element_at(p["e"], -1), (F.length(p["u"]) / 4).cast("long"))
        return F.concat(F.array_join(parts, ""), rest)

    ends = _scan(F.transform(spans, lambda s: s["end"]), F.greatest)
    clean = _let(F.struct(F.encode(text, "UTF-32").alias("u"), spans.alias("s"), ends.alias("e")), cut)
    return F.when(F.size(spans) > 0, clean).otherwise(text)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return rows.select("doc_id", count(0), count(1), count(2), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


QUERIES = {"op3_secrets": op3_secrets}
ORACLES: dict[str, str] = {}
