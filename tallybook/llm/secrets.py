"""Secret scan: fixed patterns and a randomness test battery, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import materialize

# The patterns of the three base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # runs are taken whole, so this equals runs of [0-9a-f] that have 16 characters
KINDS = ["assign", "access", "hex", "random"]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# name, test of a token, alphabet; the first that holds is the inferred encoding
ENCODINGS = [
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
LENGTHS = [28, 40, 64]  # bounds of the length classes
BINS = 20
FALSE_SHARE = 0.1
# The runs and the serial test look at the same order; for even values their scores correlate at 0.75. So the joint statistic, minus twice the
# sum of three logarithms, has mean 6 and variance 12 plus 2 * 4 * 0.75 ** 2, as JOINT_SCALE times a chi-squared of JOINT_FREE degrees has.
JOINT_SCALE, JOINT_FREE = 16.5 / 12, 72 / 16.5
SPAN = "array<struct<start:bigint,kind:int,end:bigint,found:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern, leftmost and not overlapping, with places in code points.

    The pieces between matches come from splitting at the same pattern, so lengths add up to places. They are
    added up in chunks, as many as a chunk has matches, and the chunks are then moved to their places, so that
    no array is copied for each of very many matches.
    """
    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("found")))
        more = F.when(x["hit"].isNull(), acc["spans"]).when(acc["spans"].isNull(), one).otherwise(F.concat(acc["spans"], one))
        return F.struct(end.alias("at"), more.alias("spans"))

    def move(acc: Column, x: Column) -> Column:
        """The chunk behind those before it: its place and its spans, as the text's first character counts them."""
        one = F.array(F.struct(acc["at"].alias("at"), F.coalesce(x["spans"], none).alias("spans")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["chunks"], one).alias("chunks"))

    def shifted(chunk: Column) -> Column:
        moved = lambda c: (c + chunk["at"])
        return F.transform(chunk["spans"], lambda s: F.struct(moved(s["start"]).alias("start"), s["kind"].alias("kind"), moved(s["end"]).alias("end"), s["found"].alias("found")))

    def summed(pairs: Column) -> Column:
        each = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / each).cast("int")), lambda i: F.slice(pairs, i * each + 1, each))
        local = F.transform(chunks, lambda chunk: F.aggregate(chunk, start, step))
        nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<struct<at:bigint,spans:{SPAN}>>").alias("chunks"))
        return F.flatten(F.transform(F.aggregate(local, nothing, move)["chunks"], shifted))

    def placed(found: Column) -> Column:
        return F.when(F.size(found) > 0, _let(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit")), summed))

    return F.coalesce(_let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed), none)


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """Spans of the kinds assign, access and hex."""
    assign = F.filter(_spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 12)
    access = F.filter(_spans(text, ACCESS, 1), lambda s: F.length(s["found"]) >= 18)
    return assign, access, _spans(text, HEX, 2)


def _upper(z: Column) -> Column:
    """Upper tail of the normal distribution, to about four digits."""
    return 1 / (1 + F.exp(F.least(F.lit(600.0), F.greatest(F.lit(-600.0), 1.5976 * z + 0.07056 * z * z * z))))


def _chi_tail(x: Column, free: Column) -> Column:
    """Upper tail of the chi-squared distribution, whose cube root is nearly normal."""
    spread = F.lit(2.0) / (F.lit(9.0) * free)
    return _upper((F.pow(F.greatest(F.lit(0.0), x) / free, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))


def battery(places: Column, squares: Column, alphabet: Column) -> Column:
    """Chance that a random token looks at least as uneven as this one, of ``places`` in an alphabet of that size.

    Three tests: chi-squared of the character counts, whose ``squares`` are added up, against uniform ones, runs above and
    below the middle of the alphabet, and lag-one serial correlation. The sum of the counts' squares has the moments of a
    multinomial draw, whatever the length. Fisher's method joins the chances, corrected for the two tests of order being related.
    """
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    # every element but the last with the next one
    steps = lambda a, f: total(F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), f))
    log = lambda p: F.log(F.greatest(F.lit(1e-300), F.least(F.lit(1.0), p)))

    def basics(x: Column) -> Column:
        values, k = x["values"], x["k"]
        return F.struct(
            values.alias("values"), k.alias("k"), F.size(values).cast("double").alias("n"), F.transform(values, lambda v: (v >= k / 2).cast("double")).alias("bits"),
            x["squares"].alias("squares"), (total(values) / F.size(values)).alias("middle"),
        )

    def sums(x: Column) -> Column:
        values, middle = x["values"], x["middle"]
        return F.struct(
            x["n"].alias("n"), x["k"].alias("k"), x["squares"].alias("squares"), total(x["bits"]).alias("ones"),
            (steps(x["bits"], lambda a, b: (a != b).cast("double")) + 1).alias("turns"),
            total(F.transform(values, lambda v: (v - middle) * (v - middle))).alias("power"), steps(values, lambda a, b: (a - middle) * (b - middle)).alias("lag"),
        )

    def scores(x: Column) -> Column:
        n, k = x["n"], x["k"]
        mean = 2 * x["ones"] * (n - x["ones"]) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        return F.struct(
            # with mean k - 1 and variance 2 (k - 1) (n - 1) / n, as (n - 1) / n times a chi-squared
            _chi_tail((k * x["squares"] / n - n) * n / (n - 1), (k - 1) * n / (n - 1)).alias("chi"),
            F.when(spread > 0, F.abs(x["turns"] - mean) / F.sqrt(spread)).otherwise(8.0).alias("runs"),
            F.when(x["power"] > 0, F.abs(x["lag"] / x["power"] + 1 / n) * F.sqrt(n)).otherwise(8.0).alias("serial"),
        )

    start = F.struct(places.alias("values"), squares.alias("squares"), alphabet.alias("k"))
    logs = _let(_let(_let(start, basics), sums), lambda x: _let(scores(x), lambda z: log(z["chi"]) + log(2 * _upper(z["runs"])) + log(2 * _upper(z["serial"]))))
    return _chi_tail(-2 * logs / JOINT_SCALE, F.lit(JOINT_FREE))


def _candidates(text: Column) -> Column:
    """Tokens that hold a letter and a digit, with their stratum (encoding and length class) and chance."""
    tokens = F.filter(_spans(text, CANDIDATE, 3), lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]"))

    def kind(s: Column) -> Column:
        encoding = reduce(lambda rest, i: F.when(s["found"].rlike(ENCODINGS[i][1]), F.lit(i)).otherwise(rest), reversed(range(len(ENCODINGS))), F.lit(None).cast("int"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_replace(s["found"], "=+$", "").alias("plain"), encoding.alias("encoding"))

    def rated(s: Column) -> Column:
        length_class = sum(((F.length(s["plain"]) >= bound).cast("int") for bound in LENGTHS), F.lit(0))

        def chance(alphabet: Column) -> Column:
            characters = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
            places = F.transform(characters(s["plain"]), lambda c: (F.position(c, alphabet) - 1).cast("double"))
            # a count for each character of the alphabet, so that the work is linear in the token
            held = lambda c: (F.length(s["plain"]) - F.length(F.replace(s["plain"], c, F.lit("")))).cast("double")
            squares = F.aggregate(characters(alphabet), F.lit(0.0), lambda acc, c: acc + F.pow(held(c), F.lit(2.0)))
            return battery(places, squares, F.length(alphabet).cast("double"))

        alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), (s["encoding"] * (len(LENGTHS) + 1) + length_class).alias("stratum"),
            _let(F.element_at(alphabets, s["encoding"] + 1), chance).alias("chance"),
        )

    return F.transform(F.filter(F.transform(tokens, kind), lambda c: c["encoding"].isNotNull()), rated)


def even_part(bins: list[int]) -> float:
    """How many of the tokens counted by bins of chances have even chances.

    The upper half of the bins is even. It grows downwards bin by bin, until one holds more than its mean by two
    standard errors, as where the pile at 0 begins.
    """
    flat = BINS // 2
    while flat:
        beyond = sum(bins[flat:])
        mean = beyond / (BINS - flat)
        if bins[flat - 1] > mean + 2 * math.sqrt(mean + mean * mean / max(1, beyond)):
            break
        flat -= 1
    return sum(bins[flat:]) * BINS / (BINS - flat)


def thresholds(scanned: DataFrame) -> dict[int, int]:
    """For each stratum the least bin of chances that is flagged.

    Random tokens have even chances, others pile up at 0. So the even part of a stratum estimates
    its random tokens, and among the tokens from a bin up the share beyond the random ones
    expected there estimates the false discoveries. The least bin that
    keeps it within ``FALSE_SHARE`` is taken. Strata times bins bound what comes to the driver.
    """
    rated = scanned.select(F.explode("candidates").alias("c")).select("c.stratum", F.least(F.lit(BINS - 1), F.floor(F.col("c.chance") * BINS)).cast("int").alias("bin"))
    counts: dict[int, list[int]] = {}
    for row in rated.groupBy("stratum", "bin").count().collect():
        counts.setdefault(row["stratum"], [0] * BINS)[row["bin"]] = row["count"]
    out = {}
    for stratum, bins in counts.items():
        random = min(sum(bins), even_part(bins))
        above = {b: sum(bins[b:]) for b in range(BINS)}
        fit = [b for b in range(BINS) if above[b] and 1 - random * (BINS - b) / BINS / above[b] <= FALSE_SHARE]
        if fit:
            out[stratum] = min(fit)
    return out


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``assign``, ``access``, ``hex`` and ``random``: arrays of (start, kind, end).

    Places are code points, ends exclusive. Base kinds are the fixed patterns. Random spans are
    tokens that look random for their encoding and length and overlap no base span. Null
    texts are empty. ``docs`` may have no columns of these names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign, access, hexes = base_spans(text)
    place = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return docs.withColumns({"assign": place(assign), "access": place(access), "hex": place(hexes), "candidates": _candidates(text)})


def flagged(scanned: DataFrame) -> DataFrame:
    """Replace the ``candidates`` of a materialized scan by the ``random`` spans."""
    least = thresholds(scanned)
    base = F.concat("assign", "access", "hex")

    def random(c: Column) -> Column:
        from_bin = reduce(lambda rest, s: F.when(c["stratum"] == s, F.lit(least[s])).otherwise(rest), sorted(least), F.lit(BINS))
        free = ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return (F.floor(c["chance"] * BINS) >= from_bin) & free

    spans = F.transform(F.filter("candidates", random), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.withColumn("random", spans).drop("candidates")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``.

    Rows without spans, as those of null or empty text, have counts 0 and an empty ``spans``. Repeated rows are
    scanned each. Other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = flagged(materialize(scan(narrow).drop("text"), "scan"))
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    base = F.concat("assign", "access", "hex")
    return found.select(
        F.col("doc_id").alias(id_col), count("assign"), count("access"), count("hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.concat(base, "random")).alias("spans"),
    )


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "<secret>") -> DataFrame:
    """The rows of ``docs`` with every span, or run of overlapping spans, replaced by ``mask``.

    Null texts stay null; rows without spans stay as they are.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(text_col).alias("text"))
    found = flagged(materialize(scan(packed), "scan"))
    found = found.withColumn("spans", F.array_sort(F.concat("assign", "access", "hex", "random")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], gap, F.lit(mask)).alias("out"), s["end"].alias("at"))).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        )

    tail = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    text = F.when(F.col("text").isNotNull(), _let(F.col("spans"), lambda a: F.when(F.size(a) > 0, F.aggregate(a, start, cut, tail)).otherwise(F.col("text"))))
    return found.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names])
