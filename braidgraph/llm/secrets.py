"""Secrets in text: fixed forms, and strings that pass a battery of randomness tests.

All of it is column expressions. Fixed forms are regular expressions whose places come
from the lengths of what lies between matches. Other long strings are candidates. Their
encoding is inferred from the characters they use, and three tests ask whether they
could be random in it: an even use of the alphabet, runs above and below its middle, and
serial correlation. Random strings have even p-values, words have p-values near zero.
For every encoding and class of lengths the share of random ones is read off the upper
half of the p-values, and the threshold is the lowest that keeps the expected share of
false discoveries in bounds.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidgraph.plans.lineage import materialize

# The forms of the contract, with the least length of what counts.
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
    r"([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"

# The alphabets of the encodings, in their own order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
GRID = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3)
FALSE_SHARE = 0.1


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _placed(text: Column, pattern: str, kind: str) -> Column:
    """Spans (start, kind, end, match) of all matches; what lies between gives places."""
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap))
    found = _matches(text, pattern)

    def spans(parts: Column) -> Column:
        def span(match: Column, at: Column) -> Column:
            # All that lies before the match: gaps up to it and earlier matches.
            gone = F.aggregate(F.slice(parts["gaps"], F.lit(1), at + 1), F.lit(0), lambda s, x: s + x)
            earlier = F.slice(parts["found"], F.lit(1), at)
            start = gone + F.aggregate(earlier, F.lit(0), lambda s, x: s + F.length(x))
            return F.struct(
                start.cast("int").alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                (start + F.length(match)).cast("int").alias("end"),
                match.alias("match"),
            )

        return F.transform(parts["found"], span)

    # The parts are computed once, not for every match.
    once = F.array(F.struct(gaps.alias("gaps"), found.alias("found")))
    return F.element_at(F.transform(once, spans), 1)


_SPANS = "array<struct<start:int,kind:int,end:int,match:string>>"


def _when(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(_SPANS))


def find_spans(docs: DataFrame) -> DataFrame:
    """Row key, base spans and candidate spans of each document; the text is left behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        text.alias("text"),
    )
    assign = _when(F.col("text").rlike(ASSIGN), _placed(F.col("text"), ASSIGN, "assign"))
    assign = F.filter(
        assign,
        lambda span: F.length(F.regexp_extract(span["match"], ASSIGN, 2)) >= ASSIGN_LEAST,
    )
    access = _when(F.col("text").contains("AKIA"), _placed(F.col("text"), ACCESS, "access"))
    hexes = _when(F.col("text").rlike(HEX), _placed(F.col("text"), HEX, "hex"))
    other = _when(F.col("text").rlike(CANDIDATE), _placed(F.col("text"), CANDIDATE, "random"))
    other = F.filter(
        other,
        lambda span: span["match"].rlike("[0-9]") & span["match"].rlike("[A-Za-z]"),
    )
    found = rows.select(
        "doc_id",
        "text_key",
        assign.alias("assign"),
        access.alias("access"),
        hexes.alias("hex"),
        other.alias("other"),
    )
    base = F.sort_array(F.concat("assign", "access", "hex"))
    return found.select(
        "doc_id",
        "text_key",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        base.alias("base"),
        "other",
    )


def _upper_normal(z: Column) -> Column:
    """The chance that a normal value exceeds ``z``, by a rational approximation."""
    # A published approximation of the error function, good to 1.5e-7.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + p * x)
    poly = F.lit(0.0)
    for factor in reversed(a):
        poly = (poly + factor) * t
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _encoding(token: Column) -> Column:
    core = F.regexp_replace(token, "=+$", "")
    return (
        F.when(core.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(core.rlike("^[A-Z2-7]+$"), F.lit("base32"))
        .when(core.rlike("^[A-Za-z0-9]+$"), F.lit("base62"))
        .otherwise(F.lit("base64"))
    )


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, length class and the combined p-value to rows with ``token``."""
    coded = tokens.withColumn("encoding", _encoding(F.col("token")))
    core = F.regexp_replace("token", "=+$", "")
    lowered = F.when(F.col("encoding") == "hex", F.lower(core)).otherwise(core)
    alphabet, letters = F.lit(""), F.lit(0)
    for name, content in ALPHABETS.items():
        alphabet = F.when(F.col("encoding") == name, F.lit(content)).otherwise(alphabet)
        letters = F.when(F.col("encoding") == name, F.lit(len(content))).otherwise(letters)
    coded = (
        coded.withColumn("core", lowered)
        .withColumn("alphabet", alphabet)
        .withColumn("m", letters.cast("double"))
        .withColumn("codes", F.expr("transform(split(core, ''), c -> cast(locate(c, alphabet) as double))"))
        .withColumn("n", F.size("codes").cast("double"))
    )
    squares = F.aggregate(
        F.array_distinct("codes"),
        F.lit(0.0),
        lambda s, code: s + F.pow(F.size(F.filter("codes", lambda c: c == code)).cast("double"), F.lit(2.0)),
    )
    middle = (F.col("m") + 1) / 2
    mean = F.aggregate("codes", F.lit(0.0), lambda s, c: s + c) / F.col("n")
    coded = coded.withColumns({"squares": squares, "mean": mean})
    heads = F.slice("codes", F.lit(1), F.size("codes") - 1)
    tails = F.slice("codes", F.lit(2), F.size("codes") - 1)
    changes = F.zip_with(heads, tails, lambda a, b: F.when((a > middle) != (b > middle), 1.0).otherwise(0.0))
    products = F.zip_with(heads, tails, lambda a, b: (a - F.col("mean")) * (b - F.col("mean")))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    coded = coded.withColumns(
        {
            "upper": F.size(F.filter("codes", lambda c: c > middle)).cast("double"),
            "runs": total(changes) + 1,
            "lagged": total(products),
            "spread": F.aggregate("codes", F.lit(0.0), lambda s, c: s + F.pow(c - F.col("mean"), F.lit(2.0))),
        }
    )
    n, m = F.col("n"), F.col("m")
    even = (m / n * F.col("squares") - n - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n)
    sides = 2 * F.col("upper") * (n - F.col("upper"))
    runs = F.when(
        (sides > 0) & (sides > n),
        (F.col("runs") - sides / n - 1) / F.sqrt(sides * (sides - n) / (n * n * (n - 1))),
    ).otherwise(F.lit(6.0))
    serial = F.when(
        F.col("spread") > 0, (F.col("lagged") / F.col("spread") + 1 / n) * F.sqrt(n)
    ).otherwise(F.lit(6.0))
    coded = coded.withColumns({"z_even": even, "z_runs": runs, "z_serial": serial})
    # Stouffer's sum, of one upper tail and two double tails.
    chances = [
        _upper_normal(F.col("z_even")),
        2 * _upper_normal(F.abs("z_runs")),
        2 * _upper_normal(F.abs("z_serial")),
    ]
    logs = sum((F.log(F.greatest(p, F.lit(1e-12))) for p in chances), F.lit(0.0))
    # Fisher's combination; the tail of chi-squared with six degrees is a short sum.
    p = F.exp(logs) * (1 - logs + logs * logs / 2)
    return coded.withColumns(
        {"p": p, "class": F.floor(F.log2(n) * 2).cast("int")}
    ).drop("core", "alphabet", "codes", "squares", "mean", "upper", "runs", "lagged", "spread", "m")


def thresholds(tested: DataFrame) -> DataFrame:
    """(encoding, class, least_p): the lowest p that is accepted in each class.

    Random strings are evenly spread, so twice those over one half estimate their
    number, and what an interval holds beyond its share is false. A class without any
    evidence of random strings accepts none.
    """
    counts = [F.sum((F.col("p") >= t).cast("long")).alias(f"n{i}") for i, t in enumerate(GRID)]
    grouped = tested.groupBy("encoding", "class").agg(
        *counts, (2 * F.sum((F.col("p") > 0.5).cast("long"))).alias("random")
    )
    least = F.lit(None).cast("double")
    for i, t in reversed(list(enumerate(GRID))):
        false = 1 - F.least(F.col("random") * (1 - t) / F.greatest(F.col(f"n{i}"), F.lit(1)), F.lit(1.0))
        fits = (F.col("random") > 0) & (false <= FALSE_SHARE)
        least = F.when(fits, F.lit(t)).otherwise(least)
    return grouped.select("encoding", "class", least.alias("least_p"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` its spans: doc_id, text_key, n_assign, n_access, n_hex, base, spans.

    Spans are (start, kind, end, match) in code points, sorted, with ``kind`` a place in
    KINDS; ``base`` has the fixed forms, and ``spans`` adds random strings that touch
    none of them. A null text is empty and has none. Repeated rows have the same spans
    each. An empty table gives no rows. Other columns are ignored. ``text_key`` tells
    rows of one id apart.
    """
    found = materialize(find_spans(docs), "spans")
    free = F.filter(
        "other",
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    # Equal rows give equal candidates; one of each is tested.
    candidates = (
        found.filter(F.size("other") > 0)
        .select("doc_id", "text_key", F.explode(free).alias("span"))
        .distinct()
        .withColumn("token", F.col("span.match"))
    )
    tested = materialize(battery(candidates).select("doc_id", "text_key", "span", "encoding", "class", "p"), "tested")
    accepted = (
        tested.join(thresholds(tested), ["encoding", "class"])
        .filter(F.col("p") >= F.col("least_p"))
        .groupBy(F.col("doc_id").alias("added_id"), F.col("text_key").alias("added_key"))
        .agg(F.collect_list("span").alias("added"))
    )
    joined = found.join(
        accepted,
        F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("text_key") == F.col("added_key")),
        "left",
    )
    spans = F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(_SPANS))))
    return joined.select(
        "doc_id", "text_key", "n_assign", "n_access", "n_hex", "base", spans.alias("spans")
    )


def digest(scanned: DataFrame) -> DataFrame:
    """The spans of ``scan`` as text, and the hash of the fixed ones."""
    return scanned.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """``text`` with every span replaced by ``mask``; overlapping spans are one."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    rest = F.aggregate(
        spans,
        empty,
        lambda done, s: F.struct(
            F.when(
                s["start"] >= done["at"],
                F.concat(done["out"], text.substr(done["at"] + 1, s["start"] - done["at"]), F.lit(mask)),
            )
            .otherwise(done["out"])
            .alias("out"),
            F.greatest(done["at"], s["end"]).alias("at"),
        ),
        lambda done: F.concat(done["out"], text.substr(done["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, rest).otherwise(text)
