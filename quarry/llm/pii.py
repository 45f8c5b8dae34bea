"""Personal data: base patterns, then bootstrapped contextual extraction, in DataFrame functions only.

The base patterns find e-mail addresses, IP addresses, card numbers and phone numbers with their code point offsets. They
and key-like strings (long, of letters and digits) are the seeds. The words around a trusted value are lexical patterns;
other tokens with digits in the same contexts are candidates. Patterns and values form a bipartite graph that is scored in
rounds: a pattern by the trusted among its values and by how far the others agree in shape, a value by its good patterns.
Values that reach the confidence are trusted from the next round on and induce patterns of their own, until none is new.

Texts stay where they are: what leaves a row are its found spans with a few words of context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.scratch import materialize

_LOCAL = "A-Za-z0-9._%+-"
#: kind -> expression. Runs are possessive and start only where a run starts or the last match ended, so that each text is
#: read in one pass; the matches are those of the plain expressions.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]|[0-9])?"
_SPACE = r"\x20\x09-\x0D"
#: A base match or else a blank-separated token with a digit.
_ANY = "|".join([*(f"(?:{p})" for p in (BASE["email"], BASE["ip"], BASE["phone"], BASE["card"])), rf"(?:(?<![^{_SPACE}])[^{_SPACE}0-9]*+[0-9][^{_SPACE}]*+)"])
KINDS = ["email", "ip", "card", "phone", "learned"]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    return (
        F.aggregate(
            F.sequence(F.lit(1), n),
            F.lit(0),
            lambda s, k: s + F.element_at(F.array(*[F.lit(v) for v in [*range(10), 0, 2, 4, 6, 8, 1, 3, 5, 7, 9]]), F.substr(digits, k, F.lit(1)).cast("int") + 1 + F.when((n - k) % 2 == 1, 10).otherwise(0)),
        )
        % 10
        == 0
    )


def _valid(kind: str, x: Column) -> Column:
    d = _digits(x)
    if kind == "ip":
        return F.regexp_like(x, F.lit(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"))
    if kind == "card":
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(d).between(8, 15)
    return F.lit(True)


def _running(steps: Column) -> Column:
    """Running sums of an int array, in pieces of 256 so that long arrays are not copied once for every element."""

    def sums(xs: Column, start: Column) -> Column:
        empty = F.expr("CAST(array() AS ARRAY<INT>)")
        return F.aggregate(
            xs, F.struct(start.alias("t"), empty.alias("out")), lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["out"], F.array(s["t"] + x)).alias("out")), lambda s: s["out"]
        )

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / 256).cast("int")), lambda c: F.slice(steps, c * 256 + 1, F.lit(256)))
    totals = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x))
    starts = F.concat(F.array(F.lit(0)), sums(totals, F.lit(0)))
    return F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), F.slice(starts, 1, F.size(pieces)).alias("s")), lambda z: sums(z["p"], z["s"])))


def _plain(piece: Column) -> Column:
    """Words with one blank between them."""
    return F.trim(F.regexp_replace(piece, rf"[{_SPACE}]+", " "))


def _spans(text: Column, expression: str, needs: Column) -> Column:
    """Array of (start, end, value, left, right) of the matches, left to right, with the last two words before and the first
    word after, up to the neighbouring matches; empty where ``needs`` is not true."""
    pieces, found = F.split(text, expression, -1), F.regexp_extract_all(text, F.lit(f"({expression})"), F.lit(1))
    parts = F.struct(pieces.alias("pieces"), found.alias("found"))

    def place(p: Column) -> Column:
        n = F.size(p["found"])
        steps = F.transform(F.sequence(F.lit(1), n), lambda k: F.length(F.element_at(p["pieces"], k)) + F.when(k > 1, F.length(F.get(p["found"], k - 2))).otherwise(0))
        return F.transform(
            F.arrays_zip(_running(steps).alias("start"), p["found"].alias("value"), F.sequence(F.lit(1), n).alias("k")),
            lambda z: F.struct(
                z["start"].alias("start"),
                (z["start"] + F.length(z["value"])).alias("end"),
                z["value"].alias("value"),
                F.substring_index(_plain(F.element_at(p["pieces"], z["k"])), " ", -2).alias("left"),
                F.substring_index(_plain(F.element_at(p["pieces"], z["k"] + 1)), " ", 1).alias("right"),
            ),
        )

    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, value: STRING, left: STRING, right: STRING>>)")
    placed = F.transform(F.array(parts), lambda p: F.when(F.size(p["found"]) > 0, place(p)).otherwise(none))[0]
    return F.when(needs, placed).otherwise(none)


def base_spans(text: str | Column) -> dict[str, Column]:
    """Kind -> array of valid base spans, each (start, end, value, left, right); offsets in code points, end exclusive."""
    text = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    digit = F.regexp_like(text, F.lit("[0-9]"))
    needs = {"email": F.contains(text, F.lit("@")), "ip": digit & F.contains(text, F.lit(".")), "card": digit, "phone": digit & F.contains(text, F.lit("+"))}

    def valid(kind: str):
        return lambda z: _valid(kind, z["value"])

    return {kind: F.filter(_spans(text, expression, needs[kind]), valid(kind)) for kind, expression in BASE.items()}


def _candidates(text: str | Column) -> Column:
    """Tokens with at least five digits, or with letters and digits mixed, that hold no valid base match: (start, end, value,
    left, right, key), without what stands around their letters and digits; ``key``: at least 20 characters of a key's
    alphabet with five letters and five digits."""
    text = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    base = lambda v: F.regexp_like(v, F.lit(BASE["email"])) | F.regexp_like(v, F.lit(BASE["ip"])) | _valid("card", v) | F.regexp_like(v, F.lit(r"\+[0-9]"))
    lead = lambda v: F.length(F.regexp_extract(v, r"^[^\p{L}\p{N}]+", 0))
    bare = lambda v: F.regexp_replace(v, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    key = lambda v: F.regexp_like(v, F.lit(r"^(?=(?:[^0-9]*[0-9]){5})(?=(?:[^A-Za-z]*[A-Za-z]){5})[A-Za-z0-9_+/=-]{20,}$"))
    found = F.filter(_spans(text, _ANY, F.regexp_like(text, F.lit("[0-9]"))), lambda z: ~base(z["value"]))
    cut = F.transform(
        found,
        lambda z: F.struct(
            (z["start"] + lead(z["value"])).alias("start"),
            (z["start"] + lead(z["value"]) + F.length(bare(z["value"]))).alias("end"),
            bare(z["value"]).alias("value"),
            z["left"].alias("left"),
            z["right"].alias("right"),
            key(bare(z["value"])).alias("key"),
        ),
    )
    return F.filter(cut, lambda z: (F.length(_digits(z["value"])) >= 5) | F.regexp_like(z["value"], F.lit(r"\p{L}")))


def _apart(candidates: str, spans: list[str]) -> Column:
    """The candidates that share no place with any of the spans."""
    return F.filter(candidates, lambda z: ~F.exists(F.concat(*spans), lambda b: (z["start"] < b["end"]) & (z["end"] > b["start"])))


def _patterns(left: str, right: str) -> Column:
    """Lexical patterns of an occurrence: the two words before it, and the words on either side."""
    left, r1 = F.lower(left), F.lower(right)
    two = F.when(F.contains(left, F.lit(" ")), F.concat(F.lit("L "), left))
    around = F.when((left != "") & (r1 != ""), F.concat(F.lit("C "), F.substring_index(left, " ", -1), F.lit(" _ "), r1))
    return F.array_compact(F.array(two, around))


def _shape(value: Column) -> Column:
    """Runs of letters and of digits shortened to one sign each."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), r"\p{N}+", "9")


def learn(rows: DataFrame, rounds: int = 5, support: int = 3, confidence: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(patterns: pattern, conf; values: value) of high confidence from ``rows`` with the arrays ``seeds`` and ``candidates``.

    Trusted at first are the seeds and the key-like candidates. In each round a pattern with at least ``support`` different
    trusted values gets as confidence the mean over its different values of 1 for a trusted one and, for another, the share
    of the pattern's values that have its shape. A value's score is one minus the product of (1 - confidence) over its
    patterns of at least ``confidence``; values that reach ``confidence`` are trusted in the next round. The values are the
    trusted ones in the end; seeds of the base patterns are among them.
    """
    parts = [rows.select(F.explode(c).alias("o")).select("o.value", "o.left", "o.right", seed.alias("seed")) for c, seed in (("seeds", F.lit(True)), ("candidates", F.col("o.key")))]
    every = parts[0].unionByName(parts[1]).select("value", "seed", F.explode_outer(_patterns("left", "right")).alias("pattern"))
    edges = materialize(every.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    trusted = materialize(edges.where("seed").select("value").distinct(), "trusted")
    edges = edges.where("pattern IS NOT NULL").select("pattern", "value")
    patterns = edges.sparkSession.createDataFrame([], "pattern string, conf double")
    for _ in range(rounds):
        held = edges.join(trusted.withColumn("sure", F.lit(1)), "value", "left")
        held = materialize(held.select("pattern", "value", F.coalesce("sure", F.lit(0)).alias("sure")), "held")
        alike = held.groupBy("pattern", _shape(F.col("value")).alias("shape")).agg(F.count("*").alias("n"), F.sum("sure").alias("t"))
        summed = alike.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum((F.col("n") - F.col("t")) * F.col("n")).alias("u"))
        conf = F.col("t") / F.col("n") + F.col("u") / F.col("n") / F.col("n")
        patterns = summed.where(F.col("t") >= support).select("pattern", conf.alias("conf")).where(F.col("conf") >= confidence)
        patterns = materialize(patterns, "patterns")
        raised = held.where("sure = 0").join(patterns, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-9)))))).alias("score"))
        new = materialize(raised.where(F.col("score") >= confidence).select("value"), "new")
        if new.isEmpty():
            break
        trusted = materialize(trusted.unionByName(new), "trusted")
    return patterns, trusted


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 5, support: int = 3, confidence: float = 0.7) -> DataFrame:
    """One row per input row: the id, and for each of KINDS an array of (start, end) in code points, ascending; ``learned``
    are the spans the method adds, ``discovered`` those of them that only patterns have found, without the key-like seeds.

    Base matches are leftmost and do not overlap within a kind; those failing their test (IP parts, Luhn, digit counts) are
    dropped. Learned are all places of trusted values (see ``learn``); such a span touches no valid e-mail, IP, card or
    phone match. Null and empty texts have no spans; texts of any length are read whole; null and repeated ids keep their rows; an
    empty table gives an empty result; other columns are not read.
    """
    kinds = base_spans("_text")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumns(kinds)
    spans = {k: F.transform(k, lambda z: F.struct(z["start"].alias("start"), z["end"].alias("end"))).alias(k) for k in BASE}
    held = rows.select(F.monotonically_increasing_id().alias("row"), "_id", *spans.values(), F.concat(*BASE).alias("seeds"), _candidates("_text").alias("candidates"))
    held = materialize(held.withColumn("candidates", _apart("candidates", list(BASE))), "spans")
    _, trusted = learn(held, rounds, support, confidence)
    tried = held.select("row", F.explode("candidates").alias("o")).select("row", "o.start", "o.end", "o.value", "o.key")
    learned = tried.join(trusted, "value", "left_semi").groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("learned"), F.sort_array(F.collect_set(F.when(~F.col("key"), F.struct("start", "end")))).alias("discovered")
    )
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>)")
    return held.join(learned, "row", "left").select(F.col("_id").alias(id_col), *BASE, F.coalesce("learned", empty).alias("learned"), F.coalesce("discovered", empty).alias("discovered"))


def digest(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans of the kinds, comma-joined."""

    def said(kind: str):
        return lambda z: F.concat_ws(":", F.lit(kind), z["start"].cast("string"), z["end"].cast("string"))

    return F.array_join(F.concat(*[F.transform(k, said(k)) for k in kinds]), ",")
