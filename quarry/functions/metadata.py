"""Typed metadata of a text: conditions with units, ratios, names, each with confidence and the span that proves it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ontology import DOMAIN, Ontology, tag_gas_agents, tag_stage, tag_targets
from quarry.functions.text import evidence_snippet

N = r"([0-9]+(?:\.[0-9]+)?)"
_TO = r"\s*(?:[-~～]|to|and)\s*"

#: Name -> (expression, group of the value).
PATTERNS = {
    "k2": (rf"(?i){N}{_TO}{N}\s*K\b", 1),
    "k1": (rf"(?i)(?:T\s*=?\s*)?{N}\s*K\b", 1),
    "c2": (rf"(?i){N}{_TO}{N}\s*°?\s*C\b", 1),
    "c1": (rf"(?i)(?:T\s*=?\s*)?{N}\s*°?\s*C\b", 1),
    "mpa2": (rf"(?i){N}{_TO}{N}\s*MPa\b", 1),
    "mpa1": (rf"(?i)(?:P\s*=?\s*)?{N}\s*MPa\b", 1),
    "bar": (rf"(?i)(?:P\s*=?\s*)?{N}\s*bar\b", 1),
    "atm": (rf"(?i)(?:P\s*=?\s*)?{N}\s*atm\b", 1),
    "coal_cn": (r"(煤种|煤)\s*[:：]\s*([^\n，。;；]+)", 2),
    "coal_en": (r"(?i)\bcoal\b\s*[:\-]?\s*([A-Za-z0-9\-\s]{2,80})", 1),
    "sc": (rf"(?i)\bS\s*/\s*C\b\s*=?\s*{N}", 1),
    "steam_c": (rf"(?i)(steam[-\s]?to[-\s]?carbon)\s*=?\s*{N}", 2),
    "er": (rf"(?i)\bER\b\s*=?\s*{N}", 1),
    "eq": (rf"(?i)(equivalence\s*ratio)\s*=?\s*{N}", 2),
    "oc": (rf"(?i)\bO\s*/\s*C\b\s*=?\s*{N}", 1),
    "o2c": (rf"(?i)\bO2\s*/\s*C\b\s*=?\s*{N}", 1),
    "h2o_o2": (rf"(?i)(?:H2O|steam)\s*/\s*O2\s*=?\s*{N}", 1),
}
#: Ratio -> ((pattern, confidence), the later one decides).
RATIOS = {"S/C": (("sc", 0.88), ("steam_c", 0.85)), "ER": (("er", 0.88), ("eq", 0.85)), "O/C": (("oc", 0.85),), "O2/C": (("o2c", 0.83),), "H2O/O2": (("h2o_o2", 0.80),)}

EVIDENCE = "STRUCT<field: STRING, lo: DOUBLE, hi: DOUBLE, confidence: DOUBLE, start: INT, end: INT, evidence_text: STRING>"


def _found(name: str) -> Column:
    return F.col(f"_m_{name}") != ""


def _value(name: str, group: int = 1) -> Column:
    """A number of the match: the only one, or the first or second of a range."""
    return F.col(f"_v{group}_{name}")


def _proof(text: Column, name: str, field: str, lo: Column, hi: Column, confidence: float) -> Column:
    start = F.regexp_instr(text, F.lit(PATTERNS[name][0])) - 1
    end = start + F.length(f"_m_{name}")
    return F.when(
        _found(name),
        F.struct(
            F.lit(field).alias("field"), lo.alias("lo"), hi.alias("hi"), F.lit(confidence).alias("confidence"), start.alias("start"), end.alias("end"),
            evidence_snippet(text, start, end).alias("evidence_text"),
        ).cast(EVIDENCE),
    )


#: A piece of the lower-cased text without which a pattern cannot match, and the patterns that decide whether it is needed
#: at all: a range has a single value in it, and lower units are read only where the higher ones are missing.
_NEEDS = {
    "k1": "k", "k2": "k", "c1": "c", "c2": "c", "mpa1": "mpa", "mpa2": "mpa", "bar": "bar", "atm": "atm", "coal_cn": "煤", "coal_en": "coal", "sc": "/",
    "steam_c": "carbon", "er": "er", "eq": "ratio", "oc": "/", "o2c": "o2", "h2o_o2": "o2",
}
_AFTER = {"k2": (("k1",), ()), "c1": ((), ("k1",)), "c2": (("c1",), ("k1",)), "mpa2": (("mpa1",), ()), "bar": ((), ("mpa1",)), "atm": ((), ("mpa1", "bar")), "coal_en": ((), ("coal_cn",))}


_NAMES, _RANGES = ("coal_cn", "coal_en"), ("k2", "c2", "mpa2")


def _groups(name: str) -> list[int]:
    return [] if name in _NAMES else [1, 2] if name in _RANGES else [PATTERNS[name][1]]


def _made(names) -> list[str]:
    """The columns that ``_matches`` adds."""
    return ["_low", *[f"_m_{n}" for n in names], *[f"_v{i}_{n}" for n in names for i, _ in enumerate(_groups(n), 1)]]


def _matches(df: DataFrame, text: Column, names) -> DataFrame:
    """``df`` with the first match of each pattern, empty without one, and its numbers, read once from the matched piece alone;
    expensive patterns run on the few rows that need them."""
    out, left = df.withColumn("_low", F.lower(text)), list(names)
    while left:
        now = [n for n in left if not {x for pair in _AFTER.get(n, ()) for x in pair} & set(left)]
        new = {}
        for n in now:
            found, missing = _AFTER.get(n, ((), ()))
            wanted = F.contains("_low", F.lit(_NEEDS[n]))
            for x in found:
                wanted = wanted & (F.col(f"_m_{x}") != "")
            for x in missing:
                wanted = wanted & (F.col(f"_m_{x}") == "")
            new[f"_m_{n}"] = F.when(wanted, F.regexp_extract(text, PATTERNS[n][0], 0)).otherwise("")
        out, left = out.withColumns(new), [n for n in left if n not in now]
    return out.withColumns({f"_v{i}_{n}": F.when(_found(n), F.regexp_extract(f"_m_{n}", PATTERNS[n][0], g).cast("double")) for n in names for i, g in enumerate(_groups(n), 1)})


def _condition(text: Column, field: str, unit: str, steps) -> dict[str, Column]:
    """point, min, max and evidence from the first step that is found. A step is (range pattern or null, single
    pattern, conversion, confidence, field of the evidence)."""
    point, low, high, proof = (F.lit(None).cast(t) for t in ("double", "double", "double", EVIDENCE))
    for ranged, single, convert, confidence, proved in reversed(steps):
        if single:
            v = convert(_value(single))
            hit = _found(single)
            point, low, high = F.when(hit, v).otherwise(point), F.when(hit, F.lit(None)).otherwise(low), F.when(hit, F.lit(None)).otherwise(high)
            proof = F.when(hit, _proof(text, single, proved, v, v, confidence)).otherwise(proof)
        if ranged:
            a, b = _value(ranged, 1), _value(ranged, 2)
            lo, hi = convert(F.least(a, b)), convert(F.greatest(a, b))
            hit = _found(ranged)
            point, low, high = F.when(hit, (lo + hi) / 2).otherwise(point), F.when(hit, lo).otherwise(low), F.when(hit, hi).otherwise(high)
            proof = F.when(hit, _proof(text, ranged, proved, lo, hi, confidence)).otherwise(proof)
    return {"point": point, "min": low, "max": high, "evidence": proof}


def _struct(parts: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def _same(x: Column) -> Column:
    return x


def _temperature(text: Column) -> dict[str, Column]:
    return _condition(text, "T", "K", [("k2", "k1", _same, 0.90, "T_range_K"), ("c2", "c1", lambda x: x + 273.15, 0.88, "T_range_K")])


def _pressure(text: Column) -> dict[str, Column]:
    steps = [("mpa2", "mpa1", _same, 0.90, "P_range_MPa"), (None, "bar", lambda x: x * 0.1, 0.88, "P_MPa"), (None, "atm", lambda x: x * 0.101325, 0.85, "P_MPa")]
    return _condition(text, "P", "MPa", steps)


def _coal_name(text: Column) -> tuple[Column, Column]:
    cn = F.trim(F.regexp_extract("_m_coal_cn", PATTERNS["coal_cn"][0], 2))
    en = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_extract("_m_coal_en", PATTERNS["coal_en"][0], 1), r"^\s+|\s+$", ""), 1, 60), r"^\s+|\s+$", "")
    none = F.lit(None).cast("double")
    proof = F.coalesce(_proof(text, "coal_cn", "coal_name", none, none, 0.85), _proof(text, "coal_en", "coal_name", none, none, 0.70))
    return F.nullif(F.when(_found("coal_cn"), cn).when(_found("coal_en"), en), F.lit("")), proof


def _ratios(text: Column) -> tuple[Column, list[Column]]:
    values, proofs = [], []
    for key, ways in RATIOS.items():
        value, proof = F.lit(None).cast("double"), F.lit(None).cast(EVIDENCE)
        for name, confidence in ways:
            v = _value(name)
            value, proof = F.when(_found(name), v).otherwise(value), F.when(_found(name), _proof(text, name, f"ratios.{key}", v, v, confidence)).otherwise(proof)
        values += [F.lit(key), value]
        proofs.append(proof)
    held = F.map_filter(F.create_map(*values), lambda _, v: v.isNotNull())
    return F.when(F.size(held) > 0, held), proofs


def extract_temperature(df: DataFrame, text_col: str = "text", out: str = "temperature") -> DataFrame:
    """``df`` plus a struct of point, min, max (kelvin) and evidence: K before °C, a range before a single value."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = ["k2", "k1", "c2", "c1"]
    return _matches(df, text, names).withColumn(out, _struct(_temperature(text))).drop(*_made(names))


def extract_pressure(df: DataFrame, text_col: str = "text", out: str = "pressure") -> DataFrame:
    """``df`` plus a struct of point, min, max (MPa) and evidence: MPa, then bar, then atm."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = ["mpa2", "mpa1", "bar", "atm"]
    return _matches(df, text, names).withColumn(out, _struct(_pressure(text))).drop(*_made(names))


def extract_ratios(df: DataFrame, text_col: str = "text", out: str = "ratios") -> DataFrame:
    """``df`` plus a map of the ratios that are stated, null without any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [n for ways in RATIOS.values() for n, _ in ways]
    return _matches(df, text, names).withColumn(out, _ratios(text)[0]).drop(*_made(names))


def extract_coal_name(df: DataFrame, text_col: str = "text", out: str = "coal_name") -> DataFrame:
    """``df`` plus the name that follows the label, null without one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = ["coal_cn", "coal_en"]
    return _matches(df, text, names).withColumn(out, _coal_name(text)[0]).drop(*_made(names))


def extract_metadata(df: DataFrame, text_col: str = "text", onto: Ontology = DOMAIN) -> DataFrame:
    """``df`` plus stage, gas_agent, targets, T_K, T_min_K, T_max_K, P_MPa, P_min_MPa, P_max_MPa, coal_name, ratios,
    meta_confidence (map) and meta_evidence (array), in one pass without a shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.col("_low")
    name, name_proof = _coal_name(text)
    ratios, ratio_proofs = _ratios(text)
    t, p = _temperature(text), _pressure(text)
    # every part is a column of its own, so a reader of the numbers alone does not pay for their proofs
    numbers = {"T_K": t["point"], "T_min_K": t["min"], "T_max_K": t["max"], "P_MPa": p["point"], "P_min_MPa": p["min"], "P_max_MPa": p["max"]}
    out = _matches(df, text, PATTERNS).withColumns(
        {"stage": tag_stage(text, onto, low), "gas_agent": tag_gas_agents(text, onto, low), "targets": tag_targets(text, onto, low), "coal_name": name, "ratios": ratios, **numbers}
    )
    any_of = lambda *names: F.concat(*[f"_m_{n}" for n in names]) != ""  # noqa: E731  the matches are short, the values are not
    t_range, p_range = any_of("k2") | (~any_of("k1") & any_of("c2")), any_of("mpa2")
    sure = {
        "stage": F.when(F.col("stage") != "unknown", 0.70).otherwise(0.30),
        "gas_agent": F.when(F.col("gas_agent").isNotNull(), 0.70),
        "targets": F.when(F.col("targets").isNotNull(), 0.75),
        "T_range_K": F.when(t_range, 0.90),
        "T_K": F.when(t_range, 0.85).when(any_of("k1", "c1"), 0.90),
        "P_range_MPa": F.when(p_range, 0.90),
        "P_MPa": F.when(p_range, 0.85).when(any_of("mpa1", "bar", "atm"), 0.88),
        "coal_name": F.when(F.col("coal_name").isNotNull(), 0.80),
        "ratios": F.when(any_of(*[n for ways in RATIOS.values() for n, _ in ways]), 0.82),
    }
    entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("double").alias("value"))) for k, v in sure.items()]))
    confidence = F.map_from_entries(entries)
    evidence = F.array_compact(F.array(t["evidence"], p["evidence"], name_proof, *ratio_proofs))
    return out.withColumns({"meta_confidence": confidence, "meta_evidence": evidence}).drop(*_made(PATTERNS))


#: Fields that chunks take from their page where they have none.
SINGLE = ["T_K", "T_min_K", "T_max_K", "P_MPa", "P_min_MPa", "P_max_MPa", "coal_name", "ratios"]


def merge_page_chunk_metadata(df: DataFrame, page: str = "page_meta") -> DataFrame:
    """Chunk columns completed from the struct ``page``: lists united and sorted, a missing or unknown stage and missing
    single values filled."""
    of = lambda c: F.col(f"{page}.{c}")
    new = {c: F.when(F.col(c).isNull(), of(c)).when(of(c).isNull(), F.col(c)).otherwise(F.array_sort(F.array_union(c, of(c)))) for c in ("gas_agent", "targets")}
    new["stage"] = F.when(F.coalesce("stage", F.lit("unknown")) == "unknown", F.coalesce(of("stage"), F.lit("unknown"))).otherwise(F.col("stage"))
    return df.withColumns(new | {c: F.coalesce(c, of(c)) for c in SINGLE})


def fill_missing_metadata(df: DataFrame, external: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Values of an external table only where the rules found none, at confidence 0.70."""
    fields = [c for c in ("stage", "coal_name", "T_K", "P_MPa", "gas_agent", "targets") if c in external.columns]
    other = external.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_x_{c}") for c in fields])
    out = df.join(other, df[key] == other["_key"], "left")
    empty = {c: (F.coalesce("stage", F.lit("unknown")) == "unknown") if c == "stage" else F.col(c).isNull() for c in fields}
    taken = F.map_filter(F.create_map(*[x for c in fields for x in (F.lit(c), F.when(empty[c] & F.col(f"_x_{c}").isNotNull(), 0.70).cast("double"))]), lambda _, v: v.isNotNull())
    new = {c: F.when(empty[c] & F.col(f"_x_{c}").isNotNull(), F.col(f"_x_{c}")).otherwise(F.col(c)) for c in fields}
    if "meta_confidence" in df.columns:
        kept = F.map_filter("meta_confidence", lambda k, _: ~F.map_contains_key("_taken", k))
        out = out.withColumn("_taken", taken)
        new["meta_confidence"] = F.map_concat(kept, F.col("_taken"))
    return out.withColumns(new).drop("_key", "_taken", *[f"_x_{c}" for c in fields])
