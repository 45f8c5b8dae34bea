"""Questions: constraints read from the text, rewriting, filters over chunks and their relaxation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.metadata import N
from quarry.functions.ontology import DOMAIN, QUESTION_STAGES, Ontology, _has, tag_gas_agents, tag_targets
from quarry.operators.intervals import cells, first_meeting, levels
from quarry.scratch import materialize

#: Fixed values.
MUST = ["必须", "only", "strict", "严格", "仅"]
EXPANSIONS = {
    "热解": ["pyrolysis"],
    "气化": ["gasification"],
    "氧化": ["oxidation"],
    "燃烧": ["combustion"],
    "点火": ["ignition"],
    "生成机理": ["formation mechanism", "reaction pathway"],
    "机理": ["mechanism", "reaction pathway"],
}
MECHANISM = ["formation mechanism", "mechanism", "生成机理", "机理", "形成机理"]
MECHANISM_TERMS = [
    "phenols formation mechanism",
    "phenolic compounds",
    "tar phenolic compounds",
    "cleavage",
    "condensation",
    "secondary reactions",
    "oxygen-containing functional groups",
    "ether bond cleavage",
]

CONSTRAINT = "STRUCT<name: STRING, ctype: STRING, str_value: STRING, set_value: ARRAY<STRING>, lo: DOUBLE, hi: DOUBLE, confidence: DOUBLE, priority: STRING>"
_DASH = r"\s*[-~～]\s*"


def _range(text: Column, unit: str, slack: float, shift: float = 0.0) -> Column:
    """(lo, hi) of the first range, else the first single value with ``slack`` on both sides; null without a number."""
    two, one = rf"(?i){N}{_DASH}{N}{unit}", rf"(?i){N}{unit}"
    pair, single = F.regexp_extract(text, two, 0), F.regexp_extract(text, one, 1)
    number = lambda g: F.regexp_extract(pair, two, g).cast("double") + shift
    v = F.nullif(single, F.lit("")).cast("double") + shift
    return F.when(pair != "", F.struct(number(1).alias("lo"), number(2).alias("hi"))).when(single != "", F.struct((v * (1 - slack)).alias("lo"), (v * (1 + slack)).alias("hi")))


def _constraint(name: str, ctype: str, confidence: float, priority: Column, **value: Column) -> Column:
    null = {"str_value": F.lit(None), "set_value": F.lit(None), "lo": F.lit(None), "hi": F.lit(None)} | value
    return F.struct(F.lit(name).alias("name"), F.lit(ctype).alias("ctype"), *[null[k].alias(k) for k in ("str_value", "set_value", "lo", "hi")], F.lit(confidence).alias("confidence"), priority.alias("priority")).cast(CONSTRAINT)


def parse_queries(queries: DataFrame, onto: Ontology = DOMAIN, text_col: str = "raw") -> DataFrame:
    """``queries`` plus q_stage, q_stage_candidates, q_gas_agent, q_targets, q_T, q_P (lo, hi), q_coal_name and the array
    ``constraints``. A must-word makes stage, temperature and pressure hard; everything else is soft."""
    text = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    low = F.lower(text)
    candidates = F.array_compact(F.array(*[F.when(_has(low, words), F.lit(s)) for s, words in onto["stage"].items()]))
    ranked = [s for s in QUESTION_STAGES if s in onto["stage"]] + [s for s in onto["stage"] if s not in QUESTION_STAGES]
    stage = F.coalesce(*[F.when(F.array_contains("q_stage_candidates", s), F.lit(s)) for s in ranked], F.lit("unknown"))
    must = F.lit(False)
    for w in MUST:
        must = must | F.contains(text, F.lit(w))
    out = queries.withColumn("q_stage_candidates", candidates).withColumns(
        {
            "q_stage": stage,
            "q_gas_agent": tag_gas_agents(text, onto),
            "q_targets": tag_targets(text, onto),
            "q_T": F.coalesce(_range(text, r"\s*K", 0.05), _range(text, r"\s*°?\s*C", 0.05, 273.15)),
            "q_P": _range(text, r"\s*MPa", 0.1),
            "q_coal_name": F.nullif(F.trim(F.regexp_extract(text, r"(煤种|煤)\s*[:：]\s*([^\n，。;；]+)", 2)), F.lit("")),
            "_hard": F.when(must, "hard").otherwise("soft"),
        }
    )
    hard, soft = F.col("_hard"), F.lit("soft")
    said = [
        F.when(F.col("q_stage") != "unknown", _constraint("stage", "enum", 0.6, hard, str_value=F.col("q_stage"))),
        F.when(F.col("q_gas_agent").isNotNull(), _constraint("gas_agent", "set", 0.6, soft, set_value=F.col("q_gas_agent"))),
        F.when(F.col("q_targets").isNotNull(), _constraint("targets", "set", 0.6, soft, set_value=F.col("q_targets"))),
        F.when(F.col("q_T").isNotNull(), _constraint("T_range_K", "range", 0.9, hard, lo=F.col("q_T.lo"), hi=F.col("q_T.hi"))),
        F.when(F.col("q_P").isNotNull(), _constraint("P_range_MPa", "range", 0.9, hard, lo=F.col("q_P.lo"), hi=F.col("q_P.hi"))),
        F.when(F.col("q_coal_name").isNotNull(), _constraint("coal_name", "text", 0.5, soft, str_value=F.col("q_coal_name"))),
    ]
    return out.withColumn("constraints", F.array_compact(F.array(*said))).drop("_hard")


def rewrite_queries(queries: DataFrame, text_col: str = "raw") -> DataFrame:
    """``queries`` plus rewritten and rewrite_reason: English terms for the Chinese ones that occur, else terms for questions
    about mechanisms, else the trimmed text."""
    base = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    terms = F.concat(*[F.when(F.contains(base, F.lit(zh)), F.array(*[F.lit(e) for e in en])).otherwise(F.array().cast("array<string>")) for zh, en in EXPANSIONS.items()])
    sorted_terms = F.array_sort(F.array_distinct(terms))
    zh = F.size(sorted_terms) > 0
    mechanism = _has(F.lower(base), MECHANISM)
    text = F.when(zh, F.concat(base, F.lit(" "), F.array_join(sorted_terms, " "))).when(mechanism, F.concat(base, F.lit(" " + " ".join(MECHANISM_TERMS)))).otherwise(base)
    return queries.withColumns({"rewritten": text, "rewrite_reason": F.when(zh, "zh_rules").when(mechanism, "mechanism_rules").otherwise("")})


def range_overlap(point: Column, low: Column, high: Column, lo: Column, hi: Column) -> Column:
    """Closed intervals overlap where the row has both bounds, else the point lies in [lo, hi]; true without a question
    range, false without a value."""
    both = low.isNotNull() & high.isNotNull()
    inside = F.when(both, F.greatest(low, lo) <= F.least(high, hi)).otherwise(F.coalesce(point.between(lo, hi), F.lit(False)))
    return F.when(lo.isNull() | hi.isNull(), F.lit(True)).otherwise(F.coalesce(inside, F.lit(False)))


def _within(point: Column, low: Column, high: Column, lo: Column, hi: Column) -> Column:
    return F.coalesce(point.between(lo, hi), F.lit(False)) | F.coalesce((low <= hi) & (high >= lo), F.lit(False))


def filters_of(queries: DataFrame, mode: str = "hard_only") -> DataFrame:
    """``queries`` with the filter columns f_stage, f_gas_agent, f_targets, f_T, f_P and f_coal_name: of the hard constraints
    alone, or of all of them (``full``)."""
    every = F.lit(mode == "full")
    use = lambda name: F.exists("constraints", lambda c: (c["name"] == name) & (every | (c["priority"] == "hard")))
    source = {"f_stage": ("stage", "q_stage"), "f_gas_agent": ("gas_agent", "q_gas_agent"), "f_targets": ("targets", "q_targets"), "f_T": ("T_range_K", "q_T"), "f_P": ("P_range_MPa", "q_P"), "f_coal_name": ("coal_name", "q_coal_name")}
    return queries.withColumns({f: F.when(use(name), F.col(c)) for f, (name, c) in source.items()})


#: Chunk columns that the filters read, and the question's filter columns.
FILTERED = ("stage", "gas_agent", "targets", "T_K", "T_min_K", "T_max_K", "P_MPa", "P_min_MPa", "P_max_MPa", "coal_name")
FILTERS = ("f_stage", "f_gas_agent", "f_targets", "f_T", "f_P", "f_coal_name")


def filter_columns(queries: DataFrame, chunks: DataFrame) -> tuple[list[str], list[str]]:
    """(filter columns of the questions, chunk columns they read). Beside the named filters every other column ``f_x`` of the
    questions (f_document_id, f_chunk_level, f_tenant_id and the like) asks for equality with a chunk column x."""
    plain = [c for c in queries.columns if c.startswith("f_") and c not in FILTERS and c[2:] in chunks.columns]
    return [*FILTERS, *plain], [*FILTERED, *[c[2:] for c in plain]]


def _passes(filters: list[str]) -> Column:
    f = F.col
    ok = (
        (f("f_stage").isNull() | (f("stage") == f("f_stage")))
        & (f("f_gas_agent").isNull() | F.coalesce(F.arrays_overlap("gas_agent", "f_gas_agent"), F.lit(False)))
        & (f("f_targets").isNull() | F.coalesce(F.arrays_overlap("targets", "f_targets"), F.lit(False)))
        & (f("f_T").isNull() | _within(f("T_K"), f("T_min_K"), f("T_max_K"), f("f_T.lo"), f("f_T.hi")))
        & (f("f_P").isNull() | _within(f("P_MPa"), f("P_min_MPa"), f("P_max_MPa"), f("f_P.lo"), f("f_P.hi")))
        & (f("f_coal_name").isNull() | F.coalesce(f("coal_name") == f("f_coal_name"), F.lit(False)))
    )
    for c in filters:
        if c not in FILTERS:
            ok = ok & (f(c).isNull() | F.coalesce(f(c[2:]) == f(c), F.lit(False)))
    return ok


#: Cell widths of temperatures (K) and pressures (MPa).
_WIDTHS = {"T": 16.0, "P": 0.25}
_ANY = "*"


def _extent(kind: str) -> tuple[Column, Column]:
    """What the point and the range of a chunk cover together."""
    point, low, high = (F.col(c) for c in (("T_K", "T_min_K", "T_max_K") if kind == "T" else ("P_MPa", "P_min_MPa", "P_max_MPa")))
    return F.least(point, low, high), F.greatest(point, low, high)


def _asked(kind: str) -> tuple[Column, Column]:
    return F.col(f"f_{kind}.lo"), F.col(f"f_{kind}.hi")


def _anchor(plain: list[str]) -> Column:
    """The filter by which a question finds its chunks: the narrowest that it has."""
    f = F.col
    out = F.when(f("f_T").isNotNull(), "T").when(f("f_P").isNotNull(), "P").when(f("f_coal_name").isNotNull(), "coal_name")
    for c in plain:
        out = out.when(f(c).isNotNull(), c[2:])
    return out.when(f("f_gas_agent").isNotNull(), "gas_agent").when(f("f_targets").isNotNull(), "targets").when(f("f_stage").isNotNull(), "stage").otherwise(_ANY)


_KEY = "array<struct<kind:string,stage:string,word:string,level:int,cell:bigint>>"


def _words(kind: str, words: Column) -> Column:
    made = F.transform(words, lambda w: F.struct(F.lit(kind).alias("kind"), F.lit(_ANY).alias("stage"), w.cast("string").alias("word"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("cell")))
    return F.coalesce(made.cast(_KEY), F.array().cast(_KEY))


def _ranges(kind: str, stage: Column, found: Column) -> Column:
    made = F.transform(found, lambda c: F.struct(F.lit(kind).alias("kind"), stage.alias("stage"), F.lit("").alias("word"), c["level"].alias("level"), c["cell"].alias("cell")))
    return made.cast(_KEY)


def filter_chunks(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs of a question and a chunk that passes its filters; a null never passes.

    Chunks and questions meet by equality on one filter of the question, the narrowest it has: cells of its temperature or
    pressure range together with its stage, its coal, gas agents, targets or any other column; then all filters are tested. A
    question without filters meets every chunk. Both tables are read several times, so tables serve better than plans. ``chunks``
    must not have columns that start with ``f_`` or a ``qid``."""
    filters, _ = filter_columns(queries, chunks)
    plain = [c for c in filters if c not in FILTERS]
    asked = queries.select("qid", *filters).withColumn("f__anchor", _anchor(plain))
    kinds = {r["f__anchor"] for r in asked.select("f__anchor").distinct().collect()}
    asks, has = [F.when(F.col("f__anchor") == _ANY, _words(_ANY, F.array(F.lit(""))))], []
    if _ANY in kinds:
        has.append(_words(_ANY, F.array(F.lit(""))))
    counts = {}
    for kind, width in _WIDTHS.items():
        if kind not in kinds:
            continue
        mine, theirs = levels(asked.where(F.col("f__anchor") == kind), *_asked(kind), width), levels(chunks, *_extent(kind), width)
        stage = F.coalesce(F.concat(F.lit("="), "f_stage"), F.lit(_ANY))
        asks.append(F.when(F.col("f__anchor") == kind, _ranges(kind, stage, cells(*_asked(kind), theirs, width))))
        covered = cells(*_extent(kind), mine, width)
        has += [_ranges(kind, F.lit(_ANY), covered), F.when(F.col("stage").isNotNull(), _ranges(kind, F.concat(F.lit("="), "stage"), covered)).otherwise(F.array().cast(_KEY))]
        counts[kind] = first_meeting(F.col("f__key.level"), F.col("f__key.cell"), _extent(kind), _asked(kind), width)
    for kind in sorted(kinds - set(_WIDTHS) - {_ANY}):
        several = kind in ("gas_agent", "targets")
        question, chunk = F.col(f"f_{kind}"), F.col(f"`{kind}`")
        asks.append(F.when(F.col("f__anchor") == kind, _words(kind, F.array_distinct(question) if several else F.array(question))))
        has.append(_words(kind, F.array_distinct(chunk) if several else F.when(chunk.isNotNull(), F.array(chunk))))
        if several:
            counts[kind] = F.col("f__key.word") == F.array_intersect(chunk, question)[0]
    left = chunks.withColumn("f__key", F.explode(F.concat(*has) if has else F.array().cast(_KEY)))
    right = asked.withColumn("f__key", F.explode(F.coalesce(*asks, F.array().cast(_KEY)))).drop("f__anchor")
    once = F.coalesce(*[F.when(F.col("f__key.kind") == k, c) for k, c in counts.items()], F.lit(True))
    return left.join(right, "f__key").where(once & _passes(filters)).drop("f__key", *filters)


def filter_group(chunks: DataFrame, read: list[str]) -> Column:
    """Text that is equal for chunks which every filter treats alike."""
    decimal = {f.name for f in chunks.schema if f.dataType.typeName() in ("double", "float")}
    return F.to_json(F.struct(*[(F.col(c) + F.lit(0).cast(chunks.schema[c].dataType)).alias(c) if c in decimal else F.col(c) for c in read]))  # -0.0 is 0.0


def passing_groups(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(group, qid): which groups of chunks with equal filtered columns pass a question's filters. Chunks are grouped and
    questions with equal filters are taken once, so the predicate meets groups and different filters, not chunks."""
    filters, read = filter_columns(queries, chunks)
    groups = chunks.select(*read).distinct()
    groups = materialize(groups.select(filter_group(groups, read).alias("group"), *read), "groups")
    same = F.to_json(F.struct(*filters))
    distinct = queries.groupBy(same.alias("qid")).agg(F.first(F.struct(*filters)).alias("f")).select("qid", "f.*")
    found = filter_chunks(groups, distinct).select("group", F.col("qid").alias("same"))
    return found.join(queries.select("qid", same.alias("same")), "same").select("group", "qid")


#: The fields that the usual relaxation lifts, and their filter columns here.
RELAXED = (("T_range_K", "P_range_MPa"),)
_FILTER_OF = {"T_range_K": "f_T", "P_range_MPa": "f_P"}


def relax_filters(queries: DataFrame, parents: DataFrame, children: DataFrame, rules: tuple[tuple[str, ...], ...] = RELAXED, max_steps: int = 2) -> DataFrame:
    """The questions that found no parents or no children, with the fields of the first ``max_steps`` of the ordered ``rules``
    lifted, ``two_stage_fallback`` true and ``relax_steps``, the number of rules used. The search for them runs again without
    the restriction to parents. Unknown fields are passed over."""
    served = parents.select("qid").distinct().join(children.select("qid").distinct(), "qid")
    used = rules[:max_steps]
    lifted = {_FILTER_OF.get(f, f"f_{f}") for rule in used for f in rule} & set(queries.columns)
    out = queries.join(served, "qid", "left_anti")
    return out.withColumns({c: F.lit(None).cast(queries.schema[c].dataType) for c in sorted(lifted)} | {"two_stage_fallback": F.lit(True), "relax_steps": F.lit(len(used))})
