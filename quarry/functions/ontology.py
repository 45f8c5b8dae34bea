"""The keyword ontology (data: kind, canonical name, aliases in order) and what it tags."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Ontology = Mapping[str, Mapping[str, list[str]]]

#: Canonical names and their aliases; the order of the stages decides.
DOMAIN: Ontology = {
    "stage": {
        "pyrolysis": ["pyrolysis", "pyroly", "thermal decomposition", "热解", "热分解", "热裂解", "干馏"],
        "gasification": ["gasification", "gasify", "气化", "气化反应"],
        "coupled": ["coupled", "coupling", "combined", "co-processing", "耦合", "联立", "联合", "复合"],
        "oxidation": ["oxidation", "oxidize", "partial oxidation", "氧化", "氧化反应", "部分氧化"],
        "combustion": ["combustion", "burning", "燃烧", "燃烧反应"],
        "ignition": ["ignition", "ignited", "点火", "着火", "着火特性"],
    },
    "gas_agent": {
        "steam": ["steam", "water vapor", "water vapour", "蒸汽", "水蒸气", "H2O", "H₂O"],
        "o2": ["o2", "O2", "O₂", "oxygen", "氧气", "纯氧"],
        "air": ["air", "空气", "air atmosphere", "空气气氛"],
        "co2": ["co2", "CO2", "CO₂", "carbon dioxide", "二氧化碳"],
        "n2": ["n2", "N2", "N₂", "nitrogen", "氮气"],
    },
    "targets": {
        "NH3": ["NH3", "NH₃", "ammonia", "氨"],
        "HCN": ["HCN", "hydrogen cyanide", "氰化氢"],
        "NOx": ["NOx", "NOX", "NOₓ", "nox", "nitrogen oxides", "氮氧化物"],
        "H2S": ["H2S", "H₂S", "hydrogen sulfide", "硫化氢"],
        "SO2": ["SO2", "SO₂", "sulfur dioxide", "二氧化硫"],
        "COS": ["COS", "carbonyl sulfide", "carbonylsulfide", "羰基硫"],
        "benzene": ["benzene", "C6H6", "C₆H₆", "苯"],
        "phenols": ["phenol", "phenols", "phenolic", "phenolics", "酚", "酚类", "酚类物质"],
    },
}

#: Which stage of several a question means.
QUESTION_STAGES = ["combustion", "ignition", "oxidation", "gasification", "pyrolysis", "coupled"]


def _has(low: Column, words: list[str]) -> Column:
    """Plain substrings of the lower-cased text. An alias that has another one in it decides nothing, and those that are not ASCII
    are looked up only in texts that are not."""
    every = list(dict.fromkeys(x.lower() for x in words))
    plain, others = F.lit(False), None
    for w in (x for x in every if not any(y != x and y in x for y in every)):
        if w.isascii():
            plain = plain | F.contains(low, F.lit(w))
        else:
            others = F.contains(low, F.lit(w)) if others is None else others | F.contains(low, F.lit(w))
    return plain if others is None else plain | ((F.length(low) < F.octet_length(low)) & others)


def lowered(text: Column) -> Column:
    """What the aliases are looked up in. Put it in a column of its own where several tags read it: it is a wide value."""
    return F.lower(F.coalesce(text, F.lit("")))


def tag_stage(text: Column, onto: Ontology = DOMAIN, low: Column | None = None) -> Column:
    """The first stage in ontology order that occurs, else ``unknown``. ``low``: the text lower-cased already."""
    low = lowered(text) if low is None else low
    return F.coalesce(*[F.when(_has(low, words), F.lit(name)) for name, words in onto["stage"].items()], F.lit("unknown"))


def tag_all(text: Column, kind: str, onto: Ontology = DOMAIN, own_name: bool = False, low: Column | None = None) -> Column:
    """Sorted canonical names of ``kind`` that occur, null if none; with ``own_name`` the name itself counts as an alias."""
    low = lowered(text) if low is None else low
    hits = [F.when(_has(low, [*words, *([name] if own_name else [])]), F.lit(name)) for name, words in sorted(onto[kind].items())]
    # Joined and split, not filtered as an array: the arguments of array filters are interpreted and not compiled.
    return F.split(F.nullif(F.concat_ws("\x01", *hits), F.lit("")), "\x01")


def tag_gas_agents(text: Column, onto: Ontology = DOMAIN, low: Column | None = None) -> Column:
    """Gas agents in the text."""
    return tag_all(text, "gas_agent", onto, low=low)


def tag_targets(text: Column, onto: Ontology = DOMAIN, low: Column | None = None) -> Column:
    """Target species in the text."""
    return tag_all(text, "targets", onto, own_name=True, low=low)


def flag_columns(onto: Ontology = DOMAIN) -> dict[str, Column]:
    """``gas_<agent>`` and ``has_<target>`` from the array columns."""
    gas = {f"gas_{g.lower()}": F.coalesce(F.array_contains("gas_agent", g), F.lit(False)) for g in onto["gas_agent"]}
    return gas | {f"has_{t}": F.coalesce(F.array_contains("targets", t), F.lit(False)) for t in onto["targets"]}
