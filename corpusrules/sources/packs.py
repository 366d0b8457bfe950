"""Rule packs and search packs from JSON or YAML documents, or from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrules.rulepack import DEFAULT_PRIORITY, Rule, RulePack, Search, enabled_searches
from corpusrules.schemas import PACK, RULES
from corpusrules.session import collect_small

# A pack is unrolled into plans on the driver; more entries than this are data, to be joined as a table.
MAX_PACK_ENTRIES = 100_000


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """One row per pack document.  YAML needs PyYAML on the driver; JSON is read by Spark."""
    if path.endswith((".yaml", ".yml")):
        return _read_yaml(spark, path)
    return spark.read.option("multiLine", True).schema(PACK).json(path)


def _read_yaml(spark: SparkSession, path: str) -> DataFrame:
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML packs needs PyYAML; JSON packs do not") from missing
    import json

    text = collect_small(spark.read.text(path, wholetext=True), 1, "documents in a pack file")[0][0]
    document = json.dumps(yaml.safe_load(text))
    row = spark.createDataFrame([(document,)], "value string")
    return row.select(F.from_json("value", PACK).alias("p")).select("p.*")


def rules_table(pack: DataFrame) -> DataFrame:
    """Rules of pack documents with the documents' defaults filled in; explicit values, zero and false too, stand."""
    rows = pack.select("settings", F.inline("rules"))
    priority = F.coalesce("priority", "settings.default_priority", F.lit(DEFAULT_PRIORITY))
    enabled = F.coalesce("enabled", "settings.default_enabled", F.lit(True))
    return rows.withColumns({"priority": priority, "enabled": enabled}).select(*RULES.names)


def searches_table(pack: DataFrame) -> DataFrame:
    """Active searches of pack documents."""
    return pack.select(F.inline("searches")).where(F.coalesce("enabled", F.lit(True)))


def load_rules(rules: DataFrame) -> RulePack:
    """A rules table as a checked :class:`RulePack`; rules are few by nature, and their number is checked."""
    rows = collect_small(rules, MAX_PACK_ENTRIES, "rules in a pack")
    return RulePack(tuple(Rule.from_record(r.asDict(recursive=True)) for r in rows))


def load_searches(searches: DataFrame) -> list[Search]:
    rows = collect_small(searches, MAX_PACK_ENTRIES, "searches in a pack")
    return enabled_searches([Search.from_record(r.asDict(recursive=True)) for r in rows])


def pack_as_table(spark: SparkSession, pack: RulePack) -> DataFrame:
    """A pack as a ``rules`` table."""
    return spark.createDataFrame([r.to_record() for r in pack], RULES)
