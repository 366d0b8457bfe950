"""Rules and searches as immutable driver-side values, checked once and compiled into plans."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from importlib.resources import files as package_files

from corpusrules.functions.extractors import Extractor, get_extractor
from corpusrules.functions.patterns import regex
from corpusrules.functions.search_lines import line_test

DEFAULT_PRIORITY = 50


@dataclass(frozen=True)
class Rule:
    name: str
    file_pattern: str | None = None
    parser_type: str = "regex"
    parser_config: Mapping[str, object] = field(default_factory=dict, hash=False)
    priority: int = DEFAULT_PRIORITY
    path_pattern: str | None = None
    required_content: str | None = None
    max_file_size: int | None = None
    enabled: bool = True
    tags: tuple[str, ...] = ()
    description: str = ""

    def __post_init__(self):
        if not self.name:
            raise ValueError("rule name cannot be empty")
        if not self.file_pattern and not self.path_pattern:
            raise ValueError(f"rule {self.name}: a file_pattern or path_pattern is required")
        for pattern in (self.path_pattern, self.required_content):
            if pattern:
                regex(pattern)
        self.extractor()

    def extractor(self) -> Extractor:
        return get_extractor(self.parser_type, self.parser_config)

    @classmethod
    def from_record(cls, record: Mapping, settings: Mapping | None = None) -> Rule:
        """A rule as written in a pack document; null fields take the pack's defaults, explicit values stand."""
        settings, match, parser = settings or {}, record.get("match") or {}, record.get("parser") or {}
        if not parser.get("type"):
            raise ValueError(f"rule {record.get('name')}: parser type is required")

        def first(*values):
            return next(v for v in values if v is not None)

        return cls(
            name=record.get("name") or "",
            description=record.get("description") or "",
            priority=int(first(record.get("priority"), settings.get("default_priority"), DEFAULT_PRIORITY)),
            enabled=bool(first(record.get("enabled"), settings.get("default_enabled"), True)),
            tags=tuple(record.get("tags") or ()),
            file_pattern=match.get("file_pattern") or None,
            path_pattern=match.get("path_pattern") or None,
            required_content=match.get("required_content") or None,
            max_file_size=int(match["max_file_size"]) if match.get("max_file_size") else None,
            parser_type=parser["type"],
            parser_config=dict(parser.get("config") or {}),
        )

    def to_record(self) -> dict:
        config = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in self.parser_config.items()}
        return {
            "name": self.name,
            "description": self.description,
            "priority": self.priority,
            "enabled": self.enabled,
            "tags": list(self.tags),
            "match": {
                "file_pattern": self.file_pattern,
                "path_pattern": self.path_pattern,
                "required_content": self.required_content,
                "max_file_size": self.max_file_size,
            },
            "parser": {"type": self.parser_type, "config": config},
        }


@dataclass(frozen=True)
class RulePack:
    """Rules in evaluation order: priority, then name."""

    rules: tuple[Rule, ...]

    def __post_init__(self):
        names = [r.name for r in self.rules]
        repeated = sorted({n for n in names if names.count(n) > 1})
        if repeated:
            raise ValueError(f"duplicate rule name: {', '.join(repeated)}")
        object.__setattr__(self, "rules", tuple(sorted(self.rules, key=lambda r: (r.priority, r.name))))

    def __iter__(self):
        return iter(self.rules)

    def __len__(self):
        return len(self.rules)

    def enabled(self) -> RulePack:
        """F1."""
        return RulePack(tuple(r for r in self.rules if r.enabled))

    def tagged(self, tags: Iterable[str]) -> RulePack:
        """rules with at least one of the tags; no tags keeps all."""
        wanted = set(tags)
        return RulePack(tuple(r for r in self.rules if not wanted or wanted & set(r.tags)))

    def with_rules(self, *rules: Rule) -> RulePack:
        return RulePack(self.rules + rules)


@dataclass(frozen=True)
class Search:
    """One content search.  ``max_matches`` caps matches per project, ``max_file_size`` leaves out larger files; 0 is no limit."""

    term: str
    name: str = ""
    is_regex: bool = False
    case_sensitive: bool = False
    file_patterns: tuple[str, ...] = ()
    context_lines: int = 0
    max_matches: int = 0
    max_file_size: int = 0
    enabled: bool = True
    description: str = ""

    def __post_init__(self):
        if not self.name:
            object.__setattr__(self, "name", self.term)
        line_test(self.term, self.is_regex, self.case_sensitive)

    @classmethod
    def from_record(cls, record: Mapping) -> Search:
        if not record.get("name"):
            raise ValueError("search name is required")
        return cls(
            term=record.get("search_term") or "",
            name=record["name"],
            description=record.get("description") or "",
            is_regex=bool(record.get("is_regex")),
            case_sensitive=bool(record.get("case_sensitive")),
            file_patterns=tuple(record.get("file_patterns") or ()),
            context_lines=int(record.get("context_lines") or 0),
            max_matches=int(record.get("max_matches") or 0),
            max_file_size=int(record.get("max_file_size") or 0),
            enabled=record.get("enabled") is None or bool(record["enabled"]),
        )


def enabled_searches(searches: Sequence[Search]) -> list[Search]:
    """The active searches of a pack; having none is an error."""
    if not searches:
        raise ValueError("config holds no search definitions")
    names = [s.name for s in searches]
    if len(set(names)) < len(names):
        raise ValueError("duplicate search name")
    active = [s for s in searches if s.enabled]
    if not active:
        raise ValueError("no enabled searches found in config")
    return active


def pack_from_document(document: Mapping) -> RulePack:
    settings = document.get("settings") or {}
    return RulePack(tuple(Rule.from_record(r, settings) for r in document.get("rules") or ()))


def builtin_pack(name: str = "default") -> RulePack:
    """Rule packs shipped as data: ``default``, ``default+comments`` with the comment-only rule, ``basic``, ``licenses``."""
    return RulePack(tuple(rule for part in name.split("+") for rule in pack_from_document(_packaged(part)).rules))


def builtin_searches(name: str = "searches") -> list[Search]:
    """The search pack shipped as data."""
    return enabled_searches([Search.from_record(r) for r in _packaged(name)["searches"]])


def _packaged(name: str) -> dict:
    return json.loads((package_files("corpusrules") / "packs" / f"{name}.json").read_text())


