"""Options: what each may be is said once, in a table; values come from code or from YAML files.

A table maps an option to its default. The default's kind is the option's kind: a switch, text, a list of texts, or text that
may be absent (None). Options are kept as attributes of an object that is made from a table and what is given.
"""

from __future__ import annotations

from pathlib import Path
from typing import Any, ClassVar

import yaml

from ..functions.scalars import MISSING

# Names and defaults of options, which are a file format.
CLEANING: dict[str, Any] = {
    "remove_duplicates": True,
    "trim_whitespace": True,
    "collapse_internal_whitespace": True,
    "lowercase_emails": True,
    "standardize_dates": True,
    "date_format": "%Y-%m-%d",
    "date_first": False,
    "standardize_phones": True,
    "default_region": "US",
    "fix_scientific_notation": True,
    "normalize_unicode": False,
    "missing_value_strategy": "flag",  # flag, auto (median or mode), drop (rows without any value)
    "missing_value_tokens": list(MISSING),
    "email_columns": [],
    "phone_columns": [],
    "date_columns": [],
    "id_columns": [],
    "duplicate_subset": [],  # empty: all columns
}
FIELD: dict[str, Any] = {
    "name": "",
    "type": "string",
    "required": False,
    "unique": False,
    "transform": None,
    "source": None,
    "sources": [],
    "separator": " ",
    "aliases": [],
    "default": None,
}
TEMPLATE: dict[str, Any] = {"crm": "custom", "version": "1.0", "fields": []}


def _fitting(option: str, value: Any, default: Any) -> Any:
    """The value as the option's kind; other kinds raise."""
    match default:
        case bool():
            fits = isinstance(value, bool)
        case list():
            fits = isinstance(value, (list, tuple, set))
            value = list(value) if fits else value
        case None:
            fits = True
            value = None if value is None else str(value)
        case _:
            fits = isinstance(value, (str, int, float)) and not isinstance(value, bool)
            value = str(value)
    if not fits:
        raise ValueError(f"Option '{option}' can't be {value!r}; its default is {default!r}")
    return value


class Options:
    """One attribute for each option of TABLE."""

    TABLE: ClassVar[dict[str, Any]] = {}

    def __init__(self, *values: Any, **named: Any) -> None:
        given = dict(zip(self.TABLE, values, strict=False)) | named
        if others := ", ".join(sorted(given.keys() - self.TABLE.keys())):
            raise ValueError(f"Unknown {type(self).__name__} options: {others}")
        vars(self).update({option: _fitting(option, given.get(option, default), default) for option, default in self.TABLE.items()})

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and vars(self) == vars(other)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in vars(self).items() if v != self.TABLE[k])})"

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Options:
        return cls(**data)


class CleaningConfig(Options):
    TABLE = CLEANING

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> CleaningConfig:
        """The options in data, at its top or wherever below `pipeline` and `cleaning` they are; other names say nothing."""
        inner = _below(data, "pipeline", "cleaning")
        return cls(**{k: inner[k] for k in cls.TABLE.keys() & inner.keys()})


class TargetField(Options):
    TABLE = FIELD


class MappingConfig(Options):
    TABLE = TEMPLATE

    def __init__(self, *values: Any, **named: Any) -> None:
        super().__init__(*values, **named)
        self.fields = [f if isinstance(f, TargetField) else TargetField(**f) for f in self.fields]

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> MappingConfig:
        return cls(**{k: data[k] for k in cls.TABLE if data.get(k) is not None})

    def marked(self, mark: str) -> list[str]:
        """The names of the fields for which a switch is on, in order."""
        return [f.name for f in self.fields if getattr(f, mark)]


def _below(data: dict[str, Any], *levels: str) -> dict[str, Any]:
    return _below(data.get(levels[0], data) or {}, *levels[1:]) if levels else data


def _yaml(path: Path) -> dict[str, Any]:
    """What a YAML file holds; none is an empty table, and anything but a table raises."""
    with path.open(encoding="utf-8") as f:
        held = yaml.safe_load(f)
    if not isinstance(held, (dict, type(None))):
        raise ValueError(f"{path} holds no options")
    return held or {}


def load_cleaning_config(path: str | Path | None = None) -> CleaningConfig:
    return CleaningConfig.from_dict(_yaml(Path(path))) if path else CleaningConfig()


def templates() -> dict[str, Path]:
    """The templates that come with the package, by name."""
    folder = Path(__file__).parents[1] / "templates"
    return {p.stem: p for p in sorted(folder.iterdir()) if p.suffix == ".yaml"}


def available_crms() -> list[str]:
    return list(templates())


def load_mapping_config(name_or_path: str | Path) -> MappingConfig:
    """From a file, or the package's template of that name in either case."""
    asked, known = str(name_or_path), templates()
    chosen = Path(asked) if Path(asked).is_file() else known.get(asked.strip().lower())
    if chosen is None:
        raise FileNotFoundError(f"'{asked}' is neither a file nor a template; there are {', '.join(known)}")
    return MappingConfig.from_dict(_yaml(chosen))
