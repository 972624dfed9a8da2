"""Configuration: TOML on the driver, checked key by key."""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

FILE_NAME = "duplet.toml"


class ConfigError(ValueError):
    """The configuration can't be read, parsed or used."""


@dataclass(frozen=True)
class FunctionConfig:
    min_similarity: float = 0.85
    min_nodes: int = 40


@dataclass(frozen=True)
class VocabConfig:
    min_overlap: float = 0.55
    min_vocabulary: int = 30
    worsened_delta: float = 0.05
    noise: dict[str, list[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class BlockConfig:
    min_tokens: int = 100


@dataclass(frozen=True)
class ReportConfig:
    max_findings: int | None = None


@dataclass(frozen=True)
class Config:
    """A missing key has its default, an unknown one is an error. max_findings: None is no cap, 0 reports nothing."""

    excludes: list[str] = field(default_factory=list)
    function: FunctionConfig = field(default_factory=FunctionConfig)
    vocab: VocabConfig = field(default_factory=VocabConfig)
    blocks: BlockConfig = field(default_factory=BlockConfig)
    report: ReportConfig = field(default_factory=ReportConfig)

    @staticmethod
    def parse(text: str) -> Config:
        try:
            raw = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"not valid TOML: {e}") from e
        return _build(Config, raw, "").validate()

    @staticmethod
    def load(path: str | Path) -> Config:
        try:
            return Config.parse(Path(path).read_text(encoding="utf-8"))
        except OSError as e:
            raise ConfigError(f"{path}: {e.strerror}") from e

    @staticmethod
    def discover(start: str | Path) -> Config:
        """The nearest file from start upwards along its path as written (of "." only itself), else the defaults."""
        start = Path(start)
        for folder in (start, *start.parents):
            if (folder / FILE_NAME).is_file():
                return Config.load(folder / FILE_NAME)
        return Config()

    def validate(self) -> Config:
        for key, value in (("function.min_similarity", self.function.min_similarity), ("vocab.min_overlap", self.vocab.min_overlap), ("vocab.worsened_delta", self.vocab.worsened_delta)):
            if math.isnan(value) or not 0 <= value <= 1:
                raise ConfigError(f"{key} must be from 0 to 1, not {value}")
        for key, value in (("function.min_nodes", self.function.min_nodes), ("vocab.min_vocabulary", self.vocab.min_vocabulary), ("blocks.min_tokens", self.blocks.min_tokens)):
            if value < 1:
                raise ConfigError(f"{key} must be 1 or more, not {value}")
        if self.report.max_findings is not None and self.report.max_findings < 0:
            raise ConfigError("report.max_findings must not be negative")
        return self


def _build(kind, raw: dict, where: str):
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(raw) - set(known)):
        raise ConfigError(f"unknown key {where}{unknown[0]}")
    values = {}
    for name, value in raw.items():
        default = getattr(kind(), name)
        if is_dataclass(default):
            if not isinstance(value, dict):
                raise ConfigError(f"{where}{name} must be a table")
            value = _build(type(default), value, f"{where}{name}.")
        elif isinstance(default, float):
            if isinstance(value, bool) or not isinstance(value, int | float):
                raise ConfigError(f"{where}{name} must be a number")
            value = float(value)
        elif isinstance(default, int) or name == "max_findings":
            if isinstance(value, bool) or not isinstance(value, int):
                raise ConfigError(f"{where}{name} must be a whole number")
        elif isinstance(default, list):
            if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                raise ConfigError(f"{where}{name} must be a list of strings")
        elif not isinstance(value, dict) or not all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in value.values()):
            raise ConfigError(f"{where}{name} must map names to lists of strings")
        values[name] = value
    return kind(**values)
