"""Run settings, checked when they are made."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

RUN_MODES = ("incremental", "full_rebuild")
BATCH_MODES = ("streaming", "post_scan")
NORMALIZATION_RULE = "l2_unit"
DEFAULT_PROFILE = "bert_tokenized_mean_pooling"


def check_threshold(name: str, value: float) -> float:
    """A finite similarity over 0 and up to 1."""
    if not (isinstance(value, (int, float)) and math.isfinite(value) and 0 < value <= 1):
        raise ValueError(f"{name} must be over 0 and at most 1, not {value!r}")
    return float(value)


@dataclass(frozen=True)
class ModelInfo:
    """What identifies the encoder of a snapshot."""

    model_id: str = "token-hash"
    model_hash: str = "0"
    model_profile: str = ""
    vector_dimension: int = 64
    normalization_rule: str = NORMALIZATION_RULE

    def __post_init__(self) -> None:
        if not self.model_id.strip() or not self.model_hash.strip() or self.vector_dimension <= 0:
            raise ValueError("model id, model hash and a positive dimension are needed")
        if self.normalization_rule != NORMALIZATION_RULE:
            raise ValueError(f"unknown normalization rule {self.normalization_rule!r}")

    @property
    def profile(self) -> str:
        return self.model_profile.strip() or DEFAULT_PROFILE


@dataclass(frozen=True)
class EngineConfig:
    run_mode: str = "incremental"
    batch_mode: str = "streaming"
    batch_size: int = 32
    dedup_threshold: float = 0.95
    cluster_threshold: float = 0.80
    max_messages: int = 5000
    include_all: bool = False
    search: str = "exact"
    rebuild_text: str = "body"
    json_snapshot: bool = True

    def __post_init__(self) -> None:
        if self.run_mode not in RUN_MODES or self.batch_mode not in BATCH_MODES:
            raise ValueError(f"unknown mode {self.run_mode!r} or {self.batch_mode!r}")
        if self.batch_size <= 0 or self.max_messages <= 0:
            raise ValueError("batch size and message limit must be positive")
        if self.search not in ("exact", "lsh") or self.rebuild_text not in ("body", "source"):
            raise ValueError("unknown search or rebuild_text")
        check_threshold("dedup_threshold", self.dedup_threshold)
        check_threshold("cluster_threshold", self.cluster_threshold)

    @classmethod
    def from_mapping(cls, values: Mapping[str, str], prefix: str = "NOTEWRIGHT_") -> EngineConfig:
        """Settings from text values such as those of an environment; blank ones keep their default."""
        return from_texts(cls, values, prefix)


def from_texts(cls: type, values: Mapping[str, str], prefix: str):
    """An object of settings from text values; blank ones keep their default."""
    kinds = {"int": int, "float": float, "str": str, "bool": lambda x: {"true": True, "1": True, "false": False, "0": False}[x.lower()]}
    found = {}
    for f in fields(cls):
        raw = values.get(prefix + f.name.upper(), "").strip()
        if raw:
            try:
                found[f.name] = kinds[f.type](raw)
            except (KeyError, ValueError) as e:
                raise ValueError(f"{prefix}{f.name.upper()}: {raw!r} is not {f.type}") from e
    return cls(**found)


@dataclass(frozen=True)
class HistoryConfig:
    """Where messages come from: the chat, how many of the newest, and whether all kinds of them."""

    chat: str = ""
    max_messages: int = 5000
    include_all: bool = False

    def __post_init__(self) -> None:
        if self.max_messages <= 0:
            raise ValueError("the message limit must be positive")


@dataclass(frozen=True)
class VaultConfig:
    """Where a vault is, and its JSON snapshot (by default in the vault)."""

    root: str = "vault"
    manifest: str = ""

    def __post_init__(self) -> None:
        if not self.root.strip():
            raise ValueError("the vault needs a folder")

    @property
    def manifest_path(self) -> str:
        return self.manifest.strip() or f"{self.root.rstrip('/')}/_meta/manifest.json"


@dataclass(frozen=True)
class ModelConfig:
    """The encoder's files and what they are called; a blank hash is that of the model file."""

    id: str = "token-hash"
    path: str = ""
    hash: str = ""
    profile: str = DEFAULT_PROFILE
    vocabulary: str = ""
    dimension: int = 64
    input_name: str = ""
    output_name: str = ""

    def __post_init__(self) -> None:
        if not self.id.strip() or self.dimension <= 0:
            raise ValueError("a model id and a positive dimension are needed")

    def info(self, file_hash: Callable[[str], str]) -> ModelInfo:
        """What identifies the model, its file hashed by ``file_hash`` where no hash is set."""
        return ModelInfo(self.id, self.hash.strip() or file_hash(self.path), self.profile, self.dimension)


@dataclass(frozen=True)
class Settings:
    """All settings, from one mapping such as an environment."""

    run: EngineConfig = EngineConfig()
    history: HistoryConfig = HistoryConfig()
    model: ModelConfig = ModelConfig()
    vault: VaultConfig = VaultConfig()

    @classmethod
    def from_mapping(cls, values: Mapping[str, str], prefix: str = "NOTEWRIGHT_") -> Settings:
        run = EngineConfig.from_mapping(values, prefix)
        return cls(run, *(from_texts(kind, values, f"{prefix}{name}_") for kind, name in ((HistoryConfig, "HISTORY"), (ModelConfig, "MODEL"), (VaultConfig, "VAULT"))))
