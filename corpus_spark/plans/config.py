"""Typed run configuration (validated plain dicts -> dataclasses).

Sections mirror the reference's experiment config: ``pre_filter``,
``deduplicate``, ``threshold``, ``partition``, ``split``,
``language_sampling`` and ``save``; each is optional and runs in a fixed
order.  Unknown keys and bad values raise ``ValueError`` at load time.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from ..functions.signals import GOPHER_THRESHOLDS, REGISTRY
from ..operators.partition import METHODS
from ..operators.stats import STRATEGIES


def _build(cls, data: dict | None, section: str):
    if data is None:
        return None
    if not isinstance(data, dict):
        raise ValueError(f"Section `{section}` must be a mapping.")
    names = {f.name for f in fields(cls)}
    unknown = set(data) - names
    if unknown:
        raise ValueError(f"Unknown keys in `{section}`: {sorted(unknown)}")
    obj = cls(**data)
    obj.validate()
    return obj


#: A signal that needs a language model counted from a table.
PERPLEXITY = "perplexity"


def _known_metric(name: str) -> None:
    if name not in REGISTRY and name != PERPLEXITY:
        raise ValueError(f"Unknown metric: {name}")


@dataclass
class PreFilterConfig:
    script_regex: bool = False
    lang_id: bool = False
    apply_c4_filter: bool = False
    urls_to_remove: list[str] | None = None
    warn_percent: float = 0.0

    def validate(self):
        if not (self.script_regex or self.lang_id or self.apply_c4_filter or self.urls_to_remove):
            raise ValueError("`pre_filter` switches no filter on.")
        if isinstance(self.urls_to_remove, str):
            raise ValueError("`urls_to_remove` must be a list of URLs.")
        if not 0.0 <= self.warn_percent <= 1.0:
            raise ValueError("`warn_percent` must be in [0, 1].")


@dataclass
class DedupConfig:
    exact_match: bool = False
    min_hash: bool = False
    jaccard_threshold: float = 0.85
    n_shingles: int = 3
    tokenizer: str | None = None

    def validate(self):
        if not (self.exact_match or self.min_hash):
            raise ValueError("`deduplicate` needs `exact_match` or `min_hash`.")
        if not 0.0 < self.jaccard_threshold < 1.0:
            raise ValueError("jaccard_threshold must be in (0, 1).")
        if self.n_shingles < 1:
            raise ValueError("n_shingles must be >= 1.")


@dataclass
class ThresholdConfig:
    thresholds: dict = field(default_factory=dict)
    preset: str | None = None
    tokenizer: str | None = None
    model: str | None = None
    merge_test: bool = False

    def validate(self):
        if self.preset not in (None, "gopher"):
            raise ValueError(f"Unknown threshold preset: {self.preset}")
        if not self.thresholds and not self.preset:
            raise ValueError("Threshold section needs `thresholds` or `preset`.")
        for k, v in self.thresholds.items():
            _known_metric(k)
            if not (v == "auto" or isinstance(v, (int, float))):
                raise ValueError(f"Threshold for {k} must be a number or 'auto'.")

    def resolved(self) -> dict:
        out = dict(GOPHER_THRESHOLDS) if self.preset == "gopher" else {}
        out.update(self.thresholds)
        return out


@dataclass
class PartitionConfig:
    split_method: str = "balanced_chars"
    metrics: Any = "length_chars"
    quality: bool = True
    join_partitions_by: str | None = None
    tokenizer: str | None = None
    model: str | None = None
    merge_test: bool = False

    def metric_list(self) -> list[str]:
        return [self.metrics] if isinstance(self.metrics, str) else list(self.metrics)

    def validate(self):
        if self.split_method not in METHODS:
            raise ValueError(f"`split_method` must be one of {', '.join(METHODS)}, not {self.split_method!r}.")
        for m in self.metric_list():
            _known_metric(m)
        if self.join_partitions_by not in (None, "intersection", "union"):
            raise ValueError("`join_partitions_by` must be absent, 'intersection' or 'union'.")


@dataclass
class SplitConfig:
    test_size: float = 0.1
    shuffle: bool = True
    seed: int = 12345

    def validate(self):
        if not 0.0 < self.test_size < 1.0:
            raise ValueError("test_size must be in (0, 1).")


@dataclass
class SamplingConfig:
    sampling_strategy: str = "uniform"
    temperature: float = 1.0
    interleaving_strategy: str = "all_exhausted"
    raw_weights: dict | str | None = None
    seed: int = 42

    def validate(self):
        if self.sampling_strategy not in STRATEGIES:
            raise ValueError(f"Invalid strategy: {self.sampling_strategy}")
        if self.interleaving_strategy not in ("all_exhausted", "first_exhausted"):
            raise ValueError(f"Invalid interleaving strategy: {self.interleaving_strategy}")
        if self.temperature <= 0:
            raise ValueError("temperature must be > 0.")


@dataclass
class SieveConfig:
    experiment: str
    languages: list[str]
    sources: list[str] | None = None
    load_path: str | None = None
    streaming: bool = False
    pre_filter: PreFilterConfig | None = None
    deduplicate: DedupConfig | None = None
    threshold: ThresholdConfig | None = None
    partition: PartitionConfig | None = None
    split: SplitConfig | None = None
    language_sampling: SamplingConfig | None = None
    save_path: str | None = None

    @classmethod
    def from_dict(cls, d: dict) -> "SieveConfig":
        allowed = {f.name for f in fields(cls)}
        unknown = set(d) - allowed
        if unknown:
            raise ValueError(f"Unknown config keys: {sorted(unknown)}")
        for req in ("experiment", "languages"):
            if req not in d:
                raise ValueError(f"Missing required config key: {req}")
        if not d["languages"]:
            raise ValueError("At least one language is required.")
        from ..sources.langs import KNOWN_SOURCES, lookup
        if d.get("sources") and d.get("load_path"):
            raise ValueError("Give `sources` or `load_path`, not both.")
        for source in d.get("sources") or []:
            if source not in KNOWN_SOURCES:
                raise ValueError(f"Unknown source: {source}")
        for lang in d["languages"]:
            lookup(lang)
        return cls(
            experiment=d["experiment"], languages=list(d["languages"]), sources=d.get("sources"),
            load_path=d.get("load_path"),
            streaming=bool(d.get("streaming", False)),
            pre_filter=_build(PreFilterConfig, d.get("pre_filter"), "pre_filter"),
            deduplicate=_build(DedupConfig, d.get("deduplicate"), "deduplicate"),
            threshold=_build(ThresholdConfig, d.get("threshold"), "threshold"),
            partition=_build(PartitionConfig, d.get("partition"), "partition"),
            split=_build(SplitConfig, d.get("split"), "split"),
            language_sampling=_build(SamplingConfig, d.get("language_sampling"), "language_sampling"),
            save_path=d.get("save_path"))
