"""Parameters of the dataset job."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

# --- fixed values -------------------------------------------------------------------------------
CARRIER_NAMES = ["aramex", "dhl", "fedex", "ups", "usps", "royal mail", "postnl"]
CARRIER_ALIAS = "Shipping_A"
KEYWORDS_V01 = [
    "track", "tracking", "delivery", "delivered", "carrier", "customs", "address",
    "wrong address", "lost", "damaged", "ETA", "parcel", "package", "shipment", "warehouse",
    "hub", "out for delivery",
]
KEYWORDS_V02 = [
    "track", "order", "shipment", "delivery", "package", "waybill", "courier", "customs",
    "delayed", "lost", "address", "scan",
]
RATIOS_V01 = {"bitext_hf": 0.7, "kaggle_twitter": 0.2, "synthetic": 0.1}
RATIOS_V02 = {"bitext_hf": 0.8, "kaggle_twitter": 0.1, "synthetic": 0.1}
TWEET_COLUMNS = {
    "user_col": "text",
    "inbound_col": "inbound",
    "tweet_id_col": "tweet_id",
    "response_tweet_id_col": "response_tweet_id",
}
INSTRUCTION_COLUMNS = {"user_col": "instruction", "agent_col": "response"}
# ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Dataset:
    name: str
    kind: str  # "kaggle..." for reply tweets, "hf" for an instruction corpus
    path: str
    mapping: dict[str, str] = field(default_factory=dict)
    format: str = ""  # of an instruction corpus: parquet or json
    split: str = ""  # of an instruction corpus: the folder, or the start of the files, to read; all if empty


@dataclass(frozen=True)
class Curation:
    datasets: tuple[Dataset, ...] = ()
    keywords: tuple[str, ...] = tuple(KEYWORDS_V02)
    carrier_names: tuple[str, ...] = tuple(CARRIER_NAMES)
    carrier_alias: str = CARRIER_ALIAS
    normalize_agent_style: bool = True
    prepend_steps: bool = True
    max_tokens: int = 1024
    mini_size: int = 20000
    val_ratio: float = 0.12
    ratios: dict[str, float] = field(default_factory=lambda: dict(RATIOS_V02))
    seed: str = "42"

    def quotas(self) -> dict[str, int]:
        return {name: int(self.mini_size * share) for name, share in self.ratios.items()}


V01 = Curation(
    keywords=tuple(KEYWORDS_V01), mini_size=2000, val_ratio=0.05, ratios=dict(RATIOS_V01)
)
V02 = Curation()


def from_mapping(cfg: dict[str, Any]) -> Curation:
    """Settings in the nested layout of the job files."""
    datasets = tuple(
        Dataset(
            name=d["name"],
            kind=d["kind"],
            path=d["path"] if "path" in d else d["hf_repo"],
            mapping=d.get("mapping", {}),
            format=d.get("format", ""),
            split=d.get("split", ""),
        )
        for d in cfg["datasets"]
    )
    output, tone, anonymize = cfg["output"], cfg["tone"], cfg["anonymize"]
    return Curation(
        datasets=datasets,
        keywords=tuple(cfg["filters"]["shipping_keywords"]),
        carrier_names=tuple(anonymize["carrier_aliases"]),
        carrier_alias=anonymize["replace_with"],
        normalize_agent_style=tone["normalize_agent_style"],
        prepend_steps=tone["prepend_steps"],
        max_tokens=output["max_tokens"],
        mini_size=int(output["mini_size"]),
        val_ratio=float(output["val_ratio"]),
        ratios=dict(cfg.get("ratios", RATIOS_V01)),
    )


def load(path: str) -> Curation:
    """Read a YAML (if the parser is installed) or JSON job file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return from_mapping(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("no YAML parser here; give the settings as JSON") from e
    return from_mapping(yaml.safe_load(text))
