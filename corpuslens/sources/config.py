"""Configuration of a scan: YAML to dataclasses with defaults."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass
class Settings:
    """Defaults of a scan (fixed values of the scanner's documentation)."""

    pair_model: str
    store: str = "fixture"
    path: str = "."
    client: str = ""
    prefix: str = ""
    timestamp_fields: dict[str, str] = field(default_factory=dict)
    half_life_by_collection: dict[str, int] = field(default_factory=dict)
    fetch_budget_secs: int = 1800
    cost_budget: int = 50_000
    batch_size: int = 64
    candidates_per_chunk: int = 5
    max_cluster_size: int = 2000
    numeric_detector: bool = True
    version_detector: bool = True
    large_clusters: bool = False
    min_cluster_size: int | str = "auto"
    auto_tune: bool = False
    small_corpus: int = 500
    dedup_threshold: float | None = None
    contradiction_threshold: float | None = None
    cluster_density: float | None = None

    def overrides(self) -> dict[str, float]:
        """Thresholds that stand above the calibrated ones."""
        own = {"dedup_threshold": self.dedup_threshold, "contradiction_threshold": self.contradiction_threshold, "cluster_min_density": self.cluster_density}
        return {k: float(v) for k, v in own.items() if v is not None}

    def asdict(self) -> dict:
        return asdict(self)


def parse(raw: dict) -> Settings:
    """Settings of a nested mapping; inference.nli_model is the only key that must be there.

    The folder of a JSON store is fixture_dir, store.fixture_dir or store.connection.path, the
    first that is given. Unknown store types raise.
    """
    get = lambda s, k, d: (raw.get(s) or {}).get(k, d)
    model = get("inference", "nli_model", None)
    if not model:
        raise ValueError("inference.nli_model is missing")
    d = Settings(model)
    rows = raw.get("collections") or []
    link = get("store", "connection", None) or {}
    kind = get("store", "type", d.store)
    if kind not in ("parquet", "fixture", "paged"):
        raise ValueError(f"unknown store type: {kind}")
    return Settings(
        model, kind, raw.get("fixture_dir") or get("store", "fixture_dir", None) or link.get("path") or get("store", "path", d.path),
        link.get("client", ""), link.get("collection_prefix", "") or get("store", "collection_prefix", ""),
        {c["name"]: c["timestamp_field"] for c in rows if c.get("timestamp_field")}, {c["name"]: int(c["half_life_days"]) for c in rows if "half_life_days" in c},
        int(get("ingest", "fetch_budget_secs", d.fetch_budget_secs)), int(get("scan", "cost_budget", d.cost_budget)), int(get("scan", "nli_batch_size", d.batch_size)),
        int(get("scan", "contradiction_candidates_per_chunk", d.candidates_per_chunk)), int(get("scan", "max_nli_cluster_size", d.max_cluster_size)),
        bool(get("scan", "enable_numeric_detector", True)), bool(get("scan", "enable_version_detector", True)), bool(get("scan", "detect_in_large_clusters", False)),
        get("clustering", "min_cluster_size", "auto"), bool(get("clustering", "auto_tune_clustering", False)), int(get("scan", "small_corpus_threshold", d.small_corpus)),
        get("thresholds", "dedup", None), get("thresholds", "contradiction", None), get("thresholds", "density", None))


def load(path: str) -> Settings:
    import yaml

    with open(path) as f:
        return parse(yaml.safe_load(f) or {})


def write(settings: dict, path: str) -> None:
    """A configuration file of a nested mapping, checked before it is written."""
    import yaml

    parse(settings)
    with open(path, "w") as f:
        yaml.safe_dump(settings, f, sort_keys=False)
