"""The main workflow: tokens, stop words, seeds, refinement, per-record filter, pair graph, clusters, scores."""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.text import resplit_tokens
from weft.operators.blocks import top_k
from weft.operators.graph import ArcsFactors, cluster_records, number_clusters
from weft.operators.metrics import run_metrics
from weft.operators.refine import recursive_blocking
from weft.operators.seeds import seed_blocks
from weft.operators.tokens import frequency_cap, remove_frequent_tokens, stop_k, term_frequency
from weft.operators.trie import hierarchical_blocks, path_key
from weft.session import cut


@dataclass(frozen=True)
class Config:
    """Parameters of a run. init_df_max None means the percentile; full and hierarchical exclude each other. Defaults are fixed values."""

    max_frequency: int = 60
    init_df_max: int | None = None
    init_df_percentile: float = 0.95
    max_depth: int = 5
    min_intra_freq: int = 2
    min_token_length: int = 4
    exclude_numeric: bool = True
    full: bool = False
    hierarchical: bool = False
    merge: bool = True
    purge: bool = True
    cluster_on: str = "final"
    k: int = 3
    min_block_size: int = 2
    mode: str = "size"
    weight_size: float = 0.0
    weight_shared: float = 0.0
    weight_tokenlen: float = 0.0
    tau: float = 0.2
    weighting: str = "uniform"
    density_floor: float = 0.0
    density_min_size: int = 3
    max_block_pair_cost: int | None = None
    factors: ArcsFactors = field(default_factory=ArcsFactors)

    def __post_init__(self) -> None:
        if self.full and self.hierarchical:
            raise ValueError("full and hierarchical blocking exclude each other")
        if self.cluster_on not in ("final", "peak"):
            raise ValueError("cluster_on is final or peak")


def legacy(config: Config, k: int | None = None, records: DataFrame | None = None, factor: float | None = None) -> Config:
    """config with the older single threshold k, or factor times the mode of the record length, in its place."""
    if k is None and factor is not None and records is not None:
        k = stop_k(records, factor).first()["stop_k"]
    return config if k is None else replace(config, init_df_max=k, max_depth=k, min_intra_freq=2)


@dataclass(frozen=True)
class Prepared:
    """What all configurations of one input share."""

    original: DataFrame
    records: DataFrame
    freq: DataFrame


def prepare(raw: DataFrame, max_frequency: int = 60) -> Prepared:
    """Tokens split again at non-word characters, without frequent ones, and the frequencies of what is left."""
    original = raw.select("ref_id", resplit_tokens("tokens").alias("tokens"))
    records = cut(remove_frequent_tokens(original, term_frequency(original), max_frequency))
    return Prepared(original, records, cut(term_frequency(records)))


def seeds(prepared: Prepared, config: Config) -> DataFrame:
    if config.hierarchical:
        return path_key(hierarchical_blocks(prepared.records, prepared.freq))
    cap = config.init_df_max
    if cap is None and not config.full:
        cap = frequency_cap(prepared.freq, config.init_df_percentile).first()["freq"]
    return seed_blocks(prepared.records, prepared.freq, cap, config.min_token_length, config.exclude_numeric, config.full)


@dataclass(frozen=True)
class Run:
    config: Config
    blocks: DataFrame
    clusters: DataFrame
    timings: dict[str, float]

    def metrics(self, truth: DataFrame | None = None) -> DataFrame:
        flat = {k: v for k, v in asdict(self.config).items() if k != "factors" and v is not None}
        return run_metrics(self.clusters, truth, flat, self.timings)


def run(prepared: Prepared, config: Config, seed: DataFrame | None = None) -> Run:
    """One configuration: refinement, filter, clusters."""
    clock, timings = time.monotonic(), {}

    def lap(name: str) -> None:
        nonlocal clock
        timings[name], clock = time.monotonic() - clock, time.monotonic()

    blocks = cut(seed if seed is not None else seeds(prepared, config))
    if not config.hierarchical:
        refined = recursive_blocking(blocks, prepared.records, config.max_depth, config.min_intra_freq, config.merge, config.purge)
        blocks = refined.peak if config.cluster_on == "peak" else refined.blocks
    lap("recursive")
    kept = cut(top_k(blocks, config.k, config.min_block_size, config.mode, config.weight_size, config.weight_shared, config.weight_tokenlen))
    lap("filter")
    roots = cluster_records(
        kept, prepared.records, config.tau, config.weighting, config.density_floor, config.density_min_size, config.max_block_pair_cost, config.factors
    )
    clusters = cut(number_clusters(cut(roots)))
    lap("cluster")
    return Run(config, kept, clusters, timings)


def ablation(prepared: Prepared, config: Config) -> Iterator[Run]:
    """The four merge and purge combinations over the same seeds; one run in hierarchical mode."""
    if config.hierarchical:
        yield run(prepared, config)
        return
    shared = cut(seeds(prepared, config))
    for merge, purge in ((True, True), (True, False), (False, True), (False, False)):
        yield run(prepared, replace(config, merge=merge, purge=purge), shared)


def grid() -> list[tuple[str, str, Mapping[str, object]]]:
    """(group, name, changes to the default configuration) of the curated experiments (X9). Groups, names and values."""
    weights = {
        "all_equal": (1, 1, 1), "size_only": (1, 0, 0), "shared_only": (0, 1, 0), "tokenlen_only": (0, 0, 1),
        "size_shared": (1, 1, 0), "size_tokenlen": (1, 0, 1), "shared_tokenlen": (0, 1, 1),
    }

    def composite(w: tuple[int, int, int]) -> dict[str, object]:
        return {"mode": "composite", "weight_size": float(w[0]), "weight_shared": float(w[1]), "weight_tokenlen": float(w[2])}

    def sweep(group: str, name: str, label: str, values: list) -> list[tuple[str, str, Mapping[str, object]]]:
        return [(group, f"{label}={v}", {name: v}) for v in values]

    return [
        ("A_merge_purge", "default", {}),
        *[("B_filter_mode", f"fm={m}", {"mode": m}) for m in ("size", "specificity", "keylen")],
        ("B_filter_mode", "fm=composite", composite((1, 1, 1))),
        *[("C_composite", f"w={name}", composite(w)) for name, w in weights.items()],
        *sweep("D_tau", "tau", "tau", [0.05, 0.1, 0.2, 0.3, 0.4, 0.5]),
        *sweep("E_top_k", "k", "k", [1, 2, 3, 5, 10]),
        *[("F_arcs_idf", f"tau={t}", {"weighting": "idf", "tau": t}) for t in (0.2, 0.4, 1.0)],
        ("G_blocking", "full", {"full": True, "max_block_pair_cost": 100_000}),
        ("G_blocking", "hierarchical", {"hierarchical": True}),
        *sweep("H_recursion_depth", "max_depth", "d", [1, 2, 3, 5, 7, 10]),
        *sweep("I_density_floor", "density_floor", "df", [0.0, 0.3, 0.5, 0.7]),
        *[("J_pair_sim_w", f"psw={w}", {"factors": ArcsFactors(pair_sim_weight=w)}) for w in (0.0, 0.25, 0.5, 0.75, 1.0)],
        *sweep("K_min_block_size", "min_block_size", "mbs", [2, 3, 4, 5]),
    ]


def experiments(prepared: Prepared, truth: DataFrame, base: Config = Config(), only: set[str] | None = None) -> DataFrame:
    """One row per run of the grid (or of some of its groups): group, config_id, merge, purge, sizes, scores, seconds."""
    rows = None
    for group, name, changes in grid():
        if only and group not in only:
            continue
        for done in ablation(prepared, replace(base, **changes)):
            flat = done.metrics(truth).select(
                F.lit(group).alias("group"), F.lit(name).alias("config_id"), F.lit(done.config.merge).alias("do_merge"), F.lit(done.config.purge).alias("do_purge"),
                F.col("predicted_clusters.n_total").alias("n_clusters"), F.col("predicted_clusters.n_multi").alias("n_multi_clusters"), "pair_metrics.*",
                "size_distribution_l1", F.lit(sum(done.timings.values())).alias("time_total_s"),
            )
            rows = flat if rows is None else rows.unionByName(flat)
    if rows is None:
        raise ValueError("no such group")
    return cut(rows)
