"""Command line: python -m weft {clusters,signatures,blocks,people,sample} ...

Paths may lie in any store that Spark reads. Results are folders of CSV or JSON files. Names and defaults of options are fixed values,
so that command lines in use keep their meaning.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weft.functions.pii import FIELDS
from weft.operators import minhash
from weft.operators.graph import ArcsFactors
from weft.plans import flagship, pii, signatures
from weft.sources import files


def _clusters(spark: SparkSession, args: argparse.Namespace) -> None:
    raw = files.read_records(spark, args.input, args.delimiter)
    prepared = flagship.prepare(raw, args.max_freq)
    config = flagship.Config(
        max_frequency=args.max_freq, init_df_max=args.init_df_max, init_df_percentile=args.init_df_percentile, max_depth=args.max_recursion_depth,
        min_intra_freq=args.min_intra_freq, min_token_length=args.min_blk_token_len, exclude_numeric=not args.include_numeric, full=args.full_blocking,
        hierarchical=args.hierarchical_blocking, merge=not args.no_merge, purge=not args.no_purge, cluster_on=args.cluster_on, k=args.top_k,
        min_block_size=args.min_block_size, mode=args.filter_mode, weight_size=args.filter_weight_size, weight_shared=args.filter_weight_shared,
        weight_tokenlen=args.filter_weight_tokenlen, tau=args.tau, weighting=args.arcs_weighting, density_floor=args.density_floor,
        density_min_size=args.density_min_size, max_block_pair_cost=args.max_block_pair_cost,
        factors=ArcsFactors(args.arcs_length_weight, args.arcs_numeric_factor, args.arcs_word_factor, args.arcs_density_weight, args.arcs_density_sample_cap, args.arcs_pair_sim_weight),
    )
    config = flagship.legacy(config, args.stop_k, prepared.records, args.stop_k_factor)
    path = args.truth or (files.truth_file(args.input, args.truth_dir) if args.truth_dir else None)
    truth = files.read_truth(spark, path) if path else None
    single = args.no_merge or args.no_purge or args.hierarchical_blocking
    for run in [flagship.run(prepared, config)] if single else flagship.ablation(prepared, config):
        out = args.output + ("" if single else files.config_suffix(run.config.merge, run.config.purge))
        files.write_clusters(run.clusters, prepared.original, out, not args.no_singletons)
        files.write_metrics(run.metrics(truth), out)


def _signatures(spark: SparkSession, args: argparse.Namespace) -> None:
    records = files.read_records(spark, args.input, args.delimiter)
    done = signatures.run(records, args.max_frequency, args.method, args.similarity_threshold, args.use_lsh, args.lsh_threshold, args.max_depth, args.min_bucket_size)
    files.write_csv(files.flat_blocks(done.leaves.withColumnRenamed("label", "key"), records), args.output)


def _blocks(spark: SparkSession, args: argparse.Namespace) -> None:
    config = minhash.BlockerConfig(
        id_column=args.id_column, blocking_columns=tuple(args.columns), q=args.q, alpha=args.alpha, beta=args.beta, max_depth=args.max_depth,
        min_block_size=args.min_block_size, max_keys_per_level=args.max_keys_per_level, run_global_correction=args.global_correction,
        auto_stopword_top_percentile=args.stop_share, manual_stopwords=tuple(args.stopwords), gc_min_freq_std=args.gc_min_freq_std,
        gc_min_len_std=args.gc_min_len_std, gc_max_freq_err=args.gc_max_freq_err, gc_word_list=args.word_list,
    )
    blocker = minhash.RecursiveMinHashBlocker(config).fit(files.read_table(spark, args.input))
    export = blocker.export()
    files.write_csv(export.withColumn("used_keys_path", F.array_join("used_keys_path", " ")), args.output)
    files.write_metrics(blocker.metrics(), args.output)
    if args.jaccard:
        blocker.nested().write.mode("overwrite").json(f"{args.output}.scores")
    if args.report:
        minhash.print_report(blocker.blocks())


def _people(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.extract:
        found = pii.resolve(files.read_first_column(spark, args.input), max_block_size=args.max_block_size)
    else:
        found = pii.resolve_records(files.read_table(spark, args.input, ", ".join(f"{name} string" for name in FIELDS)), args.max_block_size)
    files.write_csv(found, args.output)


def _sample(spark: SparkSession, args: argparse.Namespace) -> None:
    files.write_csv(files.sample_records(spark, args.rows, args.duplicate_ratio, args.seed), args.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weft", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run: object, reads: bool = True) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        if reads:
            sub.add_argument("--input", required=True)
        sub.add_argument("--output", required=True)
        sub.set_defaults(run=run)
        return sub

    c = command("clusters", _clusters)
    for name, kind, default in (
        ("delimiter", str, ","), ("truth", str, None), ("truth-dir", str, None), ("max-freq", int, 60), ("init-df-max", int, None), ("init-df-percentile", float, 0.95),
        ("max-recursion-depth", int, 5), ("min-intra-freq", int, 2), ("min-blk-token-len", int, 4), ("top-k", int, 3), ("min-block-size", int, 2),
        ("filter-weight-size", float, 0.0), ("filter-weight-shared", float, 0.0), ("filter-weight-tokenlen", float, 0.0), ("tau", float, 0.2), ("density-floor", float, 0.0),
        ("density-min-size", int, 3), ("max-block-pair-cost", int, None), ("arcs-length-weight", float, 0.0), ("arcs-numeric-factor", float, 1.0), ("arcs-word-factor", float, 1.0),
        ("arcs-density-weight", float, 0.0), ("arcs-density-sample-cap", int, 200), ("arcs-pair-sim-weight", float, 1.0), ("stop-k", int, None), ("stop-k-factor", float, None),
    ):
        c.add_argument(f"--{name}", type=kind, default=default)
    for name in ("include-numeric", "full-blocking", "hierarchical-blocking", "no-merge", "no-purge", "no-singletons"):
        c.add_argument(f"--{name}", action="store_true")
    c.add_argument("--cluster-on", choices=("final", "peak"), default="final")
    c.add_argument("--filter-mode", choices=("size", "specificity", "keylen", "composite"), default="size")
    c.add_argument("--arcs-weighting", choices=("uniform", "idf"), default="uniform")

    s = command("signatures", _signatures)
    s.add_argument("--delimiter", default=",")
    s.add_argument("--method", choices=("data_quality", "fuzzy", "phonetic", "manual"), default="data_quality")
    for name, kind, default in (("max-frequency", int, 60), ("similarity-threshold", int, 85), ("lsh-threshold", float, 0.5), ("max-depth", int, 3), ("min-bucket-size", int, 2)):
        s.add_argument(f"--{name}", type=kind, default=default)
    s.add_argument("--use-lsh", action="store_true")

    b = command("blocks", _blocks)
    b.add_argument("--id-column", default="RecID")
    b.add_argument("--columns", nargs="+", default=["Name", "Address"])
    b.add_argument("--stopwords", nargs="*", default=[])
    b.add_argument("--stop-share", type=float, default=0.005)
    for name, default in (("q", 2), ("alpha", 2), ("beta", 1000), ("max-depth", 5), ("min-block-size", 2), ("max-keys-per-level", 3),
                          ("gc-min-freq-std", 10), ("gc-min-len-std", 3), ("gc-max-freq-err", 3)):
        b.add_argument(f"--{name}", type=int, default=default)
    b.add_argument("--word-list", help="known words, one a line, which the correction leaves alone while they are rare")
    b.add_argument("--global-correction", action="store_true")
    b.add_argument("--jaccard", action="store_true", help="also write blocks with the similarities of their pairs")
    b.add_argument("--report", action="store_true", help="print blocks by depth and size")

    p = command("people", _people)
    p.add_argument("--extract", action="store_true", help="lines are free text; the default extractor reads name: value pairs or JSON")
    p.add_argument("--max-block-size", type=int, default=100)

    g = command("sample", _sample, reads=False)
    g.add_argument("--rows", type=int, default=1000)
    g.add_argument("--duplicate-ratio", type=float, default=0.3)
    g.add_argument("--seed", type=int, default=42)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName("weft").getOrCreate(), args)


if __name__ == "__main__":
    main()
