"""Command line: one option per setting, named --<stage>-<setting>."""

from __future__ import annotations

import argparse
import logging

from residua.options import Settings


def _reader(default):
    """Reads an option's text as the type of its default; without one, as a number where it is one."""
    if isinstance(default, bool):
        return lambda s: s.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(default, tuple):
        one = _reader(default[0]) if default else str
        return lambda s: tuple(one(x) for x in s.split(",") if x)
    if isinstance(default, str):
        return str
    return lambda s: None if s == "none" else _number(s) if default is None else type(default)(s)


def _number(s: str):
    try:
        return float(s)
    except ValueError:
        return s


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="residua", description="Quality control of timing rows on Spark.")
    p.add_argument("--toas", required=True, help="table of timing rows (parquet, orc, csv, json)")
    p.add_argument("--meta", help="table of metadata records")
    p.add_argument("--tim", help="timing file to read metadata from, with all it includes")
    p.add_argument("--par", help="parameter file for the covariates")
    p.add_argument("--out", required=True, help="folder of the annotated rows")
    p.add_argument("--format", default="parquet", help="parquet, orc, csv or json")
    p.add_argument("--structure-table-out", help="folder of the structure table (csv)")
    p.add_argument("--models-out", help="folder of the fitted bins (json)")
    p.add_argument("--settings-out", help="file of the settings (toml)")
    p.add_argument("--settings-in", help="settings to start from (toml)")
    p.add_argument("--drop-unmatched", action="store_true", help="drop rows without a record instead of failing")
    p.add_argument("--log-level", default="INFO")
    for stage in Settings():
        for name, default in stage.items:
            p.add_argument(f"--{stage.stage}-{name}".replace("_", "-"), dest=f"{stage.stage}.{name}", type=_reader(default), metavar="VALUE")
    return p


def config_of(args: argparse.Namespace) -> Settings:
    cfg = Settings()
    if args.settings_in:
        from residua.plans.settings import read_settings

        cfg = read_settings(args.settings_in)
    changes: dict[str, dict] = {}
    for name, value in vars(args).items():
        if "." in name and value is not None:
            stage, option = name.split(".")
            changes.setdefault(stage, {})[option] = value
    return cfg.but(drop_unmatched=args.drop_unmatched or None, **changes)


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    logging.basicConfig(level=args.log_level, format="%(asctime)s %(levelname)s %(message)s")
    log = logging.getLogger("residua")
    if not args.meta and not args.tim:
        raise SystemExit("one of --meta and --tim is needed")
    from pyspark.sql import SparkSession

    from residua.plans.pipeline import run_pipeline
    from residua.plans.report import structure_table
    from residua.plans.settings import write_models
    from residua.sources.observatory import all_sites
    from residua.sources.par import read_par
    from residua.sources.tim import parse_all_timfiles
    from residua.sources.timing import FileSource, write_rows

    cfg = config_of(args)
    spark = SparkSession.builder.appName("residua").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    offset = 0.0
    if args.tim:
        got = parse_all_timfiles(spark, args.tim)
        meta, offset = got.df, got.stats["max_abs_offset_sec"]
        log.info("timing files: %s", got.stats)
    else:
        meta = spark.read.format(args.meta.rstrip("/").rsplit(".", 1)[-1]).load(args.meta)
    sites = all_sites(spark, cfg.covariates.site_table)
    result = run_pipeline(spark, FileSource(args.toas), meta, par=read_par(args.par) if args.par else None, cfg=cfg, max_offset_sec=offset, sites=sites, settings_out=args.settings_out)
    write_rows(result.df, args.out, args.format)
    if args.models_out and result.models is not None:
        write_models(result.models, args.models_out, run={"par": args.par or "", "toas": args.toas})
    if args.structure_table_out and cfg.structure.mode in ("test", "both"):
        keys = [c for c in ("psr", "series_id", "grp") if c in result.df.columns]
        write_rows(structure_table(result.df, keys, cfg.structure.test), args.structure_table_out, "csv")
    log.info("wrote %s", args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
