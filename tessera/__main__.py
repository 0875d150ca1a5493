"""python -m tessera FOLDER --output BASE: a batch run from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Find duplicate images in a folder and write reports.")
    p.add_argument("folder", help="images to audit; they are only read")
    p.add_argument("--output", required=True, help="base path of the reports")
    p.add_argument("--config", help="YAML file of parameters")
    p.add_argument("--cache", help="folder of the feature table")
    p.add_argument("--sample", type=int, help="only the first valid images")
    p.add_argument("--resume", action="store_true", help="take features of unchanged files from the cache")
    p.add_argument("--verbose", action="store_true", help="log debug messages")
    return p


def main(arguments: list[str] | None = None) -> int:
    from tessera.config import load_config, make_config
    from tessera.engine import run

    a = parser().parse_args(arguments)
    if a.resume and not a.cache:
        parser().error("--resume needs --cache")
    if a.sample is not None and a.sample < 1:
        parser().error("--sample is at least 1")
    config = load_config(a.config) if a.config else make_config({})
    if a.verbose:
        config = make_config({**config.__dict__, "log_level": "DEBUG"})
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    result = run(spark, a.folder, config, progress=lambda message, share: print(f"{share:4.0%} {message}", flush=True), output=a.output, sample=a.sample, cache=a.cache, resume=a.resume)
    print("\n".join(result.written))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
