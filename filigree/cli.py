"""``python -m filigree --config FILE [--train-only | --calibrate-only] section.name=value ...``"""

from __future__ import annotations

import argparse
import logging

from filigree.config import Config, load_config, with_overrides
from filigree.plans import detect
from filigree.session import get_session

log = logging.getLogger("filigree")


def parse(args: list[str] | None = None) -> tuple[Config, argparse.Namespace]:
    p = argparse.ArgumentParser(prog="filigree", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--train-only", action="store_true")
    p.add_argument("--calibrate-only", action="store_true")
    p.add_argument("overrides", nargs="*")
    got = p.parse_args(args)
    pairs = {}
    for o in got.overrides:
        if "=" not in o:
            log.warning("%r is no override: it has no =", o)
            continue
        k, _, v = o.partition("=")
        pairs[k] = v
    return with_overrides(load_config(got.config) if got.config else Config(), pairs), got


def main(args: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    config, got = parse(args)
    spark = get_session()
    if got.train_only:
        log.info("%s", detect.train_only(spark, config)[1][-1])
    elif got.calibrate_only:
        detect.calibrate_only(spark, config).show()
    else:
        detect.run(spark, config)["metrics"].show()
