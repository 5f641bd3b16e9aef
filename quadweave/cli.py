"""The command line: python -m quadweave [-v | -vv | --verbose] [--profile] [--only-conflicts] [--only-mapped] config.xml"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from quadweave import config as configuration
from quadweave.errors import FusionError, InvalidInput

USAGE = "usage: python -m quadweave [-v | -vv | --verbose] [--profile] [--only-conflicts] [--only-mapped] CONFIG.xml"
LEVELS = ("ERROR", "WARN", "INFO")


@dataclass
class Arguments:
    config: str
    verbosity: int = 0
    profile: bool = False
    only_conflicts: bool = False
    only_mapped: bool = False


def arguments(given: list[str]) -> Arguments:
    """The last argument that is no option is the configuration."""
    out = Arguments("")
    for a in given:
        if a == "-v":
            out.verbosity = 1
        elif a in ("-vv", "--verbose"):
            out.verbosity = 2
        elif a == "--profile":
            out.profile = True
        elif a == "--only-conflicts":  # accepted, without effect; FusionJob(only_conflicts=True) has the filter
            out.only_conflicts = True
        elif a == "--only-mapped":
            out.only_mapped = True
        else:
            out.config = a
    if not out.config:
        raise InvalidInput("the configuration file is missing")
    return out


def main(given: list[str] | None = None) -> int:
    """0 if all went well, 1 for input that can't be used, else the error's code."""
    try:
        args = arguments(sys.argv[1:] if given is None else given)
        config = configuration.read(args.config)
        config.only_mapped, config.profile = args.only_mapped, args.profile
        configuration.validate(config)
    except InvalidInput as e:
        print(f"{e}\n{USAGE}", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from quadweave.runner import Phase, Run, duration
    from quadweave.session import build_session

    active = SparkSession.getActiveSession()
    spark = active or build_session()
    spark.sparkContext.setLogLevel(LEVELS[args.verbosity])
    run = Run(config, spark)
    try:
        n = run.run()
    except FusionError as e:
        print(e, file=sys.stderr)
        return int(e.code)
    except InvalidInput as e:
        print(e, file=sys.stderr)
        return 1
    finally:
        if args.profile:
            print("\n".join(run.timers.report(spark)))
        if active is None:
            spark.stop()
    print(f"{n} statements fused in {duration(sum(run.timers.seconds[p] for p in Phase))}")
    return 0
