"""Command line: python -m tessera -i problem.pddl [-d domain.pddl] [-s bfs] [-e ff] [-g yannakakis].

With --iteration SEARCH,EVALUATOR,GENERATOR,SHARE, given once or more, the configurations run in turn; the plan goes to <plan file>.<number>."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .operators.datalog import Heuristic
from .operators.search import BAD_INPUT, PLAN_FOUND, SEARCHES, portfolio, solve, validate
from .plans.conjunctive import GENERATORS
from .sources.pddl import PddlError, load_task

USAGE = 1


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        self.print_usage(sys.stderr)
        print(f"error: {message}", file=sys.stderr)
        raise SystemExit(USAGE)


def _truth(text: str) -> bool:
    if text.lower() in ("1", "true", "yes", "on"):
        return True
    if text.lower() in ("0", "false", "no", "off"):
        return False
    raise argparse.ArgumentTypeError(f"{text!r} is no truth value")


def _whole(text: str) -> int:
    if not text.isdigit():
        raise argparse.ArgumentTypeError(f"{text!r} is no whole number")
    return int(text)


def _iteration(text: str) -> tuple[dict, float]:
    search, evaluator, generator, share = [x.strip() for x in (text.split(",") + [""] * 4)[:4]]
    if search not in SEARCHES or evaluator not in Heuristic.NAMES or generator not in GENERATORS or not share.replace(".", "", 1).isdigit() or float(share) <= 0 or text.count(",") != 3:
        raise argparse.ArgumentTypeError(f"{text!r} is no SEARCH,EVALUATOR,GENERATOR,SHARE")
    return {"search": search, "evaluator": evaluator, "generator": generator}, float(share)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="tessera")
    p.add_argument("-i", "--instance", required=True)
    p.add_argument("-d", "--domain")
    p.add_argument("-s", "--search", choices=sorted(SEARCHES), default="alt-bfws1")
    p.add_argument("-e", "--evaluator", choices=Heuristic.NAMES, default="ff")
    p.add_argument("-g", "--generator", choices=sorted(GENERATORS), default="yannakakis")
    p.add_argument("--batch", type=_whole, default=64)
    p.add_argument("--seed", type=_whole, default=1)
    p.add_argument("--time-limit", type=float, default=1800)
    p.add_argument("--plan-file", default="plan")
    p.add_argument("--iteration", type=_iteration, action="append")
    for flag in ("--unit-cost", "--validate", "--novelty-early-stop"):  # the last has no effect
        p.add_argument(flag, type=_truth, nargs="?", const=True, default=False)
    return p


def main(argv: list[str] | None = None) -> int:
    options = parser().parse_args(argv)
    try:
        task = load_task(options.instance, options.domain, options.unit_cost)
    except PddlError as e:
        print(f"error: {e}", file=sys.stderr)
        return BAD_INPUT
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    if options.iteration:
        result = portfolio(spark, task, [({**o, "batch": options.batch, "seed": options.seed}, share) for o, share in options.iteration], options.time_limit)
        options.plan_file += f".{result.statistics.get('configuration', 1)}"
    else:
        result = solve(spark, task, search=options.search, evaluator=options.evaluator, generator=options.generator, batch=options.batch, seed=options.seed, time_limit=options.time_limit)
    for name, n in result.statistics.items():
        print(f"{name}: {n}")
    if result.code == PLAN_FOUND:
        Path(options.plan_file).write_text("\n".join(result.lines) + "\n")
        print(f"Total plan cost: {result.cost}\nPlan length: {len(result.plan)}")
        if options.validate:
            print("Plan valid" if validate(spark, task, result.steps) else "Plan invalid")
    return result.code


if __name__ == "__main__":
    raise SystemExit(main())
