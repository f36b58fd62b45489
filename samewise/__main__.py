"""``python -m samewise DATA ID RULE OUT``: the pairs of a file that satisfy a rule, written as CSV.

RULE is ``attribute|JS|0.8,attribute|ED|2``; commas mean AND, semicolons OR. With --other and --other-id, pairs between two files.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from samewise.operators.rule_join import STRATEGIES, join_with_rules
from samewise.plans.planner import ORDERS
from samewise.plans.rules import parse_rule
from samewise.sources.io import READERS, read_records, write_pairs


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="samewise", description=__doc__)
    for name in ("data", "id", "rule", "out"):
        p.add_argument(name)
    p.add_argument("--other")
    p.add_argument("--other-id")
    p.add_argument("--format", choices=[r for r in READERS if r != "text"], default="csv")
    p.add_argument("--separator", default=",")
    p.add_argument("--strategy", choices=STRATEGIES, default="graph")
    p.add_argument("--order", choices=ORDERS, default="threshold_desc")
    p.add_argument("--missing", choices=["condition_false", "drop_record"], default="condition_false")
    p.add_argument("--q", type=int, default=2, help="length of the q-grams of edit distances")
    p.add_argument("--multi-line", action="store_true", help="cells of a CSV file hold line breaks")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    options = {"separator": a.separator, "trim": True, "multi_line": a.multi_line} if a.format == "csv" else {}
    read = lambda path: read_records(spark, path, a.format, **options)
    pairs = join_with_rules(read(a.data), parse_rule(a.rule), a.id, read(a.other) if a.other else None, a.other_id or a.id, missing=a.missing, strategy=a.strategy, order=a.order, q=a.q)
    write_pairs(pairs, a.out)


if __name__ == "__main__":
    main()
