"""``python -m arbora.plans.cli``: learn a tree from files or synthetic data, and score it."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from arbora.plans.learners import LEARNERS, evaluate
from arbora.session import local_session
from arbora.sources.files import read_edges, read_observations
from arbora.sources.synthetic import dataset


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--method", choices=list(LEARNERS), required=True)
    p.add_argument("--n", type=int, required=True, help="number of variables")
    p.add_argument("--k", type=int, default=2, help="values of each variable")
    p.add_argument("--T", type=int, default=10, help="time steps")
    p.add_argument("--epsilon", type=float, default=0.9)
    p.add_argument("--seed", type=int, default=22)
    p.add_argument("--noise", type=float, default=0.5)
    p.add_argument("--synthetic", action="store_true")
    p.add_argument("--tree", action="store_true", help="synthetic data from a tree, not a random graph")
    for name in ("--train_data", "--test_data", "--true_graph"):
        p.add_argument(name)
    p.add_argument("--output_folder", type=Path, required=True)
    return p


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = local_session()
    if args.synthetic:
        train, test, graph = dataset(spark, args.n, args.T, args.k, args.tree, args.seed, noise=args.noise)
    elif args.train_data and args.test_data and args.true_graph:
        train, test = (read_observations(spark, path, args.n) for path in (args.train_data, args.test_data))
        graph = read_edges(spark, args.true_graph)
    else:
        raise SystemExit("give --synthetic, or --train_data, --test_data and --true_graph")
    row = evaluate(train, test, graph, args.method, args.k, args.T, args.seed, args.epsilon).first().asDict()
    args.output_folder.mkdir(parents=True, exist_ok=True)
    (args.output_folder / "arguments.json").write_text(json.dumps(vars(args), default=str))
    (args.output_folder / "results.json").write_text(json.dumps(row))
    return row


if __name__ == "__main__":
    print(main())
