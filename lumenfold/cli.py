"""python -m lumenfold.cli run | compare | generate | sweep | speedup | mae | charts"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.metrics import check_same_points, compare, equalizer, mean_absolute_error
from .plans import benchmark
from .sources import generator, text


def session() -> SparkSession:
    return SparkSession.builder.appName("lumenfold").getOrCreate()


def run(args: argparse.Namespace) -> None:
    spark = session()
    cloud, job = text.read_cloud(spark, args.input, args.precision)
    k, rounds = args.k or job.k, job.rounds if args.rounds is None else args.rounds
    path = text.result_path(args.output, args.algo) if args.plain else text.result_path(args.output, args.algo, job.n, k, rounds, args.precision)
    text.write_result(equalizer(args.algo, k, rounds)(cloud), path)
    print(path)


def compare_files(args: argparse.Namespace) -> None:
    spark = session()
    ints, job = text.read_cloud(spark, args.int_file, "int")
    floats, _ = text.read_cloud(spark, args.float_file, "float")
    compare({"int": ints, "float": floats}, args.k or job.k, job.rounds if args.rounds is None else args.rounds).show(truncate=False)


def generate(args: argparse.Namespace) -> None:
    spark = session()
    for kind in ("int", "float"):
        path = generator.dataset_path(args.output, args.n, args.k, args.rounds, kind)
        text.write_cloud(generator.generate_cloud(spark, args.n, kind, args.seed), path, args.k, args.rounds)
        print(path)


def sweep(args: argparse.Namespace) -> None:
    benchmark.sweep(session(), args.n or benchmark.SWEEP_N, args.k or benchmark.SWEEP_K, args.rounds or benchmark.SWEEP_T, path=args.output)


def speedup(args: argparse.Namespace) -> None:
    benchmark.write_records(benchmark.speedups(benchmark.read_records(session(), args.input)), args.output)


def mae(args: argparse.Namespace) -> None:
    """The mean absolute error of two result files, which must hold the same points in the same order."""
    spark = session()
    one, two = (text.read_result(spark, p, args.precision) for p in (args.result, args.baseline))
    check_same_points(one, two)
    print(f"{mean_absolute_error(one, two).first()['mae']:.6f}")


def charts(args: argparse.Namespace) -> None:
    """The tables behind the charts, from a CSV of records."""
    typed = benchmark.typed_records(benchmark.read_records(session(), args.input))
    for table in (benchmark.scaling_n, benchmark.device_speedup, benchmark.scaling_k, benchmark.precision_impact, benchmark.exact_over_approx):
        print(table.__name__)
        table(typed).show(1000, truncate=False)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lumenfold", description=__doc__)
    sub = out.add_subparsers(required=True)

    def command(name, action, *positional):
        p = sub.add_parser(name)
        p.set_defaults(action=action)
        for x in positional:
            p.add_argument(x)
        return p

    p = command("run", run, "input", "algo")
    p.add_argument("--precision", choices=["int", "float"], default="int")
    p.add_argument("--plain", action="store_true", help="name the output by the algorithm alone")
    for name in ("--k", "--rounds"):
        p.add_argument(name, type=int)
    p.add_argument("--output", default="output")
    p = command("compare", compare_files, "int_file", "float_file")
    for name in ("--k", "--rounds"):
        p.add_argument(name, type=int)
    p = command("generate", generate)
    for name, value in (("--n", 1000000), ("--k", 16), ("--rounds", 50), ("--seed", 42)):
        p.add_argument(name, type=int, default=value)
    p.add_argument("--output", default="input")
    p = command("sweep", sweep)
    for name in ("--n", "--k", "--rounds"):
        p.add_argument(name, type=int, nargs="*")
    p.add_argument("--output", default="benchmark_results")
    p = command("speedup", speedup, "input", "output")
    p = command("mae", mae, "result", "baseline")
    p.add_argument("--precision", choices=["int", "float"], default="int")
    p = command("charts", charts, "input")
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.action(args)


if __name__ == "__main__":
    main()
