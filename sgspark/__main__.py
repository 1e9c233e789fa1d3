"""Command line: ``python -m sgspark COMMAND ...``."""

from __future__ import annotations

import argparse
import sys

from sgspark import fits
from sgspark.session import builder


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sgspark", description="Statistical genetics on Spark")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *options: tuple) -> None:
        sub = commands.add_parser(name, help=text)
        for flags, more in options:
            sub.add_argument(*flags, **more)

    out = (("--out",), {"required": True, "help": "folder of the result, which must not be there"})
    text = (("--text",), {"action": "store_true", "help": "a table of text instead of Parquet"})
    fit = [(("--ldscores",), {"required": True}), (("--annot",), {}), (("--blocks",), {"type": int, "default": 200}), (("--method",), {"choices": ("he", "ldsc"), "default": "he"})]
    command("queries", "names of the named queries")
    command("run", "a named query over a folder of tables", (("name",), {}), (("--tables",), {"required": True}), out, text)
    command("h2", "heritability", (("--sumstats",), {"required": True}), (("--trait",), {"default": "trait"}), (("--chisq-max",), {"type": float}), *fit, out, text)
    command("rg", "genetic correlation", (("--sumstats",), {"required": True, "nargs": 2}), (("--overlap-covariance",), {"type": float, "required": True}), *fit, out, text)
    command("h2-batch", "heritabilities of a manifest, resumed where it stopped", (("--manifest",), {"required": True}), (("--out",), {"required": True}))
    command("rg-batch", "genetic correlations of a manifest, resumed where it stopped", (("--manifest",), {"required": True}), *fit, (("--out",), {"required": True}))
    return top


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command == "queries":
        from sgspark.plans.registry import QUERIES

        print("\n".join(sorted(QUERIES)))
        return 0
    spark = builder().getOrCreate()
    if a.command == "run":
        from sgspark.plans.registry import QUERIES

        if a.name not in QUERIES:
            print(f"no query {a.name}", file=sys.stderr)
            return 2
        fits.publish(QUERIES[a.name](spark, a.tables), a.out, a.text)
    elif a.command == "h2":
        fits.publish(fits.h2(spark, a.sumstats, a.ldscores, a.annot, a.blocks, a.method, a.trait, a.chisq_max), a.out, a.text)
    elif a.command == "rg":
        fits.publish(fits.rg(spark, *a.sumstats, a.ldscores, a.overlap_covariance, a.annot, a.blocks, a.method), a.out, a.text)
    elif a.command == "h2-batch":
        print("\n".join(fits.h2_batch(spark, a.manifest, a.out)))
    else:
        print("\n".join(fits.rg_batch(spark, a.manifest, a.ldscores, a.out, a.annot, a.blocks, a.method)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
