"""Command line: python -m pixelloom -i FILES [-ref NAME] [-filter NAME k=v ...]... [-with NAME] -o FOLDER[:FORMAT]

Commands run in order. -filter adds an operator, -with NAME takes the image kept
under -ref NAME as the foreground of the next operator of two inputs, -ref keeps
the image so far, -use goes back to one that was kept, and each -o writes.
"""

from __future__ import annotations

import ast
import sys

from pyspark.sql import SparkSession

from pixelloom.plans.pipeline import Pipeline
from pixelloom.sources import images


def value(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return {"true": True, "false": False}.get(text, text)


def parse(args: list[str]) -> list[tuple[str, str, dict]]:
    """(command, argument, parameters) in order."""
    out: list[tuple[str, str, dict]] = []
    i = 0
    while i < len(args):
        if args[i] not in ("-i", "-filter", "-with", "-ref", "-use", "-o") or i + 1 >= len(args):
            raise SystemExit(f"can't read {args[i]}\n\n{__doc__}")
        params = {}
        j = i + 2
        while args[i] == "-filter" and j < len(args) and "=" in args[j] and not args[j].startswith("-"):
            k, _, v = args[j].partition("=")
            params[k] = value(v)
            j += 1
        out.append((args[i][1:], args[i + 1], params))
        i = j
    return out


def main(args: list[str], spark: SparkSession | None = None) -> int:
    commands = parse(args)
    spark = spark or SparkSession.builder.appName("pixelloom").getOrCreate()
    now: Pipeline | None = None
    front: Pipeline | None = None
    kept: dict[str, Pipeline] = {}
    for command, argument, params in commands:
        if command == "i":
            now = Pipeline(images.read(spark, argument).select("image_id", "width", "height", "data").where("data IS NOT NULL"))
        elif command == "use":
            now = kept[argument]
        elif now is None:
            raise SystemExit("give an input with -i first")
        elif command == "ref":
            kept[argument] = now
        elif command == "with":
            front = kept[argument]
        elif command == "filter":
            now, front = now.then(argument, *([front] if front is not None else []), **params), None
        else:
            folder, _, name = argument.rpartition(":") if ":" in argument.rpartition("/")[2] else (argument, "", "png")
            images.write_files(images.encoded(now.images(), name or "png"), folder).count()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
