"""Command line: ``python -m lodestone VERB ...`` (extract, inspect, starter, index, boundaries, verify-index, manifest, transforms)."""

from __future__ import annotations

import argparse
import contextlib
import json
import sys


def artifacts_ladder() -> tuple[str, ...]:
    from lodestone.operators.artifacts import LADDER

    return LADDER


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lodestone")
    verbs = p.add_subparsers(dest="verb", required=True)
    x = verbs.add_parser("extract", help="run a recipe workspace over files")
    x.add_argument("workspace")
    x.add_argument("input", nargs="*", help="files, folders or patterns")
    x.add_argument("--file-list", help="a list of inputs, with sizes and digests where declared")
    x.add_argument("--out", help="where the output goes; not needed for stdout")
    x.add_argument("--format", choices=("ndjson", "shards", "parquet", "stdout"), default="ndjson")
    x.add_argument("--validate-output", choices=artifacts_ladder(), default="off", help="checks of written shards, each with all before it")
    x.add_argument("--events", help="a file for the events of the run, one JSON object a line")
    x.add_argument("--rows", type=int)
    x.add_argument("--bytes", type=int)
    x.add_argument("--param", action="append", default=[], metavar="NAME=VALUE", help="repeat a name for a list")
    for name, text in (("inspect", "paths of documents"), ("starter", "a recipe to start from")):
        v = verbs.add_parser(name, help=text)
        v.add_argument("input", nargs="+")
        v.add_argument("--format", choices=("xml", "json", "ndjson"), default="xml")
    i = verbs.add_parser("index", help="byte ranges of records")
    i.add_argument("input", nargs="+")
    i.add_argument("--record", required=True)
    i.add_argument("--format", choices=("xml", "json", "ndjson"), default="xml")
    i.add_argument("--out", required=True)
    b = verbs.add_parser("boundaries", help="records of large files: counts, sizes, offsets, the largest ones")
    b.add_argument("input", nargs="+")
    b.add_argument("--record", required=True)
    b.add_argument("--format", choices=("xml", "json", "ndjson"), default="xml")
    b.add_argument("--max-records", type=int, help="the first records of each file only")
    verbs.add_parser("verify-index", help="check an index against its files").add_argument("index")
    verbs.add_parser("manifest", help="sizes and digests of files").add_argument("input", nargs="+")
    verbs.add_parser("transforms", help="the field transforms")
    return p


def parameters(given: list[str]) -> dict[str, str | list[str]]:
    """NAME=VALUE pairs; a name that is repeated is a list."""
    out: dict[str, str | list[str]] = {}
    for g in given:
        name, eq, value = g.partition("=")
        if not eq or not name:
            raise SystemExit(f"bad parameter {g!r}")
        had = out.get(name)
        out[name] = value if had is None else [*(had if isinstance(had, list) else [had]), value]
    return out


def extract(a, e) -> int:
    """Writes an extraction; 1 where an input has failed."""
    from lodestone.operators import profile, sinks
    from lodestone.plans.extract import envelope

    if a.format == "stdout":
        order = [c for c in ("input_ordinal", "source_file") if c in e.keys]
        for r in envelope(e).orderBy(*order, "record_num").select("value").toLocalIterator():
            print(r["value"])
        failed = [r.asDict() for r in e.dispositions.where("disposition = 'failed'").limit(1000).collect()]
        for r in failed:
            print(json.dumps(r, default=str), file=sys.stderr)
        return 1 if failed else 0
    m = None
    if a.format == "ndjson":
        sinks.write_ndjson(e, f"{a.out}/records")
    elif a.format == "parquet":
        sinks.write_parquet(e, f"{a.out}/records", e.recipe.parquet.get("compression") or "zstd", e.recipe.parquet.get("withhold_columns"))
    else:
        m = sinks.write_shards(e, a.out, a.rows, a.bytes)
    sinks.write_dispositions(e, a.out)
    if m is None:
        m = sinks.manifest_of(e)
        shown = profile.run_profile(e)
        m |= {"value_profile": shown} if shown else {}
        sinks.write_json(e.rows, f"{a.out}/manifest", m)
    print(json.dumps(m))
    bad = []
    if a.format == "shards":
        from lodestone.operators import artifacts

        sinks.write_json(e.rows, f"{a.out}/artifact", artifacts.descriptor(e, a.out, "ndjson"))
        bad = [r.asDict() for r in artifacts.validate_output(e.rows.sparkSession, a.out, a.validate_output).limit(1000).collect()]
        for r in bad:
            print(json.dumps(r), file=sys.stderr)
    return 1 if m["inputs_failed"] or bad else 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.verb == "transforms":
        from lodestone.functions.transforms import describe

        for row in describe():
            print("\t".join(row))
        return 0
    from pyspark.sql import SparkSession

    from lodestone.operators import artifacts, index, inspect
    from lodestone.plans.extract import run_workspace
    from lodestone.sources.inputs import parse_file_list, read_list
    from lodestone.sources.scan import listed, read_files
    from lodestone.streaming.files import Watched

    spark = SparkSession.builder.getOrCreate()
    if a.verb == "extract":
        if bool(a.input) == bool(a.file_list):
            raise SystemExit("give either inputs or a file list")
        if not a.out and a.format != "stdout":
            raise SystemExit("--out is missing")
        if a.validate_output != "off" and a.format != "shards":
            raise SystemExit("--validate-output checks shards")
        with contextlib.ExitStack() as stack:
            if a.events:
                log = stack.enter_context(open(a.events, "a", buffering=1))  # the driver's own file
                stack.enter_context(Watched(spark, lambda line: print(line, file=log)))
            inputs = a.input
            if a.file_list:
                text = spark.read.text(a.file_list, wholetext=True).first()
                inputs = read_list(spark, parse_file_list(text[0] if text else ""))
            return extract(a, run_workspace(spark, a.workspace, inputs, parameters(a.param)))
    if a.verb == "boundaries":
        records = index.build(listed(spark, a.input), a.record, a.format, a.max_records)
        for r in inspect.boundaries(records).orderBy("source_file").toLocalIterator():
            print(json.dumps(r.asDict()))
        for r in inspect.largest(records).collect():
            print(json.dumps(r.asDict()))
        return 0
    if a.verb == "inspect":
        for r in inspect.path_report(inspect.paths(read_files(spark, a.input), a.format)).toLocalIterator():
            print(json.dumps(r.asDict(), default=str))
    elif a.verb == "starter":
        print(json.dumps(inspect.starter_recipe(read_files(spark, a.input), a.format), indent=2))
    elif a.verb == "index":
        index.build(listed(spark, a.input), a.record, a.format).write.parquet(a.out)
    elif a.verb == "verify-index":
        bad = [r.asDict() for r in index.verify(index.load(spark, a.index)).limit(1000).collect()]
        for r in bad:
            print(json.dumps(r))
        return 1 if bad else 0
    else:
        for r in artifacts.build_manifest(read_files(spark, a.input)).toLocalIterator():
            print(json.dumps(r.asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
