"""python -m cadenza activity | fingerprint | load | query | list; exit codes 0 (done), 1 (error), 130 (interrupted)."""

from __future__ import annotations

import argparse
import json
import sys

from cadenza.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cadenza")
    p.add_argument("--master", default="local[*]")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("activity", help="daily activity from user-log CSV files")
    c.add_argument("--files", nargs="+", required=True)
    c.add_argument("--output-dir", required=True)
    c.add_argument("--raw-dir", default=".", help="where files given by name alone are")
    c.add_argument("--max-rows", type=int)
    c.add_argument("--keep-partials", action="store_true")
    how = c.add_mutually_exclusive_group()
    how.add_argument("--resume", action="store_true")
    how.add_argument("--restart", action="store_true")
    c = commands.add_parser("fingerprint", help="size, time and SHA-256 of files")
    c.add_argument("--files", nargs="+", required=True)
    c.add_argument("--chunk-size-mib", type=int, default=4)
    c = commands.add_parser("load", help="validate and type a CSV file; written as Parquet only with --execute")
    c.add_argument("kind", choices=["members", "labels", "transactions"])
    c.add_argument("--file", required=True)
    c.add_argument("--key", type=int, required=True)
    c.add_argument("--cohort")
    c.add_argument("--output")
    c.add_argument("--execute", action="store_true")
    c = commands.add_parser("query", help="run a query of the catalog over a folder of tables")
    c.add_argument("name")
    c.add_argument("folder")
    c.add_argument("--rows", type=int, default=100)
    commands.add_parser("list", help="names of the queries")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "fingerprint":
            from cadenza.sources.files import fingerprint

            for f in a.files:
                print(json.dumps(fingerprint(f, a.chunk_size_mib << 20), default=str))
            return 0
        from cadenza import catalog

        if a.command == "list":
            print("\n".join(catalog.QUERIES))
            return 0
        spark = build_session(a.master)
        if a.command == "activity":
            from cadenza.sources.files import resolved
            from cadenza.streaming.activity import run

            print(json.dumps(run(spark, resolved(a.files, a.raw_dir), a.output_dir, a.max_rows, a.resume, a.restart, a.keep_partials), default=str))
        elif a.command == "load":
            from cadenza.sources.files import load

            rows = load(spark, a.file, a.kind, a.key, a.cohort)
            if a.execute:
                rows.write.mode("errorifexists").parquet(a.output)
            print(json.dumps({"file": a.file, "written": a.execute}))
        else:
            catalog.QUERIES[a.name](spark, a.folder).show(a.rows, truncate=False)
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
