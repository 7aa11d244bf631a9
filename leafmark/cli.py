"""Command lines: `extract` a folder, `package` files for an assistant."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from leafmark.operators import export
from leafmark.sources import ocr


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: nothing usable; 2: a library is missing or the arguments are wrong."""
    parser = argparse.ArgumentParser(prog="leafmark")
    sub = parser.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract")
    e.add_argument("source", nargs="?")
    e.add_argument("-o", "--output")
    e.add_argument("--force-ocr", action="store_true")
    e.add_argument("--skip-existing", action=argparse.BooleanOptionalAction, default=True)
    e.add_argument("--workers", type=int, default=max(1, (os.cpu_count() or 2) - 1))
    p = sub.add_parser("package")
    p.add_argument("files", nargs="*")
    p.add_argument("--list", action="store_true")
    p.add_argument("--target", choices=sorted(export.TARGETS))
    p.add_argument("--name", default="untitled")
    p.add_argument("--description", default="")
    p.add_argument("--out", default=".")
    a = parser.parse_args(argv)
    if a.command == "package":
        if a.list or not a.target:
            for t in export.TARGETS.values():
                print(f"{t.id}: {t.display_name}")
            return 0
        try:
            print(export.build_package(a.target, a.name, a.description or export.default_description(a.files), [Path(f) for f in a.files], Path(a.out)))
        except (ValueError, FileNotFoundError) as x:
            print(x, file=sys.stderr)
            return 1
        return 0
    source = a.source or input("Folder: ").strip()
    if not Path(source).is_dir():
        print(f"not a folder: {source}", file=sys.stderr)
        return 1
    kinds = {p.suffix.lower()[1:] for p in Path(source).iterdir()} & {"pdf", "epub"}
    lacking = ocr.missing(kinds | ({"ocr"} if a.force_ocr and "pdf" in kinds else set()))
    if lacking:
        print("missing libraries: " + ", ".join(lacking), file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from leafmark.plans.run import run_folder

    spark = SparkSession.builder.master(f"local[{a.workers}]").appName("leafmark").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    out = a.output or str(Path(source) / "extracted")
    reader = ocr.of_folder(str(Path(source).resolve())) if "pdf" in kinds and not ocr.missing({"pdf", "ocr"}) else None
    results = run_folder(spark, source, out, a.force_ocr, a.skip_existing, ocr=reader)
    if results is None:
        print("No PDF or EPUB files found.")
        return 1
    print(f"{results.count()} documents -> {out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
