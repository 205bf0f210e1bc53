"""python -m turnlake.cli NAME TABLES OUT: run a catalogue query and write its rows as Parquet.
python -m turnlake.cli report EVENTS.jsonl [--records PATH] [--k N] [--subcut] [--out PATH]: print an event
file's metrics as JSON; --records adds regions, --subcut (records with pieces) the cut of calls into
name and arguments, --out writes the whole report: prompts as JSON lines at PATH, the rest at PATH.json.
python -m turnlake.cli freeze DIR MANIFEST | verify DIR MANIFEST: manifests of frozen files."""

from __future__ import annotations

import argparse
import json
import sys

from turnlake.operators import integrity, reporting
from turnlake.plans import queries
from turnlake.session import session
from turnlake.sources import readers, writers


SUMMARY = ("flat", "ci", "region_alpha", "region_n_verified", "subcut_alpha", "subcut_n_verified")


def report(spark, args: list[str]) -> None:
    ap = argparse.ArgumentParser("turnlake.cli report")
    ap.add_argument("events")
    ap.add_argument("--records")
    ap.add_argument("--k", type=int)
    ap.add_argument("--subcut", action="store_true")
    ap.add_argument("--out")
    a = ap.parse_args(args)
    if a.subcut and not a.records:
        ap.error("--subcut needs --records")
    records = readers.records(spark, a.records) if a.records else None
    got = reporting.full_report(readers.events(spark, a.events), records, a.k, pieces="pieces" if a.subcut else None)
    print(json.dumps({k: got[k] for k in SUMMARY if k in got}, indent=2))
    if a.out:
        writers.report_json(got, a.out)


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    spark = session()
    if args[0] == "report":
        report(spark, args[1:])
    elif args[0] == "freeze":
        integrity.manifest(spark, args[1]).coalesce(1).write.mode("overwrite").json(args[2])
    elif args[0] == "verify":
        found = integrity.verify_manifest(integrity.manifest(spark, args[1]), spark.read.schema("file string, sha256 string, bytes long").json(args[2])).collect()
        print(*(f"{r.check}: {r.item}" for r in found), sep="\n")
        return int(bool(found))
    else:
        queries.catalogue()[args[0]](spark, args[1]).write.mode("overwrite").parquet(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
