"""Command line over a stored archive: ``python -m affidavit.cli COMMAND``; folders come from :mod:`affidavit.config`.

The status is 0, or 2 where a check fails (traces are left after an erasure).
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, settings
from .operators import erase, index, people, practice, rollups, search
from .sources import corpus

ROSTER = "pid string, display string, org string, role string, emails array<string>"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="affidavit", description="Evidence from an archive of texts.")
    out.add_argument("--env", default=".env", help="file of settings")
    commands = out.add_subparsers(dest="command", required=True)
    add = lambda name, text: commands.add_parser(name, help=text)
    add("build", "read the corpus and write the archive's tables")
    add("stats", "numbers of the archive")
    grep = add("grep", "units that hold a literal or a pattern")
    grep.add_argument("pattern")
    grep.add_argument("--regex", action="store_true")
    add("figures", "figures with date and source, oldest first").add_argument("topic", nargs="?")
    line = add("timeline", "the units nearest to a topic, oldest first")
    line.add_argument("topic")
    line.add_argument("--since")
    line.add_argument("--until")
    add("who", "the people that a name may mean").add_argument("name")
    gone = add("erase", "write an archive without a person to a new folder and look for traces; the old one is yours to delete")
    gone.add_argument("name")
    gone.add_argument("--to", required=True)
    gone.add_argument("--mode", choices=["redact", "purge"], default="redact")
    look = add("verify-erasure", "traces of a person's forms in the archive")
    look.add_argument("receipt", help="the receipt that erase printed, as a file")
    ask = add("practice", "a brief for each question of a file (lines of id, tab, question), and ALL.md")
    ask.add_argument("questions")
    ask.add_argument("--out", default="answers")
    ask.add_argument("--only", help="ids, separated by commas")
    return out


def show(rows: DataFrame) -> None:
    """Rows as lines of JSON, each as it arrives."""
    for r in rows.select(F.to_json(F.struct("*"))).toLocalIterator():
        print(r[0])


def main(argv: list[str] | None = None, spark: SparkSession | None = None, config: Config | None = None) -> int:
    """Runs one command; ``spark`` and ``config`` stand in for the session and the settings."""
    args = parser().parse_args(argv)
    at = config or settings(args.env)
    spark = spark or SparkSession.builder.appName("affidavit").getOrCreate()
    if args.command == "build":
        roster = spark.read.schema(ROSTER).json(at.roster) if at.roster else spark.createDataFrame([], ROSTER)
        corpus.build(spark, corpus.scan_corpus(spark, at.corpus), roster).save(at.archive)
    a = corpus.load(spark, at.archive)
    if args.command in ("build", "stats"):
        show(rollups.stats(a.units, a.documents, a.people))
    elif args.command == "grep":
        show(search.search_exact(a.units, args.pattern, args.regex, at.hits))
    elif args.command == "figures":
        show(search.list_figures(a.units, args.topic, at.hits).select("line"))
    elif args.command == "timeline":
        ranks = index.load_or_build(a.units, f"{at.archive}/index", a.units)
        show(search.timeline(a.units, args.topic, args.since, args.until, index=ranks).select("date_text", "unit_id", "score", "text"))
    elif args.command == "who":
        show(people.who_is(a.people, a.units, args.name))
    elif args.command == "erase":
        units, documents, persons, receipt = erase.erase_person(a.units, a.documents, a.people, args.name, args.mode)
        corpus.Archive(units, documents, persons, a.fingerprint).save(args.to)
        row = receipt.first().asDict(recursive=True)
        print(json.dumps(row, ensure_ascii=False))
        return traces(corpus.load(spark, args.to), row["forms"])
    elif args.command == "verify-erasure":
        return traces(a, json.loads(Path(args.receipt).read_text(encoding="utf-8"))["forms"])
    else:
        lines = Path(args.questions).read_text(encoding="utf-8").splitlines()
        asked = dict(line.split("\t", 1) for line in lines if "\t" in line)
        if args.only:
            asked = {k: asked[k] for k in args.only.split(",")}
        done = practice.briefs(a.units, a.documents, asked, parallel=at.parallel)
        out = Path(args.out)
        out.mkdir(parents=True, exist_ok=True)
        for name, brief in done.items():
            (out / f"{name}.md").write_text(brief + "\n", encoding="utf-8")
            (out / f"{name}.json").write_text(json.dumps({"id": name, "question": asked[name], "brief": brief}, ensure_ascii=False), encoding="utf-8")
        (out / "ALL.md").write_text("".join(f"# {name}\n\n{brief}\n\n" for name, brief in done.items()), encoding="utf-8")
    return 0


def traces(a: corpus.Archive, forms: list[str]) -> int:
    """Prints every trace; 2 if there is one."""
    found = erase.verify_erasure(a.units, a.documents, a.people, forms)
    show(found)
    return 0 if found.isEmpty() else 2


if __name__ == "__main__":
    raise SystemExit(main())
