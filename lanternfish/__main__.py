"""Command line: ``python -m lanternfish VERB ...``; exit codes are the verdicts."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from . import api
from .operators import inventory, scan
from .session import build_session
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lanternfish")
    verbs = top.add_subparsers(dest="verb", required=True)
    for name in ("scan", "verify", "gate", "redact"):
        p = verbs.add_parser(name)
        p.add_argument("paths", nargs="+")
        if name == "scan":
            p.add_argument("--sarif", action="store_true")
        if name == "redact":
            p.add_argument("--apply", action="store_true")
    p = verbs.add_parser("session-end")
    p.add_argument("store")
    p.add_argument("--session")
    p.add_argument("--out", required=True)
    p = verbs.add_parser("verify-publish")
    p.add_argument("export_dir")
    p.add_argument("--verdicts")
    p = verbs.add_parser("clean-up")
    p.add_argument("store")
    p.add_argument("--config")
    p.add_argument("--judge", default="none")
    p.add_argument("--apply", action="store_true")
    p = verbs.add_parser("snapshot")
    p.add_argument("root")
    p.add_argument("out")
    p.add_argument("--exclude", nargs="*", default=[])
    p = verbs.add_parser("verify-snapshot")
    p.add_argument("folder")
    p = verbs.add_parser("restore")
    p.add_argument("folder")
    p.add_argument("target")
    p.add_argument("--apply", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session()
    show = lambda df: [print(x) for x in df.toJSON().toLocalIterator()]
    if a.verb == "scan":
        listed, findings = api.scan_paths(spark, *a.paths)
        show(scan.sarif_log(findings).select("log") if a.sarif else scan.ordered(findings))
        show(scan.report(listed, findings))
    elif a.verb in ("verify", "gate"):
        return (api.verify if a.verb == "verify" else api.gate)(spark, *a.paths)
    elif a.verb == "redact":
        texts, cells = api.plan_redaction(spark, *a.paths)
        show(texts.select("file", "edits"))
        show(cells.select("file", "location", "edits"))
        if a.apply:
            print(api.apply_redaction(texts.cache(), cells.cache()))
    elif a.verb == "session-end":
        stdin = "" if sys.stdin.isatty() else sys.stdin.read(1 << 20)
        session, _ = api.which_session(a.session, stdin, {}, lambda: api.latest_session(spark, a.store))
        print(api.session_end(spark, a.store, session, a.out))
    elif a.verb == "verify-publish":
        rows, overall = api.verify_publish(spark, a.export_dir, a.verdicts)
        show(rows)
        show(overall)
        return 0 if overall.first()["publication_status"] != "BLOCKED" else 1
    elif a.verb == "clean-up":
        rules = inventory.Rules.load(Path(a.config).read_text() if a.config else None)
        fates, plan = api.cleanup_plan(spark, a.store, time.time(), rules, api.make_judge(a.judge, rules.judge_statement))
        print(api.plan_summary(fates, plan, a.apply))
        if a.apply:
            print(api.clean_up(plan, a.store))
    elif a.verb == "snapshot":
        print(api.snapshot(spark, a.root, a.out, a.exclude))
    elif a.verb == "verify-snapshot":
        one = api.verify_snapshot(spark, a.folder).first()
        print(one.asDict())
        return 0 if one["ok"] else 1
    else:
        print(sinks.restore(api.Path(a.folder), api.Path(a.target), dry_run=not a.apply))
    return 0


if __name__ == "__main__":
    sys.exit(main())
