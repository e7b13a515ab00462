"""Command line: ``python -m quire [--scratch DIR] <command> ...``.

``--scratch`` is a folder that the driver and all executors share (the
``spark.checkpoint.dir`` of the session, if that is not set otherwise);
``--config`` is a JSON file with the sources and their limits.

  harvest  --landing DIR --ledger DIR --drops DIR [--batch-id ID] [--min-new N] [--config FILE]
  load     --drops DIR --table DIR --log DIR [--archive DIR] [--on-ragged load|reject]
  cycle    --root DIR --landing DIR [--config FILE]   (harvest stream, then load stream and archive)
  list     --table DIR [--skip N --take N --keyword K --site S --sort C --order asc|desc]
  history  --log DIR [--top N]
"""

from __future__ import annotations

import argparse
import json
import sys


def _config(path: str | None, default: dict) -> dict:
    """The harvest configuration: a JSON file over the shipped values."""
    if not path:
        return dict(default)
    with open(path, encoding="utf-8") as f:
        return {**default, **json.load(f)}


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="quire")
    ap.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    ap.add_argument("--scratch", default=None, help="shared folder for staged data")
    sub = ap.add_subparsers(dest="cmd", required=True)
    h = sub.add_parser("harvest")
    h.add_argument("--landing", required=True)
    h.add_argument("--ledger", required=True)
    h.add_argument("--drops", required=True)
    h.add_argument("--batch-id", default=None)
    h.add_argument("--min-new", type=int, default=None)
    h.add_argument("--config", default=None)
    lo = sub.add_parser("load")
    lo.add_argument("--drops", required=True)
    lo.add_argument("--table", required=True)
    lo.add_argument("--log", required=True)
    lo.add_argument("--archive", default=None)
    lo.add_argument("--on-ragged", choices=["load", "reject"], default="load")
    cy = sub.add_parser("cycle")
    cy.add_argument("--root", required=True)
    cy.add_argument("--landing", required=True)
    cy.add_argument("--config", default=None)
    li = sub.add_parser("list")
    li.add_argument("--table", required=True)
    for name, typ in (("--skip", int), ("--take", int)):
        li.add_argument(name, type=typ, default=None)
    for name in ("--keyword", "--site", "--sort", "--order"):
        li.add_argument(name, default=None)
    hi = sub.add_parser("history")
    hi.add_argument("--log", required=True)
    hi.add_argument("--top", type=int, default=500)
    a = ap.parse_args(argv)

    from quire.session import build_session
    spark = build_session(a.master, extra={"spark.checkpoint.dir": a.scratch} if a.scratch else None)
    if a.cmd == "harvest":
        from quire.plans.harvest_run import DEFAULT_CONFIG, run_harvest
        from quire.sources.ledger import read_ledger
        from quire.sources.payloads import read_payloads
        cfg = _config(a.config, DEFAULT_CONFIG)
        if a.min_new is not None:
            cfg["min_new_papers"] = a.min_new
        path, summary = run_harvest(read_payloads(spark, a.landing), read_ledger(spark, a.ledger),
                                    a.ledger, a.drops, a.batch_id, cfg)
        print(json.dumps({"drop": path, "summary": [r.asDict() for r in summary.collect()]}))
    elif a.cmd == "load":
        from quire.plans.load_run import run_load
        out = run_load(spark, a.drops, a.table, a.log, archive_dir=a.archive, on_ragged=a.on_ragged)
        print(json.dumps({"files": out.files, "loaded_rows": out.loaded_rows}))
    elif a.cmd == "cycle":
        from quire.plans.harvest_run import DEFAULT_CONFIG
        from quire.streaming.cycle import run_cycle
        run_cycle(spark, a.root, a.landing, config=_config(a.config, DEFAULT_CONFIG))
    elif a.cmd == "list":
        from quire.operators.query import fetch_page
        from quire.sources.tables import read_papers
        kw = {k: v for k, v in vars(a).items()
              if k in ("skip", "take", "keyword", "site", "sort", "order") and v is not None}
        print(json.dumps(fetch_page(read_papers(spark, a.table), **kw), default=str))
    elif a.cmd == "history":
        from quire.operators.query import latest_loads, load_stats
        from quire.sources.tables import read_load_log
        log = read_load_log(spark, a.log)
        print(json.dumps({"stats": load_stats(log).first().asDict(),
                          "rows": [r.asDict() for r in latest_loads(log, a.top).collect()]},
                         default=str))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
