"""python -m gneiss analyze|evolution|init PATH"""

from __future__ import annotations

import argparse

from gneiss.plans import report
from gneiss.plans.analyze import analyze, evolution
from gneiss.plans.config import Config
from gneiss.session import session


def main() -> None:
    p = argparse.ArgumentParser(prog="gneiss")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("path")
    a.add_argument("--config")
    a.add_argument("--out", default="report.html")
    a.add_argument("--as-of", type=int)
    e = sub.add_parser("evolution")
    e.add_argument("path")
    e.add_argument("--months", type=int, default=6)
    e.add_argument("--interval", type=int, default=30)
    i = sub.add_parser("init")
    i.add_argument("path", nargs="?", default="gneiss.json")
    args = p.parse_args()
    if args.command == "init":
        Config().create(args.path)
    elif args.command == "analyze":
        report.page(analyze(session(), args.path, Config.load(args.config), args.as_of), args.out)
    else:
        for line in report.evolution_lines(*evolution(session(), args.path, Config(months=args.months, interval_days=args.interval))):
            print(line)


if __name__ == "__main__":
    main()
