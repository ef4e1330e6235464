"""Command line: python -m tidemark.cli --project-dir DIR {init,plan,maintain,watch,dev}."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .orchestrator import Orchestrator, describe
from .project import ProjectError, load_directory
from .streaming.watch import watch

_SETUP = '''"""What this project works on."""


def catalogs():
    return {"dl": "data"}
'''


def _session() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()


def _started(folder: Path) -> Orchestrator:
    made = load_directory(_session(), folder)
    made.verify()
    made.initialize()
    return made


def init(folder: Path) -> int:
    (folder / "catalogs" / "dl").mkdir(parents=True, exist_ok=True)
    if (folder / "setup.py").exists():
        print(f"{folder / 'setup.py'} exists", file=sys.stderr)
        return 1
    (folder / "setup.py").write_text(_SETUP, encoding="utf-8")
    print(f"project in {folder}")
    return 0


def plan(folder: Path) -> int:
    errors: list[ProjectError] = []
    made = load_directory(_session(), folder, errors)
    for depth, level in enumerate(made.levels()):
        for key in level:
            view = made.views.get(key)
            print(f"{depth} {key}: " + (f"{view.strategy}" + (f" ({view.fallback_reason})" if view.fallback_reason else "") + f", reads {', '.join(view.base_tables)}" if view else "not compiled"))
    for e in errors:
        print(f"error: {e}", file=sys.stderr)
    return int(bool(errors))


def maintain(folder: Path) -> int:
    made = _started(folder)
    print(made.tree())
    for step in made.maintain(detail_level="cursor_distance"):
        print(describe(step))
    return 0


def dev(folder: Path, interval: float, rounds: int | None = None) -> int:
    """Shows up to 20 rows of each view whose file is new or changed."""
    seen: dict[Path, float] = {}
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        changed = {f for f in (folder / "catalogs").rglob("*.sql") if seen.get(f) != f.stat().st_mtime}
        if changed:
            seen |= {f: f.stat().st_mtime for f in changed}
            errors: list[ProjectError] = []
            made = load_directory(_session(), folder, errors)
            for key, view in made.views.items():
                if any(f.stem == view.name for f in changed):
                    print(key)
                    view.recompute().show(20)
            for e in errors:
                print(f"error: {e}", file=sys.stderr)
        time.sleep(interval)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("--project-dir", type=Path, default=Path())
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    commands.add_parser("plan")
    commands.add_parser("maintain").add_argument("--plain", action="store_true")
    for name in ("watch", "dev"):
        sub = commands.add_parser(name)
        sub.add_argument("--polling-interval", type=float, default=5.0)
        sub.add_argument("--rounds", type=int, default=None)
        if name == "watch":
            sub.add_argument("--plain", action="store_true")
    args = parser.parse_args(argv)
    try:
        if args.command == "watch":
            for steps in watch(_started(args.project_dir), args.polling_interval, args.rounds):
                for step in steps:
                    print(describe(step), flush=True)
            return 0
        if args.command == "dev":
            return dev(args.project_dir, args.polling_interval, args.rounds)
        return {"init": init, "plan": plan, "maintain": maintain}[args.command](args.project_dir)
    except ProjectError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
