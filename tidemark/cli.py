"""Command line: ``python -m tidemark.cli TASK --base FOLDER``."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession

from tidemark.operators.quality import GateError
from tidemark.operators.reconcile import Unequal
from tidemark.session import local_session
from tidemark.streaming.pipeline import Config, Pipeline
from tidemark.streaming.replayer import ReplayStarted

TASKS = ("setup", "prepare", "replay", "bronze", "silver", "scd2", "gate", "gold", "mart", "reconcile", "run-local", "run", "history")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("task", choices=TASKS)
    p.add_argument("--base", required=True, help="folder of landing, bronze, tables and checkpoints; shared by all executors")
    p.add_argument("--backfill", type=dt.date.fromisoformat, default=dt.date(2024, 3, 31), help="last day of the first delivery")
    p.add_argument("--allowed-days", type=int, default=3)
    p.add_argument("--max-bad-ratio", type=float, default=0.05)
    p.add_argument("--buckets", type=int, default=8)
    p.add_argument("--run-id", help="names what the run writes in metrics, quarantine and logs")
    p.add_argument("--replay-days", type=int, default=10, help="days after the backfill that a replay delivers")
    p.add_argument("--poison-date", type=dt.date.fromisoformat, help="a day of the replay on which many prices are bad")
    p.add_argument("--batch-date", default="next", help="the day that replay delivers: 'next', or a date")
    p.add_argument("--force", action="store_true", help="prepare a replay anew though days of it were delivered")
    p.add_argument("--full", action="store_true", help="rebuild derived tables instead of refreshing them")
    p.add_argument("--table", help="table whose history is shown")
    p.add_argument("--local", action="store_true", help="make a local session instead of taking the cluster's")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if the task ran, 2 if the gate blocked, 3 if reconciliation found a difference, 4 if a replay is under way."""
    a = parser().parse_args(argv)
    spark = spark or (local_session() if a.local else SparkSession.builder.getOrCreate())
    named = {"run_id": a.run_id} if a.run_id else {}
    p = Pipeline(spark, Config(a.base, a.backfill, a.allowed_days, a.max_bad_ratio, a.buckets, replay_days=a.replay_days, poison=a.poison_date, **named))
    try:
        if a.task == "gold":
            p.gold(a.full)
        elif a.task == "prepare":
            p.prepare(a.force)
        elif a.task == "replay":
            day = p.replay_next(None if a.batch_date == "next" else dt.date.fromisoformat(a.batch_date))
            print(f"delivered {day}" if day else "every day was delivered")
        elif a.task == "run-local":
            for day, outcome in p.run_local():
                print(f"{day}: {outcome}")
        elif a.task == "history":
            p.store.history(a.table).orderBy("version").show(100, False)
        else:
            getattr(p, a.task)()
    except GateError as e:
        print(f"blocked: {e}", file=sys.stderr)
        return 2
    except Unequal as e:
        print(f"unequal: {e}", file=sys.stderr)
        return 3
    except ReplayStarted as e:
        print(f"refused: {e}", file=sys.stderr)
        return 4
    return 0


if __name__ == "__main__":
    sys.exit(main())
