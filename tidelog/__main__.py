"""Command line: ``python -m tidelog -f pipeline.conf`` runs a pipeline text as streams.

SIGHUP reads the file again; an invalid text keeps the running one."""

from __future__ import annotations

import argparse
import logging
import signal
import sys
import threading
from pathlib import Path

VERSION = "0.1.0"


class _Console(logging.Handler):
    """Records below WARNING to standard output, others to standard error, with the time."""

    def emit(self, record: logging.LogRecord) -> None:
        out = sys.stdout if record.levelno < logging.WARNING else sys.stderr
        print(self.format(record), file=out, flush=True)


def logging_to(quiet: bool, path: str | None) -> logging.Logger:
    logger = logging.getLogger("tidelog")
    logger.setLevel(logging.INFO)
    logger.handlers = []
    if not quiet:
        console = _Console()
        console.setFormatter(logging.Formatter("%(asctime)s %(message)s", "%H:%M:%S"))
        logger.addHandler(console)
    if path:
        file = logging.FileHandler(path)
        file.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s", "%Y-%m-%dT%H:%M:%S"))
        logger.addHandler(file)
    return logger


def main(argv: list[str] | None = None, spark=None, running: threading.Event | None = None) -> int:
    p = argparse.ArgumentParser("tidelog", description="Runs a log pipeline on Spark.")
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("-f", "--config-file", help="read the pipeline from a file")
    what.add_argument("-c", "--config", help="the pipeline's text")
    p.add_argument("-t", "--test", action="store_true", help="check the pipeline and end")
    p.add_argument("-q", "--quiet", action="store_true", help="don't log to the console")
    p.add_argument("-l", "--log", help="log to a file, too")
    p.add_argument("--dump-plan", action="store_true", help="print the canonical text and end")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    args = p.parse_args(argv)
    logger = logging_to(args.quiet, args.log)

    from .plans.commands import read_program
    from .plans.language import ConfigError

    source = args.config_file or "arg"
    text = lambda: Path(args.config_file).read_text() if args.config_file else args.config
    try:
        program = read_program(text(), source)
    except (ConfigError, OSError) as e:
        logger.error("%s", e)
        return 1
    if args.dump_plan:
        print(program.canonical(), end="")
        return 0
    if args.test:
        logger.info("the pipeline is valid")
        return 0

    from pyspark.sql import SparkSession

    from .streaming.engine import Engine

    engine = Engine(spark or SparkSession.builder.appName("tidelog").getOrCreate(), text()).start()
    stop = running or threading.Event()
    if threading.current_thread() is threading.main_thread():
        signal.signal(signal.SIGHUP, lambda *_: engine.reload(text()))
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: stop.set())
    stop.wait()
    engine.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
