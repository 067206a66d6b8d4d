"""``python -m ownergraph.cli``: periods, downloads, extraction, conversion, and registered queries."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from ownergraph import monitoring
from ownergraph.errors import EngineError
from ownergraph.session import build_session
from ownergraph.sources import archives, registry, share

LOG = logging.getLogger("ownergraph.cli")


def progress(done: int, whole: int, name: str, width: int = 28, terminal: bool | None = None) -> str:
    """A bar for a terminal, a plain line elsewhere."""
    terminal = sys.stderr.isatty() if terminal is None else terminal
    part = done / whole if whole else 1.0
    if not terminal:
        return f"{name}: {done} of {whole}"
    return f"\r{name:24.24} [{'#' * int(part * width):{width}}] {part:4.0%}"


def resolve_period(asked: str | None, there: list[str]) -> str:
    """The asked period, or the newest."""
    if asked:
        return archives.check_period(asked)
    if not there:
        raise archives.IncompletePeriod("the share has no period")
    return there[-1]


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="ownergraph", description=__doc__)
    parser.add_argument("--log", help="file for JSON lines")
    steps = parser.add_subparsers(dest="step", required=True)
    for name, text in (("periods", "list the periods of a share"), ("download", "download a period"), ("extract", "unpack archives"), ("convert", "extracts to Parquet"), ("query", "run a registered query")):
        one = steps.add_parser(name, help=text)
        if name in ("periods", "download"):
            one.add_argument("--url", required=True)
            one.add_argument("--token", required=True)
        if name == "download":
            one.add_argument("--period")
        if name in ("download", "extract", "convert"):
            one.add_argument("--folder", required=True)
        if name == "convert":
            one.add_argument("--table", choices=[*registry.TABLES, "principais", "tudo"], default="tudo")
            one.add_argument("--target", required=True)
        if name == "query":
            one.add_argument("name")
            one.add_argument("--input", required=True)
            one.add_argument("--rows", type=int, default=20)
    return parser


def main(args: list[str] | None = None) -> int:
    """0 if the step ended, 1 if it was refused."""
    given = _parser().parse_args(args)
    monitoring.start_log(given.log)
    try:
        if given.step == "periods":
            print("\n".join(share.Share(given.url, given.token).periods()))
        elif given.step == "download":
            source = share.Share(given.url, given.token)
            period = resolve_period(given.period, source.periods())
            files = source.files(period)
            archives.check_files(period, files)
            wanted = {k: files[k] for k in archives.EXPECTED}
            archives.download_period(source.transport(period), wanted, given.folder)
        elif given.step == "extract":
            names = sorted(os.path.join(given.folder, x) for x in os.listdir(given.folder) if x.endswith(".zip"))
            archives.extract_period(names, given.folder)
        elif given.step == "convert":
            spark = build_session()
            for name in registry.chosen(given.table):
                LOG.info("converted", extra={"table": name, "rows": registry.convert_folder(spark, name, given.folder, given.target)})
        else:
            from ownergraph.plans import catalogue

            known = catalogue.queries()
            if given.name not in known:
                raise EngineError(f"no query is called {given.name}; there are {', '.join(sorted(known))}")
            known[given.name](build_session(), given.input).show(given.rows, truncate=False)
    except EngineError as error:
        LOG.error(str(error))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
