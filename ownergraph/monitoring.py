"""What a run tells of itself: JSON lines with a run's id, errors with a reference, resident memory, and stage samples."""

from __future__ import annotations

import json
import logging
import secrets
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

_PLAIN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}


class JsonLines(logging.Formatter):
    """One JSON object a record: time, level, logger, message, the run's id, and every ``extra`` field beside them."""

    def __init__(self, run_id: str):
        super().__init__()
        self.run_id = run_id

    def format(self, record: logging.LogRecord) -> str:
        out = {
            "ts": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(record.created)) + f".{int(record.msecs):03d}Z", "level": record.levelname,
            "logger": record.name, "message": record.getMessage(), "run_id": self.run_id,
        }
        out |= {k: v for k, v in vars(record).items() if k not in _PLAIN}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out, ensure_ascii=False, default=str)


def start_log(path: str | None = None, level: int = logging.INFO, run_id: str | None = None) -> str:
    """Send the engine's records as JSON lines to a file, or to the terminal; the run's id."""
    run_id = run_id or secrets.token_hex(6)
    handler = logging.FileHandler(path, encoding="utf-8") if path else logging.StreamHandler()
    handler.setFormatter(JsonLines(run_id))
    log = logging.getLogger("ownergraph")
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    log.addHandler(handler)
    log.setLevel(level)
    log.propagate = False
    return run_id


def answered(call: Callable[[], object]) -> tuple[int, object]:
    """Status and body of a call: an unexpected error is logged under a reference of 12 digits and told by it alone."""
    from ownergraph.errors import EngineError, InvalidRequest

    try:
        return 200, call()
    except InvalidRequest as error:
        return 422, {"erro": str(error)}
    except EngineError as error:
        return 503, {"erro": str(error)}
    except Exception:
        reference = secrets.token_hex(6)
        logging.getLogger("ownergraph").exception("unexpected error", extra={"correlacao": reference})
        return 500, {"erro": "erro interno", "correlacao": reference}


def resident_bytes(pid: str = "self", proc: str = "/proc") -> int | None:
    """Resident memory of a process; None, never 0, where it cannot be read."""
    try:
        with open(f"{proc}/{pid}/status", encoding="ascii") as f:
            for line in f:
                if line.startswith("VmRSS:"):
                    return int(line.split()[1]) * 1024
    except (OSError, ValueError, IndexError):
        pass
    return None


def plateau(samples: list[tuple[int, int]], keys: int = 2000, last: int = 6, within: int = 2 << 20) -> bool:
    """Whether memory has settled: after enough different keys, the last samples (keys, bytes) lie close together."""
    tail = [b for k, b in samples if k >= keys][-last:]
    return len(tail) == last and max(tail) - min(tail) <= within


def soak(ask: Callable[[int], object], keys: Iterator[int], every: int = 250, most: int = 20_000) -> tuple[bool, list[tuple[int, int]]]:
    """Ask for many different keys and sample memory; whether it settled, and the samples."""
    samples: list[tuple[int, int]] = []
    for n, key in enumerate(keys, 1):
        ask(key)
        if n % every == 0:
            samples.append((n, resident_bytes() or 0))
            if plateau(samples):
                return True, samples
        if n >= most:
            break
    return False, samples


@dataclass
class Stage:
    name: str
    seconds: float
    entry_bytes: int | None
    peak_bytes: int | None


class Stages:
    """Seconds and peak memory of the stages of a run, sampled by a thread beside it."""

    def __init__(self, interval: float = 0.05):
        self.interval, self.done = interval, []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        over, entry = threading.Event(), resident_bytes()
        peak = [entry]

        def watch() -> None:
            while not over.wait(self.interval):
                peak[0] = max(peak[0] or 0, resident_bytes() or 0) or None

        thread = threading.Thread(target=watch, daemon=True)
        began = time.perf_counter()
        thread.start()
        try:
            yield
        finally:
            over.set()
            thread.join()
            self.done.append(Stage(name, time.perf_counter() - began, entry, peak[0]))

    def report(self) -> str:
        """A Markdown table of the stages."""
        mb = lambda x: "-" if x is None else f"{x / 2**20:.0f} MiB"
        rows = [f"| {s.name} | {s.seconds:.1f} s | {mb(s.entry_bytes)} | {mb(s.peak_bytes)} |" for s in self.done]
        return "\n".join(["| stage | time | entry | peak |", "|---|---|---|---|", *rows])

    def as_rows(self) -> list[dict]:
        return [asdict(s) for s in self.done]
