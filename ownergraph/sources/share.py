"""A public WebDAV share: its periods and files, and the transport that downloads take."""

from __future__ import annotations

import base64
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from ownergraph.errors import IncompletePeriod, TransientFailure
from ownergraph.sources import archives

#: Seconds without an answer.
PATIENCE = 120
_DAV = "{DAV:}"


def entries(answer: bytes) -> list[dict]:
    """``name, folder, size, etag`` of the members that a PROPFIND answer of depth 1 lists, without the folder itself."""
    out = []
    for at, one in enumerate(ET.fromstring(answer).iter(f"{_DAV}response")):
        href = (one.findtext(f"{_DAV}href") or "").rstrip("/")
        size = next((x.text for x in one.iter(f"{_DAV}getcontentlength")), None)
        etag = next((x.text for x in one.iter(f"{_DAV}getetag")), None)
        if at:
            out.append({"name": href.rsplit("/", 1)[-1], "folder": any(True for _ in one.iter(f"{_DAV}collection")), "size": int(size) if size else None, "etag": etag})
    return out


class Share:
    """A share that is opened by its token as the user and an empty password."""

    def __init__(self, url: str, token: str, opener: Callable | None = None):
        self.url = url.rstrip("/")
        self.key = "Basic " + base64.b64encode(f"{token}:".encode()).decode()
        self.opener = opener or (lambda request: urllib.request.urlopen(request, timeout=PATIENCE))

    def _ask(self, path: str, method: str, headers: dict[str, str]):
        request = urllib.request.Request(f"{self.url}/{path}", method=method, headers={"Authorization": self.key} | headers)
        try:
            return self.opener(request)
        except urllib.error.HTTPError as error:
            if error.code in archives.RETRIED:
                raise TransientFailure(f"{path}: status {error.code}") from error
            raise IncompletePeriod(f"{path}: status {error.code}") from error
        except urllib.error.URLError as error:
            raise TransientFailure(f"{path}: {error.reason}") from error

    def list(self, path: str = "") -> list[dict]:
        with self._ask(path, "PROPFIND", {"Depth": "1"}) as answer:
            return entries(answer.read())

    def periods(self) -> list[str]:
        """Folders that are called like periods, ascending."""
        return archives.periods(x["name"] for x in self.list() if x["folder"])

    def files(self, period: str) -> dict[str, tuple[int, str | None]]:
        """Size and ETag of a period's files."""
        return {x["name"]: (x["size"] or 0, x["etag"]) for x in self.list(archives.check_period(period)) if not x["folder"]}

    def transport(self, period: str) -> archives.Transport:
        """What ``archives.download`` takes: whole files, or the rest of one if it is still the same."""

        def fetch(name: str, at: int, etag: str | None) -> tuple[int, bool, Iterator[bytes]]:
            headers = {"Range": f"bytes={at}-"} | ({"If-Range": etag} if etag else {}) if at else {}
            answer = self._ask(f"{period}/{name}", "GET", headers)

            def blocks() -> Iterator[bytes]:
                with answer:
                    while block := answer.read(archives.BLOCK):
                        yield block

            return answer.status, answer.status == 206, blocks()

        return fetch
