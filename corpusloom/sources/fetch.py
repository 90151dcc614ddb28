"""Polite download of public documents: the only part that uses the network, on the driver, one host after another.

Every hop of a redirect is checked again against the official hosts and the
site's robots rules; the body is read up to a limit.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from urllib.robotparser import RobotFileParser

from corpusloom.sources.files import LIMIT
from corpusloom.sources.manifest import HOSTS

HOPS = 5
AGENT = "corpusloom/0.1 (public-document research)"
Response = tuple[int, dict[str, str], bytes]


def official(url: str, regulator: str) -> bool:
    u = urllib.parse.urlsplit(url)
    return u.scheme == "https" and u.hostname in HOSTS[regulator] and not u.username and not u.password and u.port in (None, 443)


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def http_get(url: str, limit: int = LIMIT) -> Response:
    """Status, headers and at most limit + 1 bytes; redirects aren't followed."""
    opener = urllib.request.build_opener(_Stay)
    try:
        with opener.open(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=60) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read(limit + 1)
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, b""


def fetch(url: str, regulator: str, allowed: Callable[[str], bool] = lambda url: True, get: Callable[[str], Response] = http_get, limit: int = LIMIT) -> tuple[bytes, str]:
    """Content and final URL."""
    for _ in range(HOPS):
        if not official(url, regulator) or not allowed(url):
            raise ValueError(f"not permitted: {url}")
        status, headers, body = get(url)
        if 300 <= status < 400 and "location" in headers:
            url = urllib.parse.urljoin(url, headers["location"])
            continue
        if status >= 400:
            raise ValueError(f"HTTP {status} for {url}")
        if len(body) > limit:
            raise ValueError("document is larger than the limit")
        return body, url
    raise ValueError("too many redirects")


class Robots:
    """Robots rules per host: none if the file is missing, an error if it redirects."""

    def __init__(self, get: Callable[[str], Response] = http_get):
        self.get, self.known = get, {}

    def rules(self, url: str) -> RobotFileParser:
        u = urllib.parse.urlsplit(url)
        if u.netloc not in self.known:
            parser = RobotFileParser()
            status, _, body = self.get(f"{u.scheme}://{u.netloc}/robots.txt")
            if status == 404:
                parser.parse([])
            elif status >= 300:
                raise ValueError(f"robots.txt of {u.netloc} answered {status}")
            else:
                parser.parse(body.decode("utf-8", "replace").splitlines())
            self.known[u.netloc] = parser
        return self.known[u.netloc]

    def allowed(self, url: str) -> bool:
        return self.rules(url).can_fetch(AGENT, url)

    def wait(self, url: str, sleep: Callable[[float], None] = time.sleep) -> None:
        sleep(max(1, float(self.rules(url).crawl_delay(AGENT) or 0)))


def download(row: dict, robots: Robots, get: Callable[[str], Response] = http_get, sleep: Callable[[float], None] = time.sleep) -> tuple[bytes, str]:
    """One manifest entry: permitted by its host's robots rules, which no redirect may leave, and of the stated format."""
    url = row["source_url"]
    if not robots.allowed(url):
        raise ValueError(f"robots.txt disallows {url}")
    robots.wait(url, sleep)
    host = urllib.parse.urlsplit(url).hostname
    content, final = fetch(url, row["regulator"], lambda u: urllib.parse.urlsplit(u).hostname == host and robots.allowed(u), get)
    if row["format"] == "pdf" and not content.startswith(b"%PDF"):
        raise ValueError("expected a PDF")
    return content, final
