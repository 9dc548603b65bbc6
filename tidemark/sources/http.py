"""A throttled HTTP source. One partition reads all addresses, so the pause between requests holds for the whole job."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

#: Seconds between requests, and seconds before a request is given up.
PAUSE, TIMEOUT = 0.12, 30
#: Times that a request is made again, and the seconds before the first of them; each waits twice as long as the last.
RETRIES, BACKOFF = 4, 1.0


class ThrottledHttp(DataSource):
    """spark.read.format("throttled_http").option("urls", "a b c").option("agent", "name mail").load()

    A request that meets 429, a server error, a time-out or no connection is made again, `retries` times, after `backoff`
    seconds and twice as many each time, or as many as the answer asks for. One that fails for good raises, or with
    option skip_errors becomes a row with `error`, its status if there was an answer, and no body.
    """

    @classmethod
    def name(cls) -> str:
        return "throttled_http"

    def schema(self) -> str:
        return "url string, status int, body string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _number(self, name: str, default: float) -> float:
        return float(self.options.get(name, default))

    def _ask(self, url: str) -> tuple[int, str]:
        request = urllib.request.Request(url, headers={"User-Agent": self.options.get("agent", "tidemark")})
        with urllib.request.urlopen(request, timeout=self._number("timeout", TIMEOUT)) as r:
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")

    def read(self, partition) -> Iterator[tuple]:
        skip = self.options.get("skip_errors", "false").lower() == "true"
        pause, retries, backoff = self._number("pause", PAUSE), int(self._number("retries", RETRIES)), self._number("backoff", BACKOFF)
        for i, url in enumerate(self.options.get("urls", "").split()):
            if i:
                time.sleep(pause)
            for again in range(retries + 1):
                try:
                    yield url, *self._ask(url), None
                    break
                except OSError as e:
                    status = getattr(e, "code", None)
                    if again == retries or status is not None and status != 429 and status < 500:
                        if not skip:
                            raise
                        yield url, status, None, str(e)
                        break
                    asked = e.headers.get("Retry-After", "") if isinstance(e, urllib.error.HTTPError) and e.headers else ""
                    time.sleep(max(pause, backoff * 2**again, float(asked) if asked.isdigit() else 0.0))
