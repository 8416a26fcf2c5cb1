"""Pages fetched from addresses, on the executors, with a cache of files in a shared folder."""

from __future__ import annotations

import hashlib
import os
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame

AGENT = "stemmata (reader of open texts)"


def fetch(addresses: DataFrame, cache: str, timeout: int = 120, least_bytes: int = 1, refresh: bool = False) -> DataFrame:
    """(path, value, status) for every row (path, url): ``cached``, ``fetched`` or ``failed`` with a null value.

    Pages are kept in the folder ``cache``, which all executors must share, under a name made from
    the address; a kept page is not fetched again unless ``refresh``.  Answers of fewer bytes
    than ``least_bytes``, errors and null addresses fail and are not kept.
    """

    def get(url: str | None) -> tuple[str | None, str]:
        if not url:
            return None, "failed"
        at = os.path.join(cache, hashlib.sha256(url.encode()).hexdigest())
        if os.path.exists(at) and not refresh:
            with open(at, "rb") as f:
                return f.read().decode("utf-8", "replace"), "cached"
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as r:
                data = r.read()
        except (OSError, ValueError):
            return None, "failed"
        if len(data) < least_bytes:
            return None, "failed"
        os.makedirs(cache, exist_ok=True)
        part = f"{at}.{os.getpid()}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, at)  # a task that runs twice writes the same page
        return data.decode("utf-8", "replace"), "fetched"

    def run(batches):
        for pdf in batches:
            got = [get(u) for u in pdf["url"]]
            yield pd.DataFrame({"path": pdf["path"], "value": [v for v, _ in got], "status": [s for _, s in got]})

    return addresses.select("path", "url").mapInPandas(run, "path string, value string, status string")
