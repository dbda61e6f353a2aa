"""Search on sealed labels: equality on keyed tags, the properties opaque. A demonstration, not a protection of data."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tag(key: bytes, label: str) -> str:
    return hmac.new(key, label.encode(), hashlib.sha256).hexdigest()


def _stream(key: bytes, n: int, nonce: bytes) -> bytes:
    return b"".join(hashlib.sha256(key + nonce + k.to_bytes(8, "big")).digest() for k in range(-(-n // 32)))[:n]


def _seal(key: bytes, text: str, nonce: bytes) -> str:
    data = text.encode()
    return base64.b64encode(nonce + bytes(a ^ b for a, b in zip(data, _stream(key, len(data), nonce), strict=True))).decode()


def unseal(key: bytes, payload: str) -> dict:
    raw = base64.b64decode(payload)
    nonce, data = raw[:16], raw[16:]
    return json.loads(bytes(a ^ b for a, b in zip(data, _stream(key, len(data), nonce), strict=True)))


def seal(nodes: DataFrame, key: bytes) -> DataFrame:
    """(node_id, tags array<string>, payload string)"""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            tags = [[tag(key, x) for x in labels] for labels in f["labels"]]
            sealed = [_seal(key, p or "{}", hashlib.sha256(key + str(i).encode()).digest()[:16]) for i, p in zip(f["node_id"], f["properties"], strict=True)]
            yield pd.DataFrame({"node_id": f["node_id"], "tags": tags, "payload": sealed})

    return nodes.select("node_id", "labels", "properties").mapInPandas(run, "node_id long, tags array<string>, payload string")


def search(sealed: DataFrame, wanted: str) -> DataFrame:
    """Rows with a tag, which only the owner of the key can make from a label."""
    return sealed.where(F.array_contains("tags", wanted))
