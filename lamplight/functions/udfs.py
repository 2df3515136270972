"""The few text functions that Spark has no expression for, as Arrow-batched pandas UDFs.

Each is a small helper on one value; Spark partitions and shuffles around them.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from difflib import SequenceMatcher
from urllib.parse import parse_qsl, quote_plus, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query keys that only track visits.
TRACKING_KEYS = frozenset({"fbclid", "gclid", "ref", "source", "utm_campaign", "utm_medium", "utm_source"})


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C; null stays null."""
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def _query(query: str) -> str:
    pairs = [p for p in parse_qsl(query, keep_blank_values=True) if p[0].lower() not in TRACKING_KEYS]
    return "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in sorted(pairs))


def canonical(url: str | None, keep_authority: bool) -> str:
    """One URL for the pages that differ in tracking, order of parameters, fragment and case of the host."""
    try:
        parts = urlsplit((url or "").strip())
        if keep_authority:
            host = parts.netloc.lower()
        else:
            port = "" if parts.port in (None, 80, 443) else f":{parts.port}"
            host = (parts.hostname or "").lower() + port
    except ValueError:  # no such port or address
        return ""
    return urlunsplit((parts.scheme.lower(), host, parts.path or "/", _query(parts.query), ""))


@F.pandas_udf(T.StringType())
def canonical_url(url: pd.Series) -> pd.Series:
    """Without user, default ports (80 and 443 with any scheme), fragment and tracking keys."""
    return url.map(lambda u: canonical(u, False))


@F.pandas_udf(T.StringType())
def canonical_url_with_port(url: pd.Series) -> pd.Series:
    """As canonical_url, but the port and user stay."""
    return url.map(lambda u: canonical(u, True))


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters as difflib has it, with its rule for frequent characters in long strings."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def strict_similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same without the rule for frequent characters."""
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def stable_json_hash(value: pd.Series) -> pd.Series:
    """SHA-256 of JSON text with sorted keys and compact separators; null for text that is no JSON."""

    def one(x: str) -> str | None:
        try:
            text = json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None
        return hashlib.sha256(text.encode()).hexdigest()

    return value.map(one, na_action="ignore")


def _leaves(value, out: list[str]) -> None:
    if isinstance(value, dict):
        for v in value.values():
            _leaves(v, out)
    elif isinstance(value, list):
        for v in value:
            _leaves(v, out)
    elif value is not None and str(value).strip():
        out.append(str(value).strip())


@F.pandas_udf(T.StringType())
def flattened_json(value: pd.Series) -> pd.Series:
    """Leaf values of JSON text, a line each; empty for text that is no JSON."""

    def one(x: str) -> str:
        out: list[str] = []
        try:
            _leaves(json.loads(x), out)
        except ValueError:
            return ""
        return "\n".join(out)

    return value.map(one, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def urls_in_json(value: pd.Series) -> pd.Series:
    """Every http(s) string inside JSON text, in document order, distinct."""

    def one(x: str) -> list[str]:
        out: list[str] = []
        try:
            _leaves(json.loads(x), out)
        except ValueError:
            return []
        return list(dict.fromkeys(u for u in out if u.startswith(("http://", "https://"))))

    return value.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def decoded_body(body: pd.Series) -> pd.Series:
    """Bytes as UTF-8, else as CP949, else null."""

    def one(x: bytes) -> str | None:
        for name in ("utf-8-sig", "cp949"):
            try:
                return bytes(x).decode(name)
            except UnicodeDecodeError:
                continue
        return None

    return body.map(one, na_action="ignore")
