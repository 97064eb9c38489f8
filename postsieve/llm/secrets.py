"""Secret scan: fixed patterns, and the token-efficiency test for random strings."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from postsieve.llm.common import own_column

# Kinds in the order in which equal starts are listed, with their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
# A run shorter than the least length can't be part of a longer one, so the length can stand in the pattern.
ACCESS_LONG = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
HEX_LONG = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
KINDS = ("assign", "access", "hex", "random")

#: Strings that may be keys: runs of the characters of base64 and its address-safe form.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Known digests have the length of a usual hash function, or are UUIDs.
DIGEST = re.compile(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}")
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
#: Identifiers: words or numbers joined by marks, each of letters with a number behind at most. The token test tells words from other letters.
IDENTIFIER = re.compile(r"[+/_=-]*(?:[A-Za-z]+[0-9]{0,4}|[0-9]+)(?:[+/_=-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]+))*[+/_=-]*")
WORD = re.compile(r"[A-Za-z]+")


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def random_runs(text: str, encoder, most_chars_per_token: float) -> list[tuple[int, int]]:
    """Runs that a vocabulary of usual text can only cut into short tokens; digests and identifiers are left out.

    An identifier's words are each one token or cut into longer ones; letters that aren't words make no identifier.
    """

    def is_word(part: str) -> bool:
        n = len(encoder.encode_ordinary(part))
        return n == 1 or len(part) > most_chars_per_token * n

    out = []
    for m in RUN.finditer(text):
        run = m[0]
        if DIGEST.fullmatch(run) or UUID.fullmatch(run):
            continue
        if IDENTIFIER.fullmatch(run) and all(map(is_word, WORD.findall(run))):
            continue
        if len(run) <= most_chars_per_token * len(encoder.encode_ordinary(run)):
            out.append(m.span())
    return out


def spans_of(text: str, encoder, most_chars_per_token: float) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of all findings, sorted; a random run inside of another finding is left out."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    base += [(m.start(), 1, m.end()) for m in ACCESS_LONG.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    base.sort()
    added, i, reach = [], 0, -1
    for start, end in random_runs(text, encoder, most_chars_per_token):
        while i < len(base) and base[i][0] <= start:
            reach, i = max(reach, base[i][2]), i + 1
        if reach < end:
            added.append((start, 3, end))
    return sorted(base + added)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def scan_secrets(
    docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", most_chars_per_token: float = 2.0
) -> DataFrame:
    """`docs` without the text, with n_assign, n_access, n_hex, n_random, base_sha256 and spans (kind:start:end, joined).

    One row per row, in one pass without a shuffle. NULL is an empty text; an empty text has no spans and the digest of
    the empty string. `vocabulary` is a file of tiktoken ranks that every executor can open, `pattern` its word pattern.
    Columns of `docs` called like the new ones are replaced.
    """
    new = {"n_assign": "long", "n_access": "long", "n_hex": "long", "n_random": "long", "base_sha256": "string", "spans": "string"}
    docs = docs.drop(*[n for n in new if n != text])
    carried = [c for c in docs.columns if c != text]
    body = own_column(docs, "scanned_text")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary, pattern)
        for batch in batches:
            out = batch.drop(columns=[body])
            found = [spans_of(t or "", encoder, most_chars_per_token) for t in batch[body]]
            for k, name in enumerate(("n_assign", "n_access", "n_hex", "n_random")):
                out[name] = [sum(s[1] == k for s in spans) for spans in found]
            out["base_sha256"] = [hashlib.sha256(listed([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found]
            out["spans"] = [listed(spans) for spans in found]
            yield out

    from pyspark.sql import functions as F

    ready = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").alias(body))
    schema = ", ".join([*(f"`{n}` {kind}" for n, kind in docs.dtypes if n != text), *(f"{n} {kind}" for n, kind in new.items())])
    return ready.mapInPandas(rows, schema)
