"""Token counts with a whole-token shortcut, equal to the tokenizer library's."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the word pattern of the byte-level vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
REMEMBERED = 200_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def proven_whole(tokenizer) -> frozenset[str]:
    """Strings of the vocabulary that are one pre-token and that the merges turn into one token.

    Pre-tokens are encoded alone, so what holds for the string alone holds for it everywhere in a text.
    """
    back = {c: b for b, c in byte_alphabet().items()}
    strings = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(back[c] for c in entry).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: no pre-token by itself
    whole = [s for s in strings if WORDS.findall(s) == [s]]
    return frozenset(s for s, e in zip(whole, tokenizer.encode_batch(whole, add_special_tokens=False)) if len(e.ids) == 1)


class Counter:
    """Token counts of texts by one tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = proven_whole(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merged: dict[str, int] = {}

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        """Whole pre-tokens count one; the rest is merged once per distinct string. Texts that hold an added token's string, which
        the library takes out before it cuts words, go to the library as they are."""
        whole, cut, special, out = self.whole, [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            if any(a in t for a in self.added):
                special.append(i)
                continue
            words = WORDS.findall(t)
            rest = [w for w in words if w not in whole]
            out[i] = len(words) - len(rest)
            cut.append((i, rest))
        if len(self.merged) > REMEMBERED:
            self.merged.clear()
        unknown = list({w for _, rest in cut for w in rest if w not in self.merged})
        self.merged.update(zip(unknown, self.encoded(unknown)))
        for i, rest in cut:
            out[i] += sum(map(self.merged.__getitem__, rest))
        for i, n in zip(special, self.encoded([texts[i] for i in special])):
            out[i] = n
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """`docs` without the text, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > `limit`).

    One row per row, in one pass without a shuffle. NULL is an empty text of 0 bytes and tokens. `tokenizer_path` is a byte-level
    tokenizer file that every executor can open. Columns of `docs` called like the new ones are replaced.
    """

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch]
            yield pd.Series([n for at in range(0, len(texts), 256) for n in own.counts(texts[at : at + 256])], dtype="int64")

    docs = docs.drop(*[n for n in ("n_bytes", "n_tokens", "over_limit") if n != text])
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.withColumns({"n_bytes": F.octet_length(body).cast("long"), "n_tokens": n_tokens(body)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit).drop(text)
