"""Public byte-level vocabularies; files are named by path and loaded once per worker."""

from __future__ import annotations

import base64
from functools import cache

import tiktoken


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def encoding(path: str, special: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    """The encoder over the ranks of a file, with special strings and their ids."""
    return tiktoken.Encoding("ranks", pat_str=pattern(), mergeable_ranks=ranks(path), special_tokens=dict(special))


@cache
def token_bytes(path: str) -> list[bytes]:
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        out[rank] = token
    return out
