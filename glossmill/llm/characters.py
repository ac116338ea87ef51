"""Classes of code points as several libraries see them: their Unicode versions differ."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex
import tiktoken

#: Classes that patterns of tokenizers name, in this order, and a character of each (and of none) that no pattern
#: mentions on its own and on which all libraries agree.
CLASSES = (r"\p{L}", r"\p{N}", r"\s")
STAND_INS = {0: "¤", 1: "ж", 2: "٣", 3: "　"}


def every_character() -> str:
    return "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))


def _table(members) -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for k, cls in enumerate(CLASSES, 1):
        out[[ord(c) for c in members(cls)]] = k
    return out


@lru_cache(maxsize=1)
def of_tiktoken() -> np.ndarray:
    """The class of each code point (0: none) in patterns of tiktoken, asked of the library itself.

    An encoder of single bytes whose pattern is the class leaves out all other characters.
    """
    text, bytes_ = every_character(), {bytes([i]): i for i in range(256)}
    return _table(lambda cls: bytes(tiktoken.Encoding("class", pat_str=cls, mergeable_ranks=bytes_, special_tokens={}).encode_ordinary(text)).decode())


@lru_cache(maxsize=1)
def of_regex() -> np.ndarray:
    text = every_character()
    return _table(lambda cls: regex.findall(cls, text))


@lru_cache(maxsize=1)
def differing() -> np.ndarray:
    """The code points that regex puts into another class than tiktoken."""
    return np.flatnonzero(of_tiktoken() != of_regex())


@lru_cache(maxsize=1)
def stand_ins() -> dict[int, str]:
    """For each differing character a stand-in of tiktoken's class."""
    want = of_tiktoken()
    return {int(c): STAND_INS[int(want[c])] for c in differing()}


@lru_cache(maxsize=1)
def _unlike() -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    out[differing()] = True
    return out


def unlike(text: str) -> bool:
    """Whether a text has a differing character."""
    return bool(_unlike()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any())
