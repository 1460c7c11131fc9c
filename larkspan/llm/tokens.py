"""Byte-level BPE ids of a public vocabulary file, and flat token blocks."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer


#: Runs of white space (Unicode's) of so many characters are cut out before tiktoken's pattern, which takes a level of its stack for each, sees them.
LONG_SPACE = 20_000
_SPACES = re.compile(r"[^\S\x1c-\x1f]{%d,}" % LONG_SPACE)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The ids that the ``tokenizers`` library gives for the file (``add_special_tokens=False``).

    The vocabulary's merges are in the order of its ids, so the ranks of tiktoken are the same merges; it is several times as fast and gives the
    same ids (tests compare the two). Texts that hold a special token's string go to ``tokenizers`` itself, as do all texts of a file of another kind.
    """

    def __init__(self, path: str, specials_are_text: bool = False) -> None:
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = specials_are_text
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = [t["content"] for t in model.get("added_tokens", [])]
        self.special = [] if specials_are_text else special
        self.fast = self._fast(model, set(special))

    @staticmethod
    def _fast(model: dict, special: set[str]):
        import public_tokenizers

        bpe, pre = model["model"], model.get("pre_tokenizer") or {}
        if bpe.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("normalizer") or bpe.get("byte_fallback") or bpe.get("dropout"):
            return None
        # Byte-level vocabularies write a byte as a printable character: itself where printable in Latin-1, else the next one from U+0100 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char, extra = {b: chr(b) for b in printable}, 0
        for b in range(256):
            if b not in char:
                char[b] = chr(256 + extra)
                extra += 1
        byte = {c: b for b, c in char.items()}
        ranks = {bytes(byte[c] for c in t): i for t, i in bpe["vocab"].items() if t not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"]]
        made = [bpe["vocab"].get(a + b) for a, b in merges]
        if None in made or any(x >= y for x, y in zip(made, made[1:])):
            return None
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(text) < LONG_SPACE:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        try:
            return np.concatenate([np.array(ids, np.uint32) for ids in self._parts(text)])
        except BaseException as e:  # a panic of the library is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def _parts(self, text: str):
        """Ids of the text between its long runs of white space, and of these. The pattern makes one piece of a run at the text's end, and of any other
        without its last character, which belongs to what follows; no piece reaches from before a run into it."""
        at = 0
        for run in _SPACES.finditer(text):
            yield self.fast.encode_ordinary(text[at : run.start()])
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield self.fast._encode_single_piece(text[run.start() : at])
        yield self.fast.encode_ordinary(text[at:])


@lru_cache(maxsize=2)
def encoder(path: str, specials_are_text: bool = False) -> Encoder:
    """One for each worker process."""
    return Encoder(path, specials_are_text)
