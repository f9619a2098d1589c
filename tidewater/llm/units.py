"""Tokenizers opened once a worker, and ids of whole texts."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Units that a worker remembers; beyond that it starts anew.
WORKER_UNITS = 400_000
#: Characters that go to an encoder at a time.
LONG = 1 << 20
#: Runs of white space from this length on go to the tokenizer; the faster encoder's expressions can't match them.
RUN = 10_000
SPACES = re.compile(r"\s{64,}")
CUT = re.compile(r" (?=\S)")
#: Beyond the Latin script and common punctuation, or controls that libraries class differently.
ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ‐-‧‰-⁞€]")
_open: dict = {}


def byte_bpe(path: str):
    """The tokenizer of a .json file."""
    if path not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _open[path] = Tokenizer.from_file(path)
    return _open[path]


def pieces(path: str):
    """The model of a .model file."""
    if path not in _open:
        import sentencepiece

        _open[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _open[path]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def same_ids(path: str) -> bool:
    """Whether an encoder that merges by rank gives the ids of the tokenizer of a .json file.

    It does if the file has the byte-level pre-tokenizer of public_tokenizers.PATTERN, merges
    whose results have ascending ids, and a vocabulary of which each token is its own encoding:
    then no merge that the file doesn't list can come up, as two tokens that stand side by side
    do so in the token's own encoding too, which goes through the listed merge."""
    key = ("same", path)
    if key not in _open:
        file = json.loads(byte_bpe(path).to_str())
        model, before = file["model"], file["pre_tokenizer"] or {}
        plain = file["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        vocab = model.get("vocab", {})
        if plain:
            made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
            own = byte_bpe(path).model
            plain = made == sorted(made) and -1 not in made and set("".join(vocab)) <= set(byte_letters()) and all([t.id for t in own.tokenize(x)] == [i] for x, i in vocab.items())
        _open[key] = bool(plain)
    return _open[key]


class Ids:
    """Ids of whole texts by a byte-level tokenizer, as bytes of little-endian unsigned 32-bit integers.

    With fast (see same_ids), texts of the Latin script go to a faster encoder with the tokenizer's
    own vocabulary. All others, texts that hold a special string and long runs of white space go
    to the tokenizer. With fast, a very long text is cut where a space stands before a non-space:
    a pre-token of the pattern begins there whatever surrounds it."""

    def __init__(self, path: str, fast: bool):
        self.tokenizer, letters = byte_bpe(path), byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if fast:
            import public_tokenizers
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def one(self, text: str) -> bytes:
        if self.fast and len(text) > LONG and not any(s in text for s in self.special):
            at, out = 0, []
            while at < len(text):
                cut = CUT.search(text, at + LONG) if at + LONG < len(text) else None
                end = cut.start() if cut else len(text)
                out.append(self._part(text[at:end]))
                at = end
            return b"".join(out)
        return self._part(text)

    def _part(self, text: str) -> bytes:
        odd = not self.fast or ODD.search(text) or any(s in text for s in self.special)
        if odd or (len(text) >= RUN and any(len(m[0]) >= RUN for m in SPACES.finditer(text))):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]


def encoder(path: str, fast: bool) -> Ids:
    """fast: what same_ids() says, asked once by the driver."""
    key = ("ids", path, fast)
    if key not in _open:
        _open[key] = Ids(path, fast)
    return _open[key]
