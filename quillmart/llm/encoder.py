"""Token ids by a tokenizers file, with a bounded memo of the chunks between single spaces."""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

#: In a worker process: path -> encoder, so that tasks share the loaded file and the memo.
_LOADED: dict[str, "ChunkEncoder"] = {}

#: Longest chunk in the memo.
MEMO_LENGTH = 64
SPACE_AFTER_SPACE = re.compile(r"\s ")
#: A space that starts a run of white space: no pre-token of a byte-level tokenizer spans it.
CUT = re.compile(r"(?<!\s) ")
# Fixed value: the pattern of byte-level pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def encoder(path: str) -> "ChunkEncoder":
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]


def splits_at_spaces(spec: dict) -> bool:
    """Whether this is a byte-level tokenizer whose pre-tokens begin at a space."""
    pre = spec.get("pre_tokenizer") or {}
    return (
        pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        and all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] and " " not in x["content"] for x in spec.get("added_tokens", []))
    )


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """Token -> id if ids rise with the merges, so that merging by rank and by id are the same; else None."""
    model = spec["model"]
    vocab, merges = model["vocab"], model["merges"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    if made != sorted(set(made)) or len(made) + 256 > len(vocab) or model.get("ignore_merges") or model.get("dropout"):
        return None
    byte = {chr(c): b for b, c in BYTE_CHARS.items()} | {chr(b): b for b in _PLAIN}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}


class ChunkEncoder:
    """Gives each text's ids as little-endian unsigned 32-bit integers.

    A byte-level pre-tokenizer never joins a non-space with a space after it, so
    a text's ids are those of its chunks, each with its leading space. Chunks
    repeat; a memo (at most `most` entries) spares encoding them again. A new chunk
    is merged by tiktoken over the file's own vocabulary, whose ids are the merge
    order; a special token's string, a vocabulary in another order and a file of
    another kind go through the tokenizers library.
    """

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.chunked, self.most, self.memo = splits_at_spaces(spec), most, {}
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        ranks = ranks_of(spec) if self.chunked else None
        self.merge = ranks and tiktoken.Encoding("file", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        if self.merge and not self._agrees(ranks):
            self.merge = None

    def _agrees(self, ranks: dict[bytes, int]) -> bool:
        """Whether both libraries encode each token of the vocabulary that is a text alike."""
        texts = []
        for token in ranks:
            try:
                texts.append(token.decode())
            except UnicodeDecodeError:
                continue
        return all(x == struct.pack(f"<{len(y)}I", *y) for x, y in zip(self._whole(texts), map(self.merge, texts)))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk(self, chunk: str) -> bytes:
        if not self.merge or any(s in chunk for s in self.special):
            return self._whole([chunk])[0]
        ids = self.merge(chunk)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        return [self._text(t) for t in texts] if self.chunked else self._whole(texts)

    def _text(self, text: str) -> bytes:
        if len(self.memo) > self.most:
            self.memo.clear()
        head, *rest = CUT.split(text) if SPACE_AFTER_SPACE.search(text) else text.split(" ")
        ids = list(map(self.memo.get, rest))
        if None in ids:
            for i, x in enumerate(ids):
                if x is None:
                    c = rest[i]
                    ids[i] = self._chunk(" " + c)
                    if len(c) <= MEMO_LENGTH:
                        self.memo[c] = ids[i]
        return self._chunk(head) + b"".join(ids)
