"""Byte-level BPE ids, as the ``tokenizers`` library gives them for a .json vocabulary.

``tokenizers`` encodes about 2 MB of these texts a second and core, ``tiktoken``
about 8 with the same vocabulary in rank form.  Where a rank file stands beside
the .json, ``tiktoken`` encodes all texts but those with a special token's
string, which go to ``tokenizers``.  A test compares the two libraries over
every code point in several contexts."""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
#: Ends a document in a packed sequence.
END_ID = 0


@lru_cache(maxsize=4)
def byte_lengths(vocabulary: str) -> np.ndarray:
    """UTF-8 bytes of each id of a byte-level vocabulary (it spells a byte as one character)."""
    table = load_json(vocabulary).get_vocab(with_added_tokens=True)
    out = np.zeros(max(table.values()) + 1, dtype=np.int64)
    for token, i in table.items():
        out[i] = len(token)
    return out


@lru_cache(maxsize=4)
def load_json(vocabulary: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


@lru_cache(maxsize=4)
def _ranked(vocabulary: str) -> tiktoken.Encoding | None:
    path = public_tokenizers.path(vocabulary.replace(".json", ".tiktoken"))
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class ByteLevelTokenizer:
    """Ids of whole texts; special tokens' strings are treated as the library's default does."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        self.exact = load_json(vocabulary)
        self.fast = _ranked(vocabulary)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.lengths = byte_lengths(vocabulary)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class WholeTextTokenizer:
    """Ids by the file's own library, for vocabularies that aren't byte-level."""

    lengths = None

    def __init__(self, vocabulary: str) -> None:
        if vocabulary.endswith(".model"):
            model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
            self._encode = lambda text: model.encode(text, num_threads=1)
        else:
            table = load_json(vocabulary)
            self._encode = lambda text: table.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._encode(text), dtype=np.uint32)


@lru_cache(maxsize=4)
def load_tokenizer(vocabulary: str = VOCABULARY) -> ByteLevelTokenizer | WholeTextTokenizer:
    """The tokenizer of a vocabulary file; loaded once per worker."""
    if vocabulary.endswith(".json") and _byte_level(vocabulary):
        return ByteLevelTokenizer(vocabulary)
    return WholeTextTokenizer(vocabulary)


def _byte_level(vocabulary: str) -> bool:
    """A byte-level pre-tokenizer with the usual pattern, and nothing before it."""
    spec = json.loads(load_json(vocabulary).to_str())
    pre = spec.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
