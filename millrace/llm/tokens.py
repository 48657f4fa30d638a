"""Whole-text encoding with a public tokenizers vocabulary.

In a vocabulary of the word_bpe_49k kind, white space does nothing but separate, so a text's
ids are the ids of its space- or newline-separated pieces in a row. Each worker keeps the ids
of some pieces that it has met and hands the others to the tokenizers library. Whether
a vocabulary is of that kind is read from its file; with any other, every text is
handed over whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
#: Pieces kept by a worker before it starts anew, and their mean length at most.
CACHE_PIECES = 250_000
CACHE_CHARS = 64
BATCH_TEXTS, BATCH_BYTES = 2048, 2 << 20
#: Plain words encoded in one text.
JOINED_WORDS = 1000
#: Texts that hold these are left as they are: characters that may compose or have
#: several lower cases, special tokens, marks that may belong to a run of marks.
_UNSAFE = "[^\u0000-\u00ff]|<\\||(^|[^A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])[.,] "


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Of the vocabulary's file, what makes pieces independent of their neighbours; fixed values.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def by_pieces(path: str) -> bool:
    """Whether the vocabulary file at path encodes a text piece by piece, as Encoder takes it to."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    return (
        (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS
        and (spec["pre_tokenizer"] or {}).get("pretokenizers") == SPLITTERS
        and {k: model.get(k) for k in MODEL} == MODEL
        and bool(model.get("end_of_word_suffix"))
        and not spec.get("truncation")
        and not spec.get("padding")
        and all(re.fullmatch(r"<\|\S+", x["content"]) and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in spec["added_tokens"])
    )


def _pieces(texts: pa.Array) -> pa.ListArray:
    """Parts of each text that the vocabulary encodes one by one.

    Texts of Latin-1 characters are composed already and have one lower case, so
    they can be lowered first; a full stop or comma between a letter or digit and
    a space is a token of its own.
    """
    spaced = pc.binary_join_element_wise(pc.replace_substring(texts, "\n", " "), "", " ")
    parted = pc.replace_substring(pc.replace_substring(pc.utf8_lower(spaced), ". ", " . "), ", ", " , ")
    return pc.split_pattern(pc.if_else(pc.match_substring_regex(spaced, _UNSAFE), spaced, parted), " ")


class Encoder:
    """Encodes texts by the vocabulary file at path, ending each with END_ID.

    If by_pieces(path): words of Latin-1 letters alone go to the vocabulary's model at
    once, many to a call; all other pieces take its whole chain of normalizer, splitter and
    model. Else whole texts take the whole chain.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores already
        from tokenizers import Tokenizer, pre_tokenizers

        self.full, self.cached = Tokenizer.from_file(path), by_pieces(path)
        if not self.cached:
            return
        self.plain = Tokenizer(self.full.model)  # the same model, not a copy
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # Tokens that end a word, by id.
        vocabulary = self.full.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for x, i in vocabulary.items() if x.endswith(self.full.model.end_of_word_suffix)]] = True
        # Byte-level names of the letters beyond ASCII.
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.names = [(c, level.pre_tokenize_str(c)[0][0]) for c in map(chr, range(0x80, 0x100)) if c.isalpha() and c == c.lower()]
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.used = self.chars = 0

    def _keep(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, first = len(self.slots), self.used
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(pieces) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[first : first + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(pieces)] = first + np.cumsum(lengths)
        self.used += len(ids)
        self.slots.update(zip(pieces, range(n, n + len(pieces))))

    def _named(self, text: str) -> str:
        if not text.isascii():
            found = set(text)
            marked = [(c, chr(0xE000 + i), name) for i, (c, name) in enumerate(self.names) if c in found]
            for c, mark, _ in marked:  # the names hold letters that have names themselves
                text = text.replace(c, mark)
            for _, mark, name in marked:
                text = text.replace(mark, name)
        return text

    def _learn(self, new: list[str]) -> None:
        self.chars += len("".join(new))
        plain = [x for x in new if x.isalpha() and (x.isascii() or max(x) < "\u0100")]
        rest = list(set(new).difference(plain))
        got = [x.ids for x in self.full.encode_batch_fast(rest, add_special_tokens=False)]
        self._keep(rest, np.fromiter(chain.from_iterable(got), np.int32), np.fromiter(map(len, got), np.int64, len(got)))
        joined = self._named("\n".join(" ".join(plain[i : i + JOINED_WORDS]) for i in range(0, len(plain), JOINED_WORDS)).lower()).split("\n")
        got = self.plain.encode_batch_fast(joined if plain else [], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(x.ids for x in got), np.int32)
        last = np.flatnonzero(self.ends_word[ids])
        if len(last) != len(plain):
            raise ValueError("the vocabulary doesn't mark word ends")
        self._keep(plain, ids, np.diff(last, prepend=-1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, end of each text's ids)."""
        if not self.cached:
            got = [[*x.ids, END_ID] for x in self.full.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter(chain.from_iterable(got), np.int32, int(lengths.sum())), np.cumsum(lengths)
        if len(self.slots) > CACHE_PIECES or self.chars > CACHE_PIECES * CACHE_CHARS:
            self._forget()
        split = _pieces(texts)
        coded = split.values.dictionary_encode()
        met = coded.dictionary.to_pylist()
        self._learn([x for x in met if x not in self.slots])
        slots = np.fromiter(map(self.slots.__getitem__, met), np.int64, len(met))[coded.indices.to_numpy()]
        starts = self.ends[slots]
        lengths = self.ends[slots + 1] - starts
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        # Every text is followed by the end id.
        stops = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        per_text = np.diff(stops)
        out = np.full(len(ids) + len(texts), END_ID, np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), per_text)] = ids
        return out, stops[1:] + np.arange(1, len(texts) + 1)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice of a record batch, ids, ends) as Encoder.encode gives them, a bounded size of texts at a time. Null: empty.

    A text is never cut, so one above BATCH_BYTES is a slice of its own.
    """
    enc = encoder(path)
    for batch in batches:
        texts = pc.fill_null(batch.column(text), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            size = np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES) - at
            n = max(1, min(int(size), BATCH_TEXTS))
            yield batch.slice(at, n), *enc.encode(texts.slice(at, n))
            at += n
    pa.default_memory_pool().release_unused()  # idle workers hold nothing for the next stage
