"""Token ids of whole texts with a public word tokenizer, one Arrow batch at a time.

The tokenizers library takes most of its time for words it has seen before. It splits
at white space, so a text's ids are its words' ids in a row: each distinct word is
encoded once, and the ids are put together with numpy.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts of one step, in bytes, and the words that a worker remembers.
STEP_BYTES = 4 << 20
CACHED_WORDS = 300_000

# A letter, then full stops or commas that end a word: two tokens of their own.
_ENDED = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,]+)([\x20\x09-\x0D]|$)"


# Words of these letters alone are one pre-token each, of which the tokenizer's model
# sees the bytes. Byte-level models write a byte as the character of the same number if
# that is visible, and the other bytes, in order, as the characters from 256 on.
_LETTERS = re.compile("[a-zà-öø-ÿ]+")
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
_BYTE_CHARS = [chr(b) if b in _VISIBLE else chr(256 + _HIDDEN.index(b)) for b in range(256)]


class WordEncoder:
    """Encodes texts with a tokenizer file that lowers case and splits at white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _new_ids(self, words: list[str]) -> dict[str, list[int]]:
        model, ids, others = self.tokenizer.model, {}, []
        for word in words:
            if not _LETTERS.fullmatch(word):
                others.append(word)
                continue
            seen = word if word.isascii() else "".join([_BYTE_CHARS[b] for b in word.encode()])
            ids[word] = [t.id for t in model.tokenize(seen)]
        found = self.tokenizer.encode_batch(others, add_special_tokens=False)
        return ids | {w: e.ids for w, e in zip(others, found, strict=True)}

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Words not met for long are forgotten: the older half of the cache goes first."""
        if len(self.young) > CACHED_WORDS // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for word in words:
            if word not in young:
                if word in old:
                    young[word] = old[word]
                else:
                    new.append(word)
        for at in range(0, len(new), 20_000):
            for word, ids in self._new_ids(new[at : at + 20_000]).items():
                young[word] = struct.pack(f"<{len(ids)}I", *ids)
        return [young[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has. A null text has none."""
        # A copy: some text functions of Arrow misread slices of a larger array.
        texts = texts.take(pa.array(np.arange(len(texts)))).fill_null("").cast(pa.large_string())
        lower = pc.ascii_lower(texts)
        odd = np.zeros(len(texts), dtype=bool)
        for mark in self.special:
            odd |= pc.match_substring(lower, mark.lower()).to_numpy(zero_copy_only=False)
        plain = pc.replace_substring_regex(lower, _ENDED, r"\1 \2\3")
        if odd.any():  # the mark of a special token is one id, wherever it stands
            plain = pc.if_else(pa.array(odd), "", plain)
        split = pc.ascii_split_whitespace(plain)
        coded = split.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        words = self._word_ids(coded.dictionary.to_pylist())
        table = np.frombuffer(b"".join(words), dtype="<u4")
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) // 4
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = sizes[index] if len(index) else np.zeros(0, dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(counts)))
        shift = (first[index] - ends[:-1]).astype(np.int32)  # a step has far fewer ids
        at = np.arange(ends[-1], dtype=np.int32) + np.repeat(shift, counts)
        ids = table[at] if len(at) else np.zeros(0, dtype="<u4")
        offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        lengths = ends[offsets[1:]] - ends[offsets[:-1]]
        return self._with_odd(texts, odd, ids, lengths) if odd.any() else (ids, lengths)

    def _with_odd(self, texts, odd, ids, lengths):
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for i in np.flatnonzero(odd):
            found = self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False)
            parts[i] = np.array(found.ids, dtype="<u4")
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    return WordEncoder(path)


def steps(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about `STEP_BYTES` of text, one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes.astype(np.int64)), 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + STEP_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def encoded_documents(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, text: str = "text"
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each slice with its ids in a row, every document closed by ``end_id``, and lengths."""
    coder = encoder(path)
    for batch in batches:
        for part in steps(batch, text):
            ids, lengths = coder.encode(part.column(text))
            closed = np.full(len(ids) + len(lengths), end_id, dtype="<u4")
            keep = np.ones(len(closed), dtype=bool)
            keep[np.cumsum(lengths + 1) - 1] = False
            closed[keep] = ids
            yield part, closed, lengths + 1
