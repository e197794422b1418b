"""Token ids of whole texts by a vocabulary file of the tokenizers library.

The vocabulary's pre-tokenizer never joins what ASCII white space separates, and its normalizer treats both sides of a
white-space character apart. A text's ids are therefore those of its words, one after another; each distinct word of a
slice is encoded once. ``check_separable`` refuses vocabulary files for which that does not hold.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from radquery.llm.words import gather, give_back, split_words, texts_of

#: Bytes, about, of words with their ids that an encoder keeps between the slices of a task; others are encoded again.
KEPT_BYTES, ENTRY_BYTES = 64 << 20, 200
#: Words that the library gets at once.
AT_ONCE = 500
#: The pattern of runs of letters, digits, and other marks, and nothing of two kinds: fixed value of the vocabulary files.
RUNS = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def check_separable(path: str) -> bool:
    """Raises an error if white space doesn't separate tokens. True if upper case and final marks may be taken off words, as
    the file's own steps lower them and cut marks from letters."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokens = [t for t in spec.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"])]
    steps = spec["pre_tokenizer"]
    steps = steps.get("pretokenizers", [steps]) if steps else []
    splits = [s for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
    if tokens or not splits or r"[^\s\p{L}\p{N}]+" not in splits[0]["pattern"].get("Regex", ""):
        raise ValueError(f"{path}: white space does not separate tokens here")
    normalizer = spec.get("normalizer") or {}
    kinds = {n["type"] for n in normalizer.get("normalizers", [normalizer]) if n}
    return "Lowercase" in kinds and splits[0]["pattern"]["Regex"].endswith(RUNS)


def _bare(distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words with ASCII letters in lower case and without one final full stop or comma that follows a letter; and what was
    taken off (0 nothing, 1 full stop, 2 comma). The vocabulary's own steps do both, so this only merges words."""
    special = pc.match_substring(distinct, "<|")
    words = pc.if_else(special, distinct, pc.ascii_lower(distinct))
    last, before = pc.binary_slice(words.cast(pa.binary()), -1), pc.binary_slice(words.cast(pa.binary()), -2, -1)
    letter = pc.and_(pc.greater_equal(before, pa.scalar(b"a")), pc.less_equal(before, pa.scalar(b"z")))
    mark = np.zeros(len(words), dtype=np.int64)
    for k, c in enumerate((b".", b","), 1):
        here = pc.and_(pc.and_not(letter, special), pc.equal(last, pa.scalar(c)))
        mark[here.to_numpy(zero_copy_only=False)] = k
    cut = pc.binary_slice(words.cast(pa.binary()), 0, -1).cast(pa.string(), safe=False)
    return pc.if_else(pa.array(mark > 0), cut, words), mark


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.merges = check_separable(path)
        self.tokenizer, self.kept, self.room = Tokenizer.from_file(path), {}, KEPT_BYTES
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.largest_id = max(vocabulary.values())
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.largest_id + 1, dtype=bool) if suffix and self.merges else None  # tokens that end a run
        if suffix and self.merges:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes of uint32."""
        found = [*map(self.kept.get, words)]
        new = []
        for i, ids in enumerate(found):
            if ids is None and "<|" in words[i]:  # may hold an added token, which belongs to no word
                found[i] = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, dtype=np.uint32).tobytes()
            elif ids is None:
                new.append(i)
        plain, other = [], new
        if self.ends is not None and new:
            alone = pc.match_substring_regex(pa.array([words[i] for i in new], pa.string()), r"^\pL+$").to_pylist()
            plain, other = [i for i, a in zip(new, alone, strict=True) if a], [i for i, a in zip(new, alone, strict=True) if not a]
        for group, encode in ((plain, self._of_letters), (other, self._of_any)):
            for k in range(0, len(group), AT_ONCE):
                part = group[k : k + AT_ONCE]
                texts = [words[i] for i in part]
                ids, ends = encode(texts)
                each = [ids[a:b] for a, b in itertools.pairwise(ends)]
                for i, own in zip(part, each, strict=True):
                    found[i] = own
                if self.room > 0:
                    self.kept.update(zip(texts, each, strict=True))
                    self.room -= sum(map(len, texts)) + len(ids) + ENTRY_BYTES * len(texts)
        return found

    def _of_any(self, words: list[str]) -> tuple[bytes, list[int]]:
        """The ids of all words, and where each one's begin, and the last one's end, in bytes."""
        e = self.tokenizer.encode_batch([words], is_pretokenized=True, add_special_tokens=False)[0]
        ends = 4 * np.searchsorted(np.array(e.word_ids, dtype=np.int64), np.arange(len(words) + 1))
        return np.array(e.ids, dtype=np.uint32).tobytes(), ends.tolist()

    def _of_letters(self, words: list[str]) -> tuple[bytes, list[int]]:
        """The same for words of letters, as one text. A run of letters has one token with the end's suffix, its last; a word
        that the normalizer turns into more than one run is told by their number."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        return (ids.tobytes(), [0, *ends.tolist()]) if len(ends) == len(words) else self._of_any(words)

    def forget(self) -> None:
        """What was kept goes; a worker that waits for its next task holds the vocabulary alone."""
        self.kept, self.room = {}, KEPT_BYTES

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts, each followed by ``end_id``, and the offsets by text."""
        codes, offsets, distinct = split_words(texts_of(texts))
        bare, mark = _bare(distinct) if self.merges else (distinct, np.zeros(len(distinct), dtype=np.int64))
        bare = bare.dictionary_encode()
        each = [*self._ids(bare.dictionary.to_pylist()), *self._ids([".", ","]), np.array([end_id], dtype=np.uint32).tobytes()]
        flat = np.frombuffer(b"".join(each), dtype=np.uint32)
        lengths = np.fromiter(map(len, each), np.int64, len(each)) // 4
        starts = np.cumsum(lengths) - lengths
        # units of a distinct word: its bare form, then what was taken off; the last word is the end of a text
        units = len(each) - 1
        first = np.append(bare.indices.to_numpy(zero_copy_only=False), units).astype(np.int64)
        second = np.append(np.where(mark > 0, units - 3 + mark, units), units)
        more = np.append(np.where(mark > 0, lengths[second[:-1]], 0), 0)
        word_ids = gather(flat, np.stack([starts[first], starts[second]], 1).ravel(), np.stack([lengths[first], more], 1).ravel())
        word_lengths = lengths[first] + more
        word_starts = np.cumsum(word_lengths) - word_lengths
        codes = np.insert(codes, offsets[1:], len(distinct))
        counts = word_lengths[codes]
        ends = np.concatenate(([0], np.cumsum(counts)))
        return gather(word_ids, word_starts[codes], counts), ends[offsets + np.arange(len(offsets))]


_encoders: dict[str, Encoder] = {}


@contextmanager
def encoding(path: str) -> Iterator[Encoder]:
    """The Python worker's encoder for a file, for one task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    try:
        yield _encoders[path]
    finally:
        if path in _encoders:
            _encoders[path].forget()
        give_back()
