"""Cross-tokenizer alignment: the tokens of two vocabularies over the same text, by a dangling-suffix transducer.

Both tokenizers cut the same bytes. The transducer takes a token from the side that is behind and keeps who leads and the
bytes of the leader's last token that the other side hasn't reached: its residual. Transitions are memoised by residual and
next token. Each one links the two tokens at hand, which are all pairs that overlap; an empty residual closes a group.

A text is " " and its words. Neither tokenizer joins what a blank, tab or line feed separates from a visible character before
it (``Pair`` refuses vocabularies for which that does not hold), so a text is cut there into units, each distinct unit of a
slice is encoded and aligned once, and the units' results are put together.

Null and empty texts, and those that the tokens don't give back byte by byte, have no tokens. Rows with equal ids, or without
one, are aligned apart. Of further columns nothing is read. A text, its codes, and its groups have to fit in a task's memory;
what the memo and the cache of units keep is bounded.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radquery.llm.shared import small, write_table
from radquery.llm.words import gather, give_back, slices, texts_of

#: Bytes, about, of units with their results that a task keeps between slices; others are aligned again.
KEPT_BYTES, ENTRY_BYTES = 96 << 20, 400
#: Transitions that are kept; beyond that the memo starts anew.
MOST_TRANSITIONS = 1 << 20
#: Units that the libraries get at once.
AT_ONCE = 500
SLICE_BYTES = 8 << 20
SPACE = "▁"
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<struct<pair: long, n: long>>"


def byte_of_letter() -> dict[str, int]:
    """The byte that a letter of a byte-level vocabulary stands for: printable bytes stand for themselves, the others
    follow from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Transducer:
    """State 0: nothing dangles. Other states: a side leads (0 or 1) by a residual."""

    def __init__(self, tokens: tuple[list[bytes], list[bytes]]):
        self.tokens = tokens
        self.forget()

    def forget(self) -> None:
        self.number, self.states, self.leads, self.memo, self.first = {}, [(0, b"")], [0], [{}], {}
        self.transitions = 0

    def state(self, lead: int, residual: bytes) -> int:
        if not residual:
            return 0
        key = lead, residual
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.leads.append(lead)
            self.memo.append({})
        return self.number[key]

    def next(self, state: int, token: int) -> int:
        """The state after the side that is behind has given ``token``; -1 if the bytes differ."""
        lead, residual = self.states[state]
        own = self.tokens[1 - lead][token]
        if residual.startswith(own):
            to = self.state(lead, residual[len(own) :])
        else:
            to = self.state(1 - lead, own[len(residual) :]) if own.startswith(residual) else -1
        self.memo[state][token] = to
        self.transitions += 1
        return to

    def align(self, a: list[int], b: list[int]) -> tuple[list[int], list[tuple[int, int]]] | None:
        """Links (the token of a, then 32 bits for that of b), and the places in ``a`` and ``b`` where each group ends; None if
        the bytes differ."""
        if self.transitions > MOST_TRANSITIONS:
            self.forget()
        links, ends, i, j, n, m = [], [], 0, 0, len(a), len(b)
        leads, memo, first = self.leads, self.memo, self.first
        while i < n and j < m:  # both sides are at the same byte: the first one leads with its next token
            x = a[i]
            i += 1
            state = first.get(x) or first.setdefault(x, self.state(0, self.tokens[0][x]))
            while state:
                if leads[state]:
                    if i == n:
                        return None
                    token = x = a[i]
                    i += 1
                else:
                    if j == m:
                        return None
                    token = y = b[j]
                    j += 1
                links.append(x << 32 | y)
                to = memo[state].get(token)
                state = self.next(state, token) if to is None else to
                if state < 0:
                    return None
            ends.append((i, j))
        return (links, ends) if i == n and j == m else None


#: What is known of a unit: its tokens on either side, its groups (-1: the bytes differ), its links as int64 one after
#: another, and the text of its groups, each with a ";" at its end.
BROKEN = (0, 0, -1, b"", b"")


class Pair:
    """A byte-level vocabulary of the tokenizers library (a) and one of the sentencepiece library with byte fallback (b)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_of_letter(), self.a.get_vocab(with_added_tokens=False)
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else b""
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if self.a.normalizer is not None or "ByteLevel" not in repr(self.a.pre_tokenizer):
            raise ValueError(f"{a_path}: not a byte-level vocabulary without normal forms")
        if any(SPACE in p.lstrip(SPACE) or set(p) & set(" \t\n") for p in pieces) or self.b.encode("a  ", out_type=str)[0][0] != SPACE:
            raise ValueError(f"{b_path}: a blank does not separate pieces here")
        self.blank = self.b.piece_to_id(SPACE)
        self.transducer = Transducer((a_bytes, b_bytes))
        self.names = [str(i) for i in range(len(a_bytes))], [f"|{i};" for i in range(len(b_bytes))]
        self.forget()

    def forget(self) -> None:
        self.kept, self.room = {}, KEPT_BYTES
        self.transducer.forget()

    def encode(self, units: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """The tokens of both sides of each unit, as they are in any text that holds it at its place."""
        found = self.a.encode_batch([units], is_pretokenized=True, add_special_tokens=False)[0]
        ids, ends = found.ids, np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(units) + 1)).tolist()
        # The library puts a blank in front of a text. A unit has its own, or begins with what no piece joins to a blank.
        pieces = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for k, (u, own) in enumerate(zip(units, pieces, strict=True)):
            yield ids[ends[k] : ends[k + 1]], ([self.blank] if u == " " else own if u[0] == " " else own[1:])

    def align(self, units: list[str]) -> list[tuple]:
        found = [*map(self.kept.get, units)]
        new = [i for i, x in enumerate(found) if x is None]
        for at in range(0, len(new), AT_ONCE):
            part = new[at : at + AT_ONCE]
            for i, (a, b) in zip(part, self.encode([units[i] for i in part]), strict=True):
                found[i] = self._unit(units[i], a, b)
                if self.room > 0:
                    self.kept[units[i]] = found[i]
                    self.room -= len(units[i]) + len(found[i][3]) + len(found[i][4]) + ENTRY_BYTES
        return found

    def _unit(self, text: str, a: list[int], b: list[int]) -> tuple:
        tokens, (names, more) = self.transducer.tokens[0], self.names
        aligned = self.transducer.align(a, b) if b"".join([tokens[i] for i in a]) == text.encode() else None
        if aligned is None:
            return BROKEN
        links, ends = aligned
        groups, i, j = "", 0, 0
        for p, q in ends:
            if p - i == 1 and q - j == 1:
                groups += names[a[i]] + more[b[j]]
            else:
                groups += f"{','.join([names[x] for x in a[i:p]])}|{','.join(map(str, b[j:q]))};"
            i, j = p, q
        return len(a), len(b), len(ends), array("q", links).tobytes(), groups.encode()


def cut_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of units, their offsets by text, and the distinct units. Empty texts have none.

    A unit begins at a blank, tab or line feed after a visible character, and at a text's own blank. After characters that
    look like the other white space of Unicode by their first bytes none begins, so a unit may be longer than it had to be.
    """
    full = pc.greater(pc.binary_length(texts), 0)
    spaced = pc.if_else(full, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string())), pa.scalar("", pa.large_string()))
    ends = np.frombuffer(spaced.buffers()[1], dtype=np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    if ends[-1] == ends[0]:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), pa.array([], pa.large_string())
    data = spaced.buffers()[2]
    x = np.frombuffer(data, dtype=np.uint8)[: ends[-1]]
    begins = (x == 32) | (x == 9) | (x == 10)
    begins[1:] &= ~((x[:-1] <= 32) | (x[:-1] == 127))
    begins[2:] &= ~((x[:-2] == 0xC2) & ((x[1:-1] == 0x85) | (x[1:-1] == 0xA0)))
    for lead, second in ((0xE1, 0x9A), (0xE1, 0xA0), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)):
        begins[3:] &= ~((x[:-3] == lead) & (x[1:-2] == second))
    starts = ends[:-1][np.diff(ends) > 0]
    begins[: ends[0]] = False
    begins[starts] = True
    at = np.flatnonzero(begins)
    units = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, ends[-1])), data).dictionary_encode()
    return units.indices.to_numpy(zero_copy_only=False), np.searchsorted(at, ends), units.dictionary


def _lists(values: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(values), dtype=kind)
    lengths = np.fromiter(map(len, values), np.int64, len(values)) // flat.itemsize
    return flat, np.cumsum(lengths) - lengths, lengths


def _sums(values: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values[codes], dtype=np.int64)))[offsets])


def align_slice(pair: Pair, texts: pa.Array, with_groups: bool) -> dict[str, pa.Array]:
    """The columns of ``ALIGNED`` from n_a on."""
    codes, offsets, distinct = cut_units(texts)
    units = pair.align(distinct.to_pylist())
    n_a, n_b, n_groups = (np.array([u[k] for u in units], dtype=np.int64) for k in range(3))
    broken = _sums(n_groups < 0, codes, offsets) > 0
    if broken.any():  # of these texts no unit counts
        keep = np.repeat(~broken, np.diff(offsets))
        codes, offsets = codes[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]
    out = {"n_a": _sums(n_a, codes, offsets), "n_b": _sums(n_b, codes, offsets), "n_groups": _sums(n_groups, codes, offsets)}
    # groups: one after another, each with its ";" but the last of a text
    written = pa.array([u[4] for u in units], pa.large_binary()).take(pa.array(codes))
    ends = np.frombuffer(written.buffers()[1], dtype=np.int64)[offsets] if len(codes) else offsets
    flat = memoryview(written.buffers()[2]) if len(codes) else memoryview(b"")
    spans = [(s, e) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    out["groups"] = pa.array([bytes(flat[s : e - 1]).decode() if e > s else "" for s, e in spans] if with_groups else [None] * len(spans), pa.string())
    out["groups_sha256"] = pa.array([hashlib.sha256(flat[s : e - 1]).hexdigest() if e > s else "" for s, e in spans], pa.string())
    # links: how often a text has each pair of tokens
    links, at, lengths = _lists([u[3] for u in units], np.int64)
    keys, links = np.unique(links, return_inverse=True)
    of_word = lengths[codes]
    bounds = np.concatenate(([0], np.cumsum(of_word)))[offsets]
    out["n_links"] = np.diff(bounds)
    here = np.repeat(np.arange(len(texts)), np.diff(bounds)) * max(1, len(keys)) + gather(links, at[codes], of_word)
    here, n = np.unique(here, return_counts=True)
    text, key = np.divmod(here, max(1, len(keys)))
    ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(keys[key], pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])
    out["pairs"] = pa.ListArray.from_arrays(pa.array(ends), pairs)
    return {k: out[k] if isinstance(out[k], pa.Array) else pa.array(out[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs")}


_pairs: dict[tuple[str, str], Pair] = {}


def align(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = True) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): numbers of tokens, groups and links, the groups as text and its hash, and
    for each linked pair of ids (32 bits each) how many links of the text hold it. ``row`` tells rows apart."""

    def run(batches):
        if (a_path, b_path) not in _pairs:
            _pairs.clear()
            _pairs[a_path, b_path] = Pair(a_path, b_path)
        pair, row = _pairs[a_path, b_path], TaskContext.get().partitionId() << 33
        try:
            for part in (p for b in batches for p in slices(b, most=SLICE_BYTES)):
                columns = align_slice(pair, texts_of(part.column(1)), with_groups)
                yield pa.record_batch([pa.array(np.arange(row, row + part.num_rows)), part.column(0), *columns.values()], names=["row", "doc_id", *columns])
                row += part.num_rows
        finally:
            pair.forget()
            give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, best): how many links of all texts hold the pair, and whether no pair of its b has more."""
    counts = write_table(aligned.select(F.inline("pairs")).groupBy("pair").agg(F.sum("n").alias("links")), "pair-counts")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))  # a row for each token of b at most
    return counts.join(F.broadcast(most), b == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """The rows of ``align``, with n_best (links whose pair is among its b's most frequent ones) and count_sum (the links'
    counts in all texts). The aligned rows are stored, so texts are encoded once; counts are broadcast behind a count, else
    Spark joins by pair."""
    aligned = write_table(align(docs, a_path, b_path, with_groups), "aligned")
    counts = small(write_table(pair_counts(aligned), "pairs"))
    n = F.col("n")
    sums = aligned.select("row", F.inline("pairs")).join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), n).otherwise(0)).alias("n_best"), F.sum(n * F.col("links")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.drop("pairs").join(sums, "row", "left").withColumns({c: F.coalesce(F.col(c), zero) for c in ("n_best", "count_sum")}).drop("row")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = link_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
