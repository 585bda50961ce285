"""Packing documents into sequences of a fixed window with little padding.

``tokenize_pieces`` turns documents into pieces of at most a window of token ids; ``pack_pieces`` gives each piece a place.
Only metadata of pieces is shuffled by packing, never texts (or ids, if the caller drops them first).

Packing is minimum bin slack. Pieces are dealt by hash (of their ids and their partition) into groups
of bounded size, so which pieces meet follows the split of the input. In a group, each window starts with
the longest remaining piece; dynamic programming over the multiset of remaining lengths, with one bit per reachable sum,
finds the sum closest to the window's capacity, and backtracking through the kept bit sets gives how many pieces of each
length make it. Each group leaves at most a few windows open at its end, so padding falls with the group size.

Defined results: a null or empty text is a document of one id, the end id; repeated rows are packed separately; an empty
table gives an empty result; ties go by length, then by the order columns; other columns are carried along, but for those whose
names (start, length, doc_tokens, ids, sequence_id, offset) the operator's own replace.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import byte_slices, fresh_name

_tokenizers: dict[str, object] = {}
_memos: dict[str, dict[str, bytes]] = {}


#: Words of these letters are one token group whatever stands around them, and no normal form changes them.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u024f]+")
_STOPS = ".,;:!?"


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds:
    """Ids of texts under a tokenizer that drops white space, so words between ASCII white space are independent: each
    distinct word is encoded once and looked up after that. The memo is bounded by ``capacity`` (then started anew)."""

    def __init__(self, path: str, capacity: int = 1 << 20, longest_kept: int = 64) -> None:
        if path not in _tokenizers:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            _tokenizers[path] = Tokenizer.from_file(path)
        self.tokenizer = _tokenizers[path]
        self.model = self.tokenizer.model
        self.memo = _memos.setdefault(path, {})
        self.capacity, self.longest_kept = capacity, longest_kept
        self.letters = _byte_letters()

    def _ids(self, word: str) -> bytes:
        if len(word) <= self.longest_kept:
            if _LATIN.fullmatch(word):
                low = word.lower()
                if not low.isascii():
                    low = low.encode().decode("latin-1").translate(self.letters)
                return array("I", [t.id for t in self.model.tokenize(low)]).tobytes()
            if word and word[-1] in _STOPS and _LATIN.fullmatch(word, 0, len(word) - 1):
                return self.known(word[:-1]) + self.known(word[-1])
        return array("I", self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids).tobytes()

    def known(self, word: str) -> bytes:
        ids = self.memo.get(word)
        if ids is None:
            ids = self._ids(word)
            if len(word) <= self.longest_kept:
                self.memo[word] = ids
        return ids

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts one after the other, an end id after each, and where each text begins (and the last ends)."""
        if len(self.memo) > self.capacity:
            self.memo.clear()
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        codes, word_at = coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ids = [self.known(w) for w in coded.dictionary.to_pylist()]
        pool = np.frombuffer(b"".join(ids), np.uint32)
        n_ids = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool_at = np.cumsum(n_ids) - n_ids
        length = n_ids[codes]
        ends = np.concatenate([[0], np.cumsum(length)])
        total = int(ends[-1])
        text_at = ends[word_at] + np.arange(len(texts) + 1)
        source = np.arange(total) + np.repeat(pool_at[codes] - ends[:-1], length)
        out = np.empty(total + len(texts), np.uint32)
        is_end = np.zeros(total + len(texts), bool)
        is_end[text_at[1:] - 1] = True
        out[is_end] = end_id
        out[~is_end] = pool[source]
        return out, text_at


def _tokenize(path: str, n_carry: int, window: int, end_id: int, batch_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for batch in batches:
            texts = batch.column(n_carry)
            sizes = pc.binary_length(texts).to_pylist()
            for a, b in byte_slices(sizes, batch_bytes):
                ids, at = words.texts(texts.slice(a, b - a), end_id)
                totals = np.diff(at)
                n_pieces = -(-totals // window)
                row = np.repeat(np.arange(b - a), n_pieces)
                start = window * (np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces))
                length = np.minimum(window, totals[row] - start)
                offsets = np.concatenate([at[row] + start, [at[-1]]])
                step = 64 * max(1, int(1 << 16) // window)
                for i in range(0, len(row), step):
                    part = slice(i, i + step)
                    cut = offsets[i : i + step + 1]
                    data = ids[cut[0] : cut[-1]].astype("<u4", copy=False)
                    binary = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(((cut - cut[0]) * 4).astype(np.int32)), pa.py_buffer(data)])
                    carried = [c.take(pa.array(row[part] + a)) for c in batch.columns[:n_carry]]
                    yield pa.RecordBatch.from_arrays([*carried, pa.array(start[part]), pa.array(length[part]), pa.array(totals[row[part]]), binary], names=[*batch.schema.names[:n_carry], "start", "length", "doc_tokens", "ids"])

    return run


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), window: int = 2048, end_id: int = 1, batch_bytes: int = 16 << 20) -> DataFrame:
    """Pieces of at most ``window`` ids of each text, with the end id after its last: ``carry`` columns, start (ids of the
    document before the piece), length, doc_tokens and ids (binary, little-endian unsigned 32-bit)."""
    carry = tuple(c for c in carry if c.lower() not in ("start", "length", "doc_tokens", "ids"))
    source = docs.select(*carry, F.coalesce(text_col, F.lit("")).alias("__text"))
    extra = [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens")]
    schema = T.StructType([*(docs.schema[c] for c in carry), *extra, T.StructField("ids", T.BinaryType())])
    return source.mapInArrow(_tokenize(tokenizer_path, len(carry), window, end_id, batch_bytes), schema)


def about_pieces(docs: DataFrame, *, text_col: str = "text", window: int = 2048, bytes_per_token: int = 2) -> int:
    """About how many pieces the texts make, from their lengths in bytes alone: one a document and one more for each window that
    its bytes may fill. Texts of fewer bytes a token make more, at most ``bytes_per_token`` times as many."""
    own = F.lit(1) + F.floor(F.octet_length(F.coalesce(text_col, F.lit(""))) / F.lit(bytes_per_token * window))
    return int(docs.agg(F.coalesce(F.sum(own), F.lit(0))).first()[0])


def fill_window(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """How many pieces of which lengths (longest first in ``lengths``) fill ``room`` best: one bit per reachable sum, one
    bit set kept per length for backtracking. Stops as soon as the room can be filled exactly."""
    full = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for n in lengths:
        if n > room or not counts[n]:
            continue
        steps.append((n, reach, counts[n]))
        left, unit = min(counts[n], room // n), 1
        while left:
            take = min(unit, left)
            reach |= (reach << (n * take)) & full
            left -= take
            unit <<= 1
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: list[tuple[int, int]] = []
    for n, before, most in reversed(steps):
        k = 0
        while not before >> total & 1:
            total -= n
            k += 1
            assert k <= most and total >= 0
        if k:
            used.append((n, k))
    return used


def pack_lengths(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of one group, given in a fixed order."""
    order = np.argsort(-lengths, kind="stable")
    stacks: dict[int, list[int]] = {}
    for i in reversed(order.tolist()):
        stacks.setdefault(int(lengths[i]), []).append(i)
    counts = {n: len(s) for n, s in stacks.items()}
    alive = sorted(counts, reverse=True)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while alive:
        first = alive[0]
        chosen = [(first, 1)]
        counts[first] -= 1
        if window > first:
            chosen += fill_window(counts, alive, window - first)
        at = 0
        for j, (n, k) in enumerate(chosen):
            for _ in range(k):
                i = stacks[n].pop()
                sequence[i], offset[i] = number, at
                at += n
            if j:
                counts[n] -= k
        if any(not counts[n] for n, _ in chosen):
            alive = [n for n in alive if counts[n]]
        number += 1
    return sequence, offset


def pack_pieces(pieces: DataFrame, *, window: int = 2048, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "start"), rows_per_group: int = 2048, n_rows: int | None = None) -> DataFrame:
    """Give every piece a sequence_id and an offset in it; all columns are carried. ``n_rows`` is the number of pieces if the
    caller knows about how many there are (it only sets the number of groups); otherwise they are counted."""
    if n_rows is None:
        n_rows = pieces.count()
    groups = max(1, -(-n_rows // rows_per_group))
    pieces = pieces.drop(*(c for c in pieces.columns if c.lower() in ("sequence_id", "offset")))
    key = fresh_name(pieces, "__group")
    # the partition is part of the key, so rows with one id (or none) don't meet in one group
    dealt = pieces.withColumn(key, F.pmod(F.xxhash64(*order, F.spark_partition_id(), F.lit(11)), F.lit(groups)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in schema.fields]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable", na_position="last").reset_index(drop=True)
        sequence, offset = pack_lengths(pdf[length_col].to_numpy(np.int64), window)
        pdf["sequence_id"] = (int(pdf[key].iloc[0]) << 40) + sequence
        pdf["offset"] = offset
        return pdf[names]

    return dealt.groupBy(key).applyInPandas(pack, schema)
