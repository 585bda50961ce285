"""Token counts of whole texts.

Texts go to Arrow functions; only lengths come back. Inside a task, rows are grouped into batches balanced by bytes. Every
text is cut at safe boundaries (in front of white space that follows other text), so a very long text is never encoded at
one go, and equal pieces are encoded once per worker: a bounded memo holds the lengths of pieces already seen.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows give repeated results; an empty table gives
an empty result; other columns are ignored unless listed in ``carry``, as are columns named like the operator's own. A piece without
any boundary (a very long run of letters) is encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import byte_slices

#: Fixed value: Unicode white space, as the tokenizers' patterns understand it.
_SPACE = "\t-\r \x85\xa0  -     　"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: A letter run that other characters follow: the only boundaries used inside a piece without white space.
_LETTERS = re.compile(r"[^\W\d_]+|[\W\d_]+")

#: Texts that need more care than single blanks and line feeds between other characters.
_ODD = r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[\t\x0b-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_tokenizers: dict[str, object] = {}
_memos: dict[str, dict[str, int]] = {}


def load_tokenizer(path: str) -> object:
    """The tokenizer of a .json file, loaded once per worker; it encodes on the task's own core only."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def safe_pieces(text: str, special: tuple[str, ...] = (), longest: int = 65536) -> list[str]:
    """Cut a text where no token of a byte-level tokenizer can span: in front of white space that follows other text. A
    piece over ``longest`` characters is cut further after runs of letters, unless it holds a special string."""
    pieces = _PIECE.findall(text)
    if len(text) <= longest or max(map(len, pieces)) <= longest:
        return pieces
    out: list[str] = []
    for p in pieces:
        if len(p) <= longest or any(s in p for s in special):
            out.append(p)
            continue
        part: list[str] = []
        size = 0
        for run in _LETTERS.findall(p):
            # a cut stands only between a letter run and what follows it
            if size >= longest and part and part[-1][-1].isalpha() and not run[0].isalpha():
                out.append("".join(part))
                part, size = [], 0
            part.append(run)
            size += len(run)
        out.append("".join(part))
    return out


class PieceLengths:
    """Token lengths of pieces, memoised up to ``capacity`` pieces (then started anew, so memory is bounded)."""

    def __init__(self, path: str, batch_bytes: int, capacity: int = 1 << 20, longest_kept: int = 64) -> None:
        self.tokenizer = load_tokenizer(path)
        self.memo = _memos.setdefault(path, {})
        self.batch_bytes, self.capacity, self.longest_kept = batch_bytes, capacity, longest_kept

    def encode(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for a, b in byte_slices([len(p) for p in pieces], self.batch_bytes):
            out += [len(e) for e in self.tokenizer.encode_batch_fast(pieces[a:b], add_special_tokens=False)]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Make lengths of all these pieces available in the memo."""
        memo = self.memo
        if len(memo) > self.capacity:
            memo.clear()
        missing = [p for p in pieces if p not in memo]
        stems = {p[:-1] for p in missing if len(p) > 1 and p[-1] in ".,;:!?" and p[-2].isalpha()}
        direct = [p for p in missing if not (len(p) > 1 and p[-1] in ".,;:!?" and p[-2].isalpha())]
        direct += [s for s in stems if s not in memo and s not in pieces]
        memo.update(zip(direct, self.encode(direct), strict=True))
        # a stop after a letter is a token of its own
        memo.update((p, memo[p[:-1]] + 1) for p in sorted(missing, key=len) if p not in memo)

    def lengths(self, texts: pa.Array, special: tuple[str, ...]) -> np.ndarray:
        """Token lengths of all texts."""
        out = np.zeros(len(texts), np.int64)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy() > 1 << 20)
        if odd.any():
            out[odd] = self.cut_lengths(texts.filter(pa.array(odd)).to_pylist(), special)
        if not odd.all():
            out[~odd] = self.even_lengths(texts.filter(pa.array(~odd)))
        return out

    def even_lengths(self, texts: pa.Array) -> np.ndarray:
        """Of texts with single blanks and line feeds only: every blank and line feed opens a piece."""
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        words = lists.flatten()
        coded = words.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        first = words.take(pa.array(offsets[:-1])).to_pylist()
        parts = [(" " + w).split("\n") for w in distinct]
        heads = [w.split("\n") for w in first]
        wanted = {p for ps in parts for p in ps} | {h[0] for h in heads}
        long = [p for p in wanted if len(p) > self.longest_kept]
        once = dict(zip(long, self.encode(long), strict=True)) if long else {}
        wanted.difference_update(long)
        self.learn(wanted)
        known = self.memo if not once else {**{p: self.memo[p] for p in wanted}, **once}
        table = np.fromiter((sum(known[p] for p in ps) + len(ps) - 1 for ps in parts), np.int64, len(parts))
        total = np.add.reduceat(table[codes], offsets[:-1])
        # the first word of a text has no blank before it
        opened = np.fromiter((known[h[0]] for h in heads), np.int64, len(heads))
        blank = np.fromiter((known[" " + h[0]] for h in heads), np.int64, len(heads))
        return total - blank + opened

    def cut_lengths(self, texts: list[str], special: tuple[str, ...]) -> list[int]:
        """Of any texts, by their safe pieces."""
        cut = [safe_pieces(t, special) for t in texts]
        wanted: set[str] = set()
        for pieces in cut:
            wanted.update(pieces)
        long = [p for p in wanted if len(p) > self.longest_kept]
        wanted.difference_update(long)
        once = dict(zip(long, self.encode(long), strict=True)) if long else {}
        self.learn(wanted)
        get = self.memo.__getitem__
        return [sum(once[p] if p in once else get(p) for p in pieces) for pieces in cut]


def _counter(path: str, n_carry: int, limit: int, batch_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = PieceLengths(path, batch_bytes)
        special = tuple(t.content for t in lengths.tokenizer.get_added_tokens_decoder().values())
        for batch in batches:
            sizes = batch.column(n_carry + 1).to_pylist()
            counts: list[int] = []
            for a, b in byte_slices(sizes, 16 * batch_bytes):
                counts += lengths.lengths(batch.column(n_carry).slice(a, b - a), special).tolist()
            n = pa.array(counts, pa.int64())
            over = pa.array([c > limit for c in counts], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_carry], batch.column(n_carry + 1), n, over], names=[*batch.schema.names[:n_carry], "n_bytes", "n_tokens", "over_limit"])

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), limit: int = 512, batch_bytes: int = 1 << 20) -> DataFrame:
    """``carry`` columns, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row. The plan is a scan and
    one Arrow function: nothing is shuffled, and texts never come back from Python."""
    carry = tuple(c for c in carry if c.lower() not in ("n_bytes", "n_tokens", "over_limit"))
    source = docs.select(*carry, F.coalesce(text_col, F.lit("")).alias("__text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("__bytes"))
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return source.mapInArrow(_counter(tokenizer_path, len(carry), limit, batch_bytes), schema)
