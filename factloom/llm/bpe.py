"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

With the split pattern ``GPT2`` a text is cut at every single space that has a non-space on both sides, and the parts
after the letters of their first word: the pattern starts a new match at each such place, so encoding the pieces one
by one gives exactly the ids of the whole text. Each worker keeps a bounded table from piece to ids; only pieces that
it lacks go to the library, words of letters straight to its BPE model, all others through the whole tokenizer.
Emptying that table changes no result. With any other pattern, whole texts go to the library.

Special tokens of a vocabulary file are recognised in texts, as the library does by default; none is added.

Edge cases: a null text is encoded as the empty text (no ids, empty decoded bytes); a text of any length is encoded
whole; ids and documents may repeat, each row is handled alone; an empty table gives an empty result; columns other
than the two named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pieces in a worker's table from which on those go that no later batch had, and the longest piece that is kept.
CACHE_PIECES, CACHE_PIECE_BYTES = 100_000, 48
#: The split pattern for which texts may be cut as the module says.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACES = r"\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts with white space beside a space (in RE2, which knows no Unicode in ``\s``) are cut by the regular expression above.
_ODD_RE2 = rf"  |^ | $|[\n{_SPACES}] | [\n{_SPACES}]"
#: Letters in every version of Unicode; a part is cut where a run of them meets an ASCII sign that is no letter.
_LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}"
_WORD_RE2 = rf"^ [{_LETTERS}]+$"
_HEAD_RE2 = rf"^(?P<head>[{_LETTERS}]+)(?P<tail>[\n!-@\[-`{{-~](?s:.*))$"


def byte_table() -> dict[int, str]:
    """The byte-to-character table of byte-level BPE: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + n)
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def ranks_tokenizer(ranks: dict[bytes, int], pattern: str):
    """A ``tokenizers`` BPE whose merges follow the ranks of a ``tiktoken`` file.

    Every way to make a token from two tokens becomes a merge, in rank order; a match that is a token itself is
    taken whole (``ignore_merges``).
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_table()
    name = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [
        (name[t[:i]], name[t[i:]])
        for t in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(t))
        if t[:i] in ranks and t[i:] in ranks
    ]
    tok = Tokenizer(models.BPE(vocab={name[t]: i for t, i in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tok


def _gather(store: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``which`` of a table of lists (``start`` and ``size`` in ``store``) end to end, and their bounds."""
    n = size[which]
    ends = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    place = np.repeat(start[which] - ends[:-1], n)
    place += np.arange(len(place))
    return store[place], ends


class Codec:
    """Encodes and decodes whole texts; made once a worker from a vocabulary file."""

    def __init__(self, path: str, pattern: str | None = None, most_pieces: int = CACHE_PIECES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path.endswith(".json"):
            self.tok = Tokenizer.from_file(path)
            with open(path, "rb") as f:
                spec = json.load(f)
            plain = spec.get("normalizer") is None and spec.get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            # a special token must not span a cut
            self.cuts = plain and not any(re.search(r"\s", t["content"]) or t["content"][:1].isalpha() or any(t[k] for k in ("lstrip", "rstrip", "single_word")) for t in spec.get("added_tokens") or ())
        else:
            self.tok = ranks_tokenizer(read_ranks(path), pattern)
            self.cuts = pattern == GPT2
        chars = byte_table()
        back = {c: b for b, c in chars.items()}
        self.named = str.maketrans({chr(b): c for b, c in chars.items()})
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.pieces = np.empty(max(vocab.values(), default=-1) + 1, dtype=object)
        self.pieces[:] = b""
        for t, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        self.most_pieces = most_pieces
        # entry 0 of the table is the empty piece
        self.known: dict[str, int] = {"": 0}
        self.store, self.start, self.size, self.again = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, bool)

    def _shrink(self) -> None:
        """Keep what was asked for again, or nothing if that is most of the table; long pieces go in any case."""
        self.again[0] = True
        keep = self.again if self.again.sum() <= self.most_pieces // 2 else np.arange(len(self.again)) == 0
        number = np.cumsum(keep) - 1
        self.known = {p: int(number[i]) for p, i in self.known.items() if keep[i]}
        which = np.flatnonzero(keep)
        self.store, ends = _gather(self.store, self.start, self.size, which)
        self.start, self.size, self.again = ends[:-1], self.size[which], np.zeros(len(which), bool)

    def _ids(self, pieces: list[str], is_word: np.ndarray) -> list[list[int]]:
        """Ids of each piece. A word (a space and letters) is one match of the pattern, so the model alone gives them."""
        tokenize = self.tok.model.tokenize
        out: list = [None] * len(pieces)
        other = np.flatnonzero(~is_word).tolist()
        for k, e in zip(other, self.tok.encode_batch_fast([pieces[k] for k in other], add_special_tokens=False), strict=True):
            out[k] = e.ids
        words = np.flatnonzero(is_word).tolist()
        names = "\n".join([pieces[k] for k in words]).encode().decode("latin-1").translate(self.named).split(self.named[10])
        for k, name in zip(words, names if words else (), strict=True):
            out[k] = [t.id for t in tokenize(name)]
        return out

    def _look_up(self, pieces: pa.Array) -> np.ndarray:
        """Entries of distinct pieces in the table, which gets those that it lacks."""
        if len(self.start) > self.most_pieces:
            self._shrink()
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        out = np.fromiter(map(self.known.get, names, itertools.repeat(-1)), np.int64, len(names))
        lack = np.flatnonzero(out < 0)
        self.again[out[out >= 0]] = True
        if len(lack):
            new = pieces.take(pa.array(lack))
            new_names = new.to_numpy(zero_copy_only=False).tolist()
            ids = self._ids(new_names, pc.match_substring_regex(new, _WORD_RE2).to_numpy(zero_copy_only=False))
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            out[lack] = at = len(self.start) + np.arange(len(ids))
            self.start = np.concatenate((self.start, len(self.store) + np.cumsum(n) - n))
            self.size = np.concatenate((self.size, n))
            self.again = np.concatenate((self.again, np.zeros(len(n), bool)))
            self.store = np.concatenate((self.store, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(n.sum()))))
            long = pc.binary_length(new.cast(pa.large_binary())).to_numpy() > CACHE_PIECE_BYTES
            self.known.update(zip(new_names, at.tolist(), strict=True))
            for k in np.flatnonzero(long).tolist():
                del self.known[new_names[k]]
        return out

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text's ids begin and end in it.

        Cutting, finding the distinct pieces and putting ids in place run in Arrow and NumPy; Python only sees each
        distinct piece of a batch once.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.cuts:
            ids = [e.ids for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            at = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64))).astype(np.int64)
            return np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(at[-1])), at
        odd = pc.match_substring_regex(texts, _ODD_RE2)
        if pc.any(odd).as_py():
            cut = pa.array([_CUT.split(t) if o else t.split(" ") for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], pa.large_list(pa.large_string()))
        else:
            cut = pc.split_pattern(texts, " ")
        at = cut.offsets.to_numpy().astype(np.int64)
        parts = cut.values.slice(at[0], at[-1] - at[0])
        at = at - at[0]
        coded = parts.dictionary_encode()
        split = pc.extract_regex(coded.dictionary, _HEAD_RE2)
        heads = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.coalesce(pc.struct_field(split, 0), coded.dictionary), pa.scalar("", pa.large_string()))
        tails = pc.fill_null(pc.struct_field(split, 1), "")
        firsts = parts.take(pa.array(at[:-1]))  # no space before these
        pieces = pa.concat_arrays([heads.cast(pa.large_string()), tails.cast(pa.large_string()), firsts]).dictionary_encode()
        entry = self._look_up(pieces.dictionary)[pieces.indices.to_numpy()]
        n = len(heads)
        pairs = np.zeros((n + len(firsts), 2), np.int64)
        pairs[:n, 0], pairs[:n, 1], pairs[n:, 0] = entry[:n], entry[n : 2 * n], entry[2 * n :]
        table, ends = _gather(self.store, self.start, self.size, pairs.ravel())
        ends = ends[::2]
        which = coded.indices.to_numpy().astype(np.int64)
        which[at[:-1]] = n + np.arange(len(firsts))
        flat, ends = _gather(table, ends[:-1], np.diff(ends), which)
        return flat.astype("<u4", copy=False), ends[at]

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        flat, at = self.encode_flat(pa.array(texts, pa.string()))
        return [flat[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; a character split over tokens comes together again here."""
        return b"".join(self.pieces[ids].tolist())

    def decode_text(self, ids: np.ndarray) -> str:
        """The text of the ids. A piece of a character at either end becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each token in bytes and in characters. A token that begins inside a character gets its index."""
        lengths = np.fromiter((len(self.pieces[i]) for i in ids), np.int64, len(ids))
        starts = np.cumsum(lengths) - lengths
        raw = np.frombuffer(self.decode_bytes(ids), np.uint8)
        seen = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        inside = np.zeros(len(starts), np.int64)
        ok = starts < len(raw)
        inside[ok] = (raw[starts[ok]] & 0xC0) == 0x80
        return starts, seen[starts] - inside


def codec(path: str, pattern: str | None = None) -> Codec:
    """The codec of this worker."""
    return common.resident(("codec", path, pattern), lambda: Codec(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``id_col``, ``ids array<int>`` and, if asked for, ``byte_starts`` and ``char_starts`` of each row's whole text."""
    common.arrow_limits(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            flat, at = c.encode_flat(b.column(1))
            packed = np.split(flat, at[1:-1]) if b.num_rows else []
            cols = [b.column(0), pa.array([x.astype("<i4") for x in packed], pa.list_(pa.int32()))]
            if offsets:
                both = [c.offsets(x) for x in packed]
                cols += [pa.array([x[k] for x in both], pa.list_(pa.int64())) for k in (0, 1)]
            names = [id_col, "ids", "byte_starts", "char_starts"][: len(cols)]
            yield pa.RecordBatch.from_arrays(cols, names)

    more = ", byte_starts array<bigint>, char_starts array<bigint>" if offsets else ""
    return src.mapInArrow(common.trimmed(run), f"`{id_col}` {kind}, ids array<int>{more}")


def decode(tokens: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``raw`` (bytes) and ``text`` of each row's ids; null ids decode to null."""
    common.arrow_limits(tokens.sparkSession)
    src = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            raw = [None if x is None else c.decode_bytes(np.asarray(x, np.int64)) for x in b.column(1).to_pylist()]
            text = [None if x is None else x.decode("utf-8", "replace") for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(text, pa.string())], [id_col, "raw", "text"])

    return src.mapInArrow(common.trimmed(run), f"`{id_col}` {kind}, raw binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids again: ``id_col, n_tokens, ids_sha256, decoded_sha256``.

    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256`` over the bytes that the ids stand for.
    """
    common.arrow_limits(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        digits = np.array([str(i) for i in range(len(c.pieces))], dtype=object)
        for b in batches:
            n, ids_sha, raw_sha = [], [], []
            flat, at = c.encode_flat(b.column(1))
            for ids in np.split(flat, at[1:-1]) if b.num_rows else ():
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(digits[ids].tolist()).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(c.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(common.trimmed(run), f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
