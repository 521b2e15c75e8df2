"""Token counts: whole texts encoded in batches inside Arrow functions.

Byte-level vocabularies split a text by a pattern before they merge bytes, so a
text may be cut wherever that pattern must end a match.  The places used here
are plain to see: before white space after another character (no match holds
that pair, and the pattern looks ahead only from white space), between Latin
letters or digits and ASCII punctuation (save that an apostrophe may begin a
contraction), and between a single line break and a letter or digit.  The
pieces recur: a batch is split at spaces and its pieces are numbered by Arrow, so that
Python meets each distinct piece once, and encodes only what this worker hasn't met yet.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbostrat.llm.common import bound_batches, fresh, lean, strings

#: Pieces of a worker's memory, about 40 bytes each.
REMEMBERED = 400_000
#: Pieces that are joined to one text for the library, and pieces of which the ids are put together at once.
JOINED, TOGETHER = 1000, 1 << 18

_ALNUM = "A-Za-z0-9À-ÖØ-öø-ÿ"
_PUNCT = r"!-/:-@\[-`{-~"
_QUIET = r"!-&(-/:-@\[-`{-~"  # without the apostrophe
_PIECE = re.compile(
    rf" ?[{_ALNUM}]++(?=[\x00-\x7f]|\Z)"  # letters and digits up to another ASCII character
    rf"| ?[{_PUNCT}]*[{_QUIET}](?=[{_ALNUM}\s]|\Z)"
    rf"|(?<=\S)\n(?=[{_ALNUM}])"
    r"|(?s:.)+?(?=(?<=\S) |\Z)"  # anything, up to a space after another character
)
# The same places for Arrow: in a text without odd spaces (after anything but visible ASCII or a Latin
# letter) it may be cut before every space; the others are where these patterns' two groups meet.
_ODD_SPACE = r"[^\x{21}-\x{7e}\x{c0}-\x{24f}] |\x00"
_MEET = [(rf"([{_ALNUM}])([{_QUIET}])", "\\1\0\\2"), (rf"([{_QUIET}])([{_ALNUM}])", "\\1\0\\2"), (rf"([\x{{21}}-\x{{7e}}\x{{c0}}-\x{{24f}}])\n([{_ALNUM}])", "\\1\0\n\0\\2")]
#: Pieces that may follow each other in one text: it may be cut before each.
_JOINS = r"^ [\x{21}-\x{7e}\x{c0}-\x{24f}]+$"
_COARSE = re.compile(r"(?s:.)+?(?=(?<=\S) |\Z)")
_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


class PieceEncoder:
    """Encodes pieces with a public vocabulary file and remembers their ids.

    keep turns the encoding of a piece into what ``learn`` returns. The memory is made of Arrow and NumPy
    arrays, some 40 bytes a piece: ``pieces``, their ``ids`` in one array, and how many each has.
    """

    def __init__(self, path: str, keep):
        self.keep, self.pieces = keep, pa.array([], pa.large_string())
        self.ids, self.sizes, self.widths = np.zeros(0, np.uint32), np.zeros(0, np.int64), None
        self.again = np.zeros(0, bool)  # whether a piece was met again since it came or was last kept
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.encode = lambda new: self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            spec = self.tokenizer.pre_tokenizer
            self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.splits = self.tokenizer.normalizer is None and type(spec).__name__ == "ByteLevel" and not spec.add_prefix_space
            self.splits &= not any(c.isspace() for t in self.special for c in t)
        elif path.endswith(".model"):
            import sentencepiece

            self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda new: self.tokenizer.encode(new, num_threads=1)
            self.splits, self.special = False, []  # it adds a prefix and merges across spaces
        else:
            raise ValueError(f"not a .json or .model vocabulary: {path}")

    def cut(self, text: str) -> list[str]:
        """Pieces that give ``text`` when joined, and its ids when encoded apart.

        A text with special strings is cut at spaces alone, for they hold none.
        """
        if not self.splits:
            return [text] if text else []
        return (_COARSE if any(t in text for t in self.special) else _PIECE).findall(text)

    def learn(self, parts: list[str]) -> list:
        """What is kept of each part, encoded apart."""
        return [self.keep(x) for x in self.encode(parts)]

    def apart(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and how many each has; each part is a text for the library."""
        found = [array("I", x if isinstance(x, list) else x.ids) for x in self.encode(parts)]
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def joined(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """The same of parts that begin with a space and go on in visible characters, which encode in one
        text as they do apart; None unless an id ends where each of them does."""
        if self.widths is None:  # bytes of each id: a byte-level token has a character for each
            words = self.tokenizer.get_vocab()
            self.widths = np.zeros(max(words.values(), default=0) + 1, np.int64)
            self.widths[list(words.values())] = [len(x) for x in words]
        texts = ["".join(parts.slice(k, JOINED).to_pylist()) for k in range(0, len(parts), JOINED)]
        ids = self.apart(texts)[0]
        reached, wanted = np.cumsum(self.widths[ids]), np.cumsum(pc.binary_length(parts).to_numpy())
        at = np.searchsorted(reached, wanted)
        if not len(ids) or reached[-1] != wanted[-1] or (reached[at] != wanted).any():
            return None
        return ids, np.diff(at + 1, prepend=0)

    def encoded(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in order, and how many each has."""
        plain = pc.match_substring_regex(parts, _JOINS) if self.splits else pa.array(np.zeros(len(parts), bool))
        for special in self.special:
            plain = pc.and_not(plain, pc.match_substring(parts, special))
        plain = plain.to_numpy(zero_copy_only=False)
        some = parts.filter(pa.array(plain))
        if not plain.any() or (quick := self.joined(some)) is None:
            return self.apart(parts.to_pylist())
        slow = self.apart(parts.filter(pa.array(~plain)).to_pylist())
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        ids, sizes = (np.concatenate(x) for x in zip(quick, slow, strict=True))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return gathered(ids, sizes, place), sizes[place]

    def recall(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encoded``, of parts that differ; what this worker has met lately isn't encoded again."""
        if not self.splits:
            return self.encoded(parts)
        known = pc.index_in(parts, value_set=self.pieces)
        new = parts.filter(known.is_null())
        ids, sizes = self.encoded(new)
        which = pc.fill_null(known, -1).to_numpy().astype(np.int64)
        which[which < 0] = len(self.pieces) + np.arange(len(new))
        pieces = pa.concat_arrays([self.pieces, new])
        ids, sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        out = gathered(ids, sizes, which), sizes[which]
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        self.again[which[which < len(self.pieces)]] = True
        self.pieces, self.ids, self.sizes = pieces, ids, sizes
        if len(pieces) > REMEMBERED:
            self.forget(which)
        return out

    def forget(self, latest: np.ndarray) -> None:
        """Keep the pieces met in the latest batch and, where they fit, those met more than once of late."""
        kept = np.zeros(len(self.pieces), bool)
        kept[latest] = True
        if np.count_nonzero(kept | self.again) <= REMEMBERED * 3 // 4:
            kept |= self.again
        which = np.flatnonzero(kept)
        self.ids = gathered(self.ids, self.sizes, which)
        self.pieces, self.sizes, self.again = self.pieces.take(pa.array(which)), self.sizes[which], np.zeros(len(which), bool)


def gathered(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ids of the pieces numbered by ``which``, one after the other; ids holds those of all pieces."""
    begin, out = np.cumsum(sizes) - sizes, []
    for start in range(0, len(which), TOGETHER):
        some = which[start : start + TOGETHER]
        each = sizes[some]
        out.append(ids[np.repeat(begin[some] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))])
    return np.concatenate(out) if out else ids[:0]


def encoder(path: str, purpose: str, keep) -> PieceEncoder:
    """This worker's encoder for one vocabulary and purpose."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, purpose) not in _ENCODERS:
        _ENCODERS[path, purpose] = PieceEncoder(path, keep)
    return _ENCODERS[path, purpose]


def by_size(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def looked_up(texts: pa.Array, enc: PieceEncoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sizes, which, n): the ids of distinct pieces and how many each has, the pieces of all texts in order by number, and how many each text has.

    Texts with odd spaces or special strings, and all of them where pieces can't be
    encoded apart, are cut one by one.
    """
    odd = pc.match_substring_regex(texts, _ODD_SPACE) if enc.splits else pa.array(np.ones(len(texts), bool))
    for special in enc.special:
        odd = pc.or_(odd, pc.match_substring(texts, special))
    odd = odd.to_numpy(zero_copy_only=False)
    marked = pc.replace_substring(texts.filter(pa.array(~odd)), " ", "\0 ")
    for pattern, cut in _MEET:
        marked = pc.replace_substring_regex(marked, pattern, cut)
    split = pc.split_pattern(marked, "\0")
    n = np.zeros(len(texts), np.int64)
    n[~odd] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    pieces = pc.list_flatten(split).dictionary_encode()
    parts, which = pieces.dictionary, pieces.indices.to_numpy(zero_copy_only=False)
    if odd.any():
        number, every, at = {x: i for i, x in enumerate(parts.to_pylist())}, [], 0
        for k in range(len(texts)):
            if odd[k]:
                cut = enc.cut(texts[k].as_py())
                every.append(np.array([number.setdefault(x, len(number)) for x in cut], np.int64))
                n[k] = len(cut)
            else:
                every.append(which[at : at + n[k]])
                at += n[k]
        parts, which = pa.array(list(number), pa.large_string()), np.concatenate(every)
    return *enc.recall(parts), which, n


def per_text(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the values of each text's pieces."""
    total, ends = np.concatenate([[0], np.cumsum(values, dtype=np.int64)]), np.cumsum(n)
    return total[ends] - total[ends - n]


def count_batch(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text."""
    _, sizes, which, n = looked_up(texts, encoder(path, "lengths", len))
    return per_text(sizes[which], n)


def as_bytes(kind: str):
    """Keeps the ids of a piece as bytes of ``kind``."""
    code = {"<u2": "H", "<u4": "I"}[kind]
    return lambda encoding: array(code, encoding if isinstance(encoding, list) else encoding.ids).tobytes()


def ids_batch(texts: pa.Array, enc: PieceEncoder, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in order as ``kind``, and how many each text has."""
    ids, sizes, which, n = looked_up(texts, enc)
    return gathered(ids.astype(kind), sizes, which), per_text(sizes[which], n)


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` without its text, with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    docs: any table with a string column named by ``text``; other columns pass
    through, save those named like the three results, which are replaced.
    path: a .json vocabulary for tokenizers or a .model for sentencepiece.
    A null text counts as empty: 0 bytes, 0 tokens, not over the limit. Repeated
    rows are counted one by one; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    results, body = ("n_bytes", "n_tokens", "over_limit"), fresh("text")
    kept = [c for c in docs.columns if c not in (*results, text)]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(body))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != body]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(body))
            counts = count_batch(texts, path)
            columns = [batch.column(c) for c in kept]
            columns += [pc.binary_length(texts).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *results])

    return given.mapInArrow(lean(run), ", ".join([*fields, "n_bytes bigint", "n_tokens bigint", "over_limit boolean"]))
