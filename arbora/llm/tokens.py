"""Token counts and token ids of whole texts, in Arrow functions.

Texts are cut at boundaries that no token can cross, so the tokens of a text are those of its
segments in order. Segments that were met before come from a bounded memo; the others go to the
library in batches balanced by bytes. Only lengths (or packed ids) leave the functions.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import for_python, text_of

#: Characters of a text that are worked on at once.
STRETCH = 1 << 20
#: Bytes of segments that go to the library in one call.
CALL_BYTES = 1 << 18
#: Characters of texts that are split and numbered together.
GROUP = 1 << 22
#: Segments in each half of a memo of counts, and words in one of ids.
MEMO, MEMO_WORDS = 70_000, 180_000
#: Different segments of a group of texts that Python holds apart at once.
SEGMENTS = 1 << 12


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Cut a long text after each ``size`` characters, before the next space that follows a letter.

    A stretch other than the first begins with the space at which it was cut. A text without
    such a space stays whole.
    """
    start = 0
    while len(text) - start > size:
        at = start + size
        while (at := text.find(" ", at)) > 0 and not text[at - 1].isalnum():
            at += 1
        if at <= 0:
            break
        yield text[start:at]
        start = at
    yield text[start:] if start else text


def balanced(items: Iterable[str], most: int = CALL_BYTES) -> Iterator[list[str]]:
    """Lists of strings of about ``most`` bytes; a longer string comes alone."""
    out, size = [], 0
    for x in items:
        if out and size + len(x) > most:
            yield out
            out, size = [], 0
        out.append(x)
        size += len(x)
    if out:
        yield out


class Memo:
    """Two generations: a full young one becomes the old one, what is used again moves back."""

    def __init__(self, make: Callable[[list[str]], list], size: int = MEMO):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def values(self, keys: list[str]) -> list:
        absent = set(keys).difference(self.young)
        if absent and len(self.young) + len(absent) > self.size:
            self.old, self.young, absent = self.young, {}, set(keys)
        if absent:
            again = absent & self.old.keys()
            self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
            new = list(absent - again)
            self.young.update(zip(new, self.make(new), strict=True))
        return list(map(self.young.__getitem__, keys))


def in_batches(texts: Iterable[str], cut: Callable[[str, bool], list[str]], values: Callable[[list[str]], list]) -> Iterator[tuple[int, list]]:
    """(text's number, values of some of its segments) in order, for many short texts at a time."""
    keys: list[str] = []
    ends: list[tuple[int, int]] = []
    held = 0

    def flush() -> Iterator[tuple[int, list]]:
        found, at = values(keys), 0
        for i, end in ends:
            yield i, found[at:end]
            at = end

    for i, text in enumerate(texts):
        for k, part in enumerate(stretches(text)):
            keys += cut(part, not k)
            ends.append((i, len(keys)))
            held += len(part)
            if held > CALL_BYTES:
                yield from flush()
                keys, ends, held = [], [], 0
    yield from flush()


class PieceCounter:
    """Counts the tokens of a sentencepiece BPE model as its library gives them.

    Where no piece holds a space after another character, no merge crosses the place before a
    space that follows a character other than a space (or the mark that stands for spaces). The
    library puts a space before each text that it encodes; a segment therefore drops the one
    it begins with. Models of another kind have their texts counted whole.
    """

    MARK = "▁"
    AT_END = str(b" at end", "ascii")

    def __init__(self, path: str, memo: int = MEMO):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [self.model.encode(x, out_type=str) for x in ("a b", " a  b ")]
        self.safe = not any(self.MARK in x.lstrip(self.MARK) or " " in x for x in pieces) and [self.MARK + "a", self.MARK + "b"] == plain[0] and "".join(plain[1]) == self.MARK * 2 + "a" + self.MARK * 2 + "b" + self.MARK
        self.memo = Memo(self._count, memo)
        self.mark_alone = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def _count(self, segments: list[str]) -> list[int]:
        return [len(ids) for batch in balanced(segments) for ids in self.model.encode(batch, num_threads=1)]

    def _segments(self, part: str, first: bool) -> list[str]:
        if self.MARK in part or "  " in part:
            segments = re.split(f"(?<=[^ {self.MARK}]) ", part)
        else:
            segments = part.split(" ")
            if part[:1] == " ":
                segments[:2] = [" " + segments[1]]
        if not first:  # it begins with the space at which the text was cut
            segments[0] = segments[0][1:]
        if not segments[-1] and (len(segments) > 1 or not first):
            segments[-1] = self.AT_END
        return segments

    def _values(self, segments: list[str]) -> list[int]:
        """A space that ends a text is a mark alone, which no segment of letters stands for."""
        own = self.memo.values([s for s in segments if s is not self.AT_END])
        if len(own) == len(segments):
            return own
        rest = iter(own)
        return [self.mark_alone if s is self.AT_END else next(rest) for s in segments]

    def count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return self._count(texts)
        out = [0] * len(texts)
        for i, values in in_batches(texts, self._segments, self._values):
            out[i] += sum(values)
        return out


class WordEncoder:
    """Packs the ids of a tokenizer with word ends, white space dropped, as little-endian uint32.

    No token crosses white space, so segments end at spaces and line feeds. A segment of Latin
    letters with closing punctuation is two words of its own, in lower case; such letters are
    encoded many in a call and taken apart at the tokens that end a word.
    """

    PARTS = re.compile("([a-zà-öø-ÿ]*)([^\\n]*)\\n")

    def __init__(self, path: str, memo: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        names = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.words = Memo(self._words, memo)
        self.tails: dict[str, bytes | None] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for batch in balanced(texts) for e in self.model.encode_batch_fast(batch, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        out = []
        for batch in balanced(words, CALL_BYTES // 4):
            ids = np.array(self.model.encode_batch_fast([" ".join(batch)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(batch) and all(batch):
                packed, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
                out += [packed[a:b] for a, b in zip(at, at[1:], strict=False)]
            else:
                out += self._whole(batch)
        return out

    def _segments(self, segments: list[str]) -> list[bytes]:
        """One search splits all segments into the letters each begins with and the rest."""
        split = self.PARTS.findall("\n".join(segments).lower() + "\n")
        for tail in {t for _, t in split}.difference(self.tails):
            plain = not tail.strip(string.punctuation)
            self.tails[tail] = self._whole([tail])[0] if plain and tail else b"" if plain else None
        if len(self.tails) > self.words.size:
            self.tails = {t: self.tails[t] for _, t in split}
        ends = [self.tails[t] if stem else None for stem, t in split]
        latin = iter(self.words.values([stem for (stem, _), end in zip(split, ends, strict=True) if end is not None]))
        others = iter(self._whole([s for s, end in zip(segments, ends, strict=True) if end is None]))
        return [next(others) if end is None else next(latin) + end for end in ends]

    def packed(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """(text's number, ids), the ids of a long text in several parts."""
        owners, parts, held = [], [], 0
        for i, text in enumerate(texts):
            for part in stretches(text):
                owners.append(i)
                parts.append(part)
                held += len(part)
                if held > GROUP:
                    yield from zip(owners, self._packed(parts), strict=True)
                    owners, parts, held = [], [], 0
        if parts:
            yield from zip(owners, self._packed(parts), strict=True)

    def _packed(self, parts: list[str]) -> Iterator[bytes]:
        """Arrow splits the parts and numbers their different segments; only those come to Python, SEGMENTS at a time.

        What Arrow held for the group goes back to the system: its pool would keep it beside the memo.
        """
        split = pc.split_pattern(pc.replace_substring(pa.array(parts, pa.large_string()), "\n", " "), " ")
        segments = split.flatten().dictionary_encode()
        different = segments.dictionary
        own = [pa.array(self._segments(different.slice(a, SEGMENTS).to_pylist()), pa.large_binary()) for a in range(0, len(different), SEGMENTS)]
        ids = pa.concat_arrays(own).take(segments.indices)
        _, ends, data = ids.buffers()
        cuts = np.frombuffer(ends, dtype=np.int64)[split.offsets.to_numpy()].tolist()
        data = memoryview(data) if data else memoryview(b"")
        del split, segments, different, own
        pa.default_memory_pool().release_unused()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield bytes(data[a:b])


_ENCODERS: dict[tuple, object] = {}


def encoder(kind: type, path: str):
    """One encoder per worker process; it and its memo last as long as the worker."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens per row, by the sentencepiece model at ``path``.

    Null texts are empty and have 0 tokens. Very long texts are split where no token crosses.
    Ids may be null or repeat, other columns are ignored, an empty table gives none. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(PieceCounter, path)
        for b in batches:
            n = [x for texts in balanced(b.column(2).to_pylist(), 1 << 24) for x in counter.count(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("text"))
    return for_python(rows).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
