"""SentencePiece ids and their decoded text, by a table of the distinct chunks of many texts.

Where no piece crosses the mark that stands for a space, a text's ids are those of its marked
words in order. A group of texts is cut to such chunks; each different one is segmented (and its
ids decoded) once, and what the table has for it is joined back to the places where it occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import for_python, text_of
from arbora.llm.tokens import Memo, PieceCounter, balanced, encoder, stretches

#: Characters of texts whose chunks share a table, and chunks in each half of a worker's memo.
GROUP, CHUNKS = 1 << 21, 50_000


class PieceTable(PieceCounter):
    """Encodes and decodes texts as the sentencepiece library does with the model at ``path``.

    A chunk is a text's first word, or one that follows a space: the library puts a space before each text
    that it encodes, and decoding takes the first one away, so the chunks of a decoded text are joined
    by the spaces that they were cut at. A model for which this doesn't hold has its texts encoded whole.
    """

    def __init__(self, path: str, memo: int = CHUNKS):
        super().__init__(path, 1)
        self.chunks = Memo(self._rows, memo)
        ids = lambda x: self.model.encode(x)
        self.end_ids = ids("a ")[len(ids("a")) :]
        texts = (" a  b\nc 字 ", "a b", "  a")
        self.safe = self.safe and all(list(self._by_chunks([x])) == list(self._whole([x])) for x in texts)

    def _rows(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids with commas, decoded text) of each chunk."""
        out = []
        for batch in balanced(chunks):
            ids = self.model.encode(batch, num_threads=1)
            out += [(len(x), ",".join(map(str, x)), y) for x, y in zip(ids, self.model.decode(ids, num_threads=1), strict=True)]
        return out

    def _whole(self, texts: Iterable[str]) -> Iterator[tuple[int, int, str, str]]:
        for i, text in enumerate(texts):
            yield i, *self._rows([text])[0]

    def _by_chunks(self, texts: Iterable[str]) -> Iterator[tuple[int, int, str, str]]:
        chunks: list[str] = []
        owners: list[int] = []
        ends, held = [0], 0

        def flush() -> Iterator[tuple[int, int, str, str]]:
            at_end = np.fromiter((c is self.AT_END for c in chunks), dtype=bool, count=len(chunks))
            coded = pa.array(chunks, pa.large_string()).dictionary_encode()
            different = coded.dictionary.to_pylist()
            rows = [*self.chunks.values(different), (len(self.end_ids), ",".join(map(str, self.end_ids)), "")]
            places = np.where(at_end, len(different), coded.indices.to_numpy())
            n, ids, decoded = (pa.array(c, t).take(pa.array(places)) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.large_string(), pa.large_string()), strict=True))
            total = np.concatenate([[0], np.cumsum(n.to_numpy())])[ends]
            together = lambda c, by: pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), c), pa.scalar(by, pa.large_string())).to_pylist()
            yield from zip(owners, np.diff(total).tolist(), together(ids, ","), together(decoded, " "), strict=True)

        for i, text in enumerate(texts):
            for k, part in enumerate(stretches(text)):
                chunks += self._segments(part, not k)
                owners.append(i)
                ends.append(len(chunks))
                held += len(part)
                if held > GROUP:
                    yield from flush()
                    chunks, owners, ends, held = [], [], [0], 0
        if owners:
            yield from flush()

    def encoded(self, texts: list[str]) -> Iterator[tuple[int, int, str, str]]:
        """(text's number, number of ids, ids with commas, decoded text); a long text comes in several parts, in order.

        Further parts of a text have a comma before their ids and a space before what is decoded.
        """
        return self._by_chunks(texts) if self.safe else self._whole(texts)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row, by the sentencepiece model at ``path``.

    Hashes are of the decimal ids joined by commas, and of what the library decodes from them. Null texts are
    empty, without ids. Very long texts go in parts that no piece crosses and are hashed part by part. Ids may
    be null or repeat, rows that repeat are all given, other columns are ignored, an empty table gives none.
    Nothing is shuffled: a table of chunks is that of a group of texts, and a worker's memo carries
    rows over to the next group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(PieceTable, path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n, ids, decoded = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            seen = [False] * len(texts)
            for i, count, numbers, text in table.encoded(texts):
                n[i] += count
                ids[i].update((("," if seen[i] else "") + numbers).encode())
                decoded[i].update(((" " if seen[i] else "") + text).encode())
                seen[i] = True
            hexed = [pa.array([x.hexdigest() for x in h], pa.string()) for h in (ids, decoded)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *hexed], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return for_python(rows).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
