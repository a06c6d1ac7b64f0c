"""The pipeline's mixing and packing stages against brute force, each on its own input."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from arbora.llm.common import vocabulary
from conftest import DATA

P = 2147483647


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def trial(doc_id, seed):
    a = ((doc_id or 0) % P * 48271 + seed * 69621 + 12345) % P
    b = (a * a % P * 16807 + seed * 7919 + 1) % P
    return b * b % P / P


def mixed(rows):
    """How often each document is taken: targets by filling up, and the seed whose draw comes nearest."""
    by = defaultdict(list)
    for d, text, source in rows:
        by[source].append((d, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    names = sorted((s for s in by if s is not None)) + [s for s in by if s is None]
    size = {s: sum(n for _, n in by[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    out = Counter()
    for s in names:
        rate = target[s] / size[s] if size[s] else 0.0
        times = lambda d, seed: math.floor(rate) + (trial(d, seed) < rate - math.floor(rate))  # noqa: B023, E731
        seed = min(range(32), key=lambda x: (abs(sum(times(d, x) * n for d, n in by[s]) - target[s]), x))
        for d, _ in by[s]:
            out[d] += times(d, seed)
    return +out


def test_mixing_stage(spark, docs):
    import corpus_pipeline as p

    got = Counter(r["doc_id"] for r in p.mixing_stage(spark, docs, DATA).select("doc_id").collect())
    assert got == mixed([tuple(r) for r in docs.select("doc_id", "text", "source").collect()])


def test_packing_stage(spark, docs):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    twice = docs.unionByName(docs.where("doc_id % 3 = 0"))
    want, lengths = Counter(), []
    for d, text in twice.select("doc_id", "text").collect():
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[d, k // 4096, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
            lengths.append(len(part))
    got, places = Counter(), defaultdict(list)
    for r in p.packing_stage(spark, twice, DATA).collect():
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for x in places.values():
        ends = [0]
        for offset, length in sorted(x):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096
    rooms = []  # best fit, longest first
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(4096 - n)
    assert len(places) == len(rooms)


def test_copies_in_a_row_are_encoded_once():
    """copies that the mix gives follow each other; their ids are taken once, and every copy has its pieces."""
    from arbora.llm import packing

    class Letters:
        """A token for each letter, in parts of three."""

        seen = []

        def packed(self, texts):
            self.seen += texts
            for i, x in enumerate(texts):
                for a in range(0, max(len(x), 1), 3):
                    yield i, np.array([ord(c) for c in x[a : a + 3]], dtype="<u4").tobytes()

    texts = ["abcdefghij", "abcdefghij", "", "", "", "xyz", "abcdefghij", "abcd", "abcde"]
    keys = [4, 4, 5, 6, 6, None, 4, 7, 8]
    want = []
    for key, x in zip(keys, texts, strict=True):
        ids = [*map(ord, x), 1]
        want += [(key, k, 4 * k, len(own := ids[4 * k : 4 * k + 4]), zlib.crc32(np.array(own, dtype="<u4").tobytes())) for k in range(-(-len(ids) // 4))]
    assert packing._cut(Letters(), keys, texts, 4, 1) == want
    assert Letters.seen == ["abcdefghij", "", "xyz", "abcdefghij", "abcd", "abcde"]
    assert packing._cut(Letters(), [], [], 4, 1) == []
