"""Hard negatives, pieces and the filter audit: brute force, the library, and odd rows."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from arbora.llm import filter_audit, hard_negatives, pieces, queries, tokens
from arbora.llm.common import vocabulary
from conftest import DATA, rows_of

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(MODEL))


def of_library(model, text):
    ids = model.encode(text or "")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))


def test_pieces_of_all_documents(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_piece_round_trip(spark, DATA).collect()}
    assert got == {d: of_library(library, t) for d, t in texts.items()}


def test_pieces_of_odd_rows(spark, library):
    texts = [None, "", " ", "  ", "a ", "a  ", " a", "▁", "a▁b", "\x00 x", "é 字 😀 ́", "<s> </s>", "x" * 3000, "\n\n", " at end", "same", "same"]
    df = spark.createDataFrame([(None if k == 3 else k // 2, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    want = defaultdict(int)
    for k, t in enumerate(texts):
        want[(None if k == 3 else k // 2, *of_library(library, t))] += 1
    got = defaultdict(int)
    for r in pieces.encode_decode(df, vocabulary(MODEL)).collect():
        got[r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]] += 1
    assert got == want
    assert pieces.encode_decode(df.where("doc_id < 0"), vocabulary(MODEL)).count() == 0


def test_pieces_at_every_cut(library, monkeypatch):
    """Texts in parts of a few characters and tables of a few chunks; a memo that is always too small."""
    table, draw = pieces.PieceTable(vocabulary(MODEL), 3), random.Random(5)
    assert table.safe
    monkeypatch.setattr(pieces, "stretches", lambda t: tokens.stretches(t, 7))
    monkeypatch.setattr(pieces, "GROUP", 30)
    parts = [" ", "  ", "▁", "a", "b", "the", "\n", "\t", "é", "字", "<s>", "\x00", " at end", "at"]
    for _ in range(100):
        texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(10)]
        got = {}
        for i, n, ids, text in table.encoded(texts):
            old = got.get(i)
            got[i] = (old[0] + n, old[1] + "," + ids, old[2] + " " + text) if old else (n, ids, text)
        for i, t in enumerate(texts):
            ids = library.encode(t)
            assert got[i] == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_pieces_of_a_model_that_crosses_spaces(library):
    """Where chunks aren't safe, each text is encoded whole, with the same result."""
    table = pieces.PieceTable(vocabulary(MODEL))
    texts = ["a b  c", "", " x "]
    by_chunks = list(table.encoded(texts))
    table.safe = False
    assert list(table.encoded(texts)) == by_chunks


def mined(rows, anchor=50, positives=5, negatives=3, scale=256):
    import math

    whole = [(i, y, [math.floor(scale * float(v)) for v in x]) for i, y, x in rows]
    out = set()
    for a, label, x in whole:
        if a % anchor:
            continue
        order = sorted((-sum(p * q for p, q in zip(x, z, strict=False)), b, y) for b, y, z in whole)
        for p, pid, _ in [s for s in order if s[2] == label and s[1] != a][:positives]:
            found = [(s, b) for s, b, y in order if y != label and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out |= {(a, pid, k + 1, b, -p, -s) for k, (s, b) in enumerate(found)}
    return out


def test_hard_negatives_over_many_cells(spark, monkeypatch):
    """Cells of a few rows give what one sort of all rows gives; ties, odd lengths and large numbers included."""
    monkeypatch.setattr(hard_negatives, "ROWS", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "TOGETHER", 2)
    draw = random.Random(2)
    near = [[draw.choice((-0.5, 0.25, 0.75, 1.0)) for _ in range(6)] for _ in range(12)]
    rows = [(i, draw.choice((0, 0, 1, 2)), near[draw.randrange(12)][: draw.choice((6, 6, 4, 0))]) for i in range(-100, 300)]
    rows += [(1000 + i, i % 2, [1e5 * (i + 1), 3.0]) for i in range(6)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 50 == 0)
    want = mined(rows)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 20


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 0.0], "x"), (1, 1, [1.0, 0.1], "x"), (2, 2, [0.8, 0.0], "x"), (3, 2, [0.8, 0.0], "x")]
    odd = [(4, None, [1.0, 0.0], "x"), (5, 1, None, "x"), (6, 1, [nan, 0.0], "x"), (7, 2, [0.8, inf], "x"), (8, 1, [None, 1.0], "x"), (None, 2, [0.8, 0.0], "x"), (3, 2, [0.8, 0.0], "y"), (3, 7, [0.9, 0.0], "y")]
    schema = "vec_id long, label int, embedding array<float>, score string"
    want = {(0, 1, 1, 2, 65536, 52224), (0, 1, 2, 3, 65536, 52224)}
    for rows in (good, good + odd):
        got = [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") == 0).collect()]
        assert len(got) == 2 and set(got) == want
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    alone = hard_negatives.mine(spark.createDataFrame(good[:1], schema), F.col("vec_id") == 0)
    assert alone.count() == 0


def audited(docs, labels):
    marks, low = defaultdict(lambda: [False, False]), {}
    for d, quality, toxic in labels:
        if d is not None:
            marks[d] = [marks[d][0] or quality == 1, marks[d][1] or toxic == 1]
    for d, t, _ in docs:
        if d is not None:
            low[t or ""] = min(low.get(t or "", d), d)
    parts = defaultdict(list)
    for d, t, part in docs:
        x = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", x)) > 5 * len(x), bool(re.search(r"[#$%&*|]", x)), d is not None and d > low[x])
        parts[part or ""].append(({f for f, fails in zip("ABCDE", tests, strict=True) if fails}, *(marks[d] if d is not None else (False, False))))
    out = {}
    for part, rows in parts.items():
        total = defaultdict(int)
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                total[f] += len(gone)
                fails = sum(f in r[0] for r in rows)
                out[part, "".join(order), k + 1] = [len(left), len(gone), fails - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]]
    return {(*k, *v) for k, v in out.items()}


def test_filter_audit_by_taking_every_order(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(i, t, s) for i, (t, s) in enumerate([(long, "a"), (long, "b"), (long, "a"), (long + " #", "a"), (long.upper(), "a"), ("x " * 80, "b"), ("", None), (None, ""), ("\t\n", "b"), ("A#", "a"), ("A#", "b")])]
    docs += [(5, long, "a"), (5, long, "a"), (None, long, "a"), (None, "A#", None), (-3, "x " * 80, "b"), (20, "x" * 300_000, "c"), (21, "é é " * 40, "c")]
    labels = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (5, None, 1), (5, 1, None), (None, 1, 1), (99, 1, 1), (3, 1, 0), (3, 0, 0), (7, None, None)]
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, mask int")
    right = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, source string")
    got = [tuple(r) for r in filter_audit.audit(left, right).collect()]
    want = audited(docs, labels)
    assert len(got) == len(want) == 4 * 600 and set(got) == want
    assert filter_audit.audit(left.where("doc_id < -9"), right).count() == 0
    assert {r["good_lost"] + r["toxic_lost"] for r in filter_audit.audit(left, right.where("doc_id > 999")).collect()} == {0}


def test_join_spread(spark):
    """A group with most of the rows is dealt to many tasks; the result is that of a plain join."""
    from arbora.llm.common import PARTS, join_spread

    rows = spark.createDataFrame([(7 if k % 3 else k, k) for k in range(6000)] + [(None, 1)], "g long, x long")
    groups = rows.where("g % 2 = 1").groupBy("g").agg(F.count("*").alias("n"))
    out = join_spread(rows, groups, ["g"], "n", ["x"])
    assert rows_of(out) == rows_of(rows.join(groups, "g"))
    dealt = rows.where("g = 7").select(F.pmod(F.xxhash64("x"), F.lit(PARTS)).alias("p")).groupBy("p").count()
    assert dealt.count() == PARTS and dealt.agg(F.max("count")).first()[0] < 4 * 4000 / PARTS
