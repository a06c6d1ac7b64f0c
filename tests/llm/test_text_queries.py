"""The registered queries on the smallest tables: SQL where it exists, brute force elsewhere."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from arbora.llm import queries
from arbora.llm.near_dedup import shingle_set
from conftest import DATA, rows_of

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, oracle, name):
    df = queries.queries()[name](spark, DATA)
    columns, want = oracle(SQL[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == want


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def test_suffix_dedup(spark, documents):
    data = [(d, (t or "").encode()) for d, t in documents]
    n = Counter(hash(b[i : i + 400]) for _, b in data for i in range(len(b) - 399))
    want = Counter()
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if n[hash(b[i : i + 400])] > 1:
                gone[i : i + 400] = b"\1" * 400
        want[d, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest(), len(b), sum(gone), len(re.findall(b"\1+", bytes(gone)))] += 1
    assert rows_of(queries.op7_suffix_dedup(spark, DATA)) == want


def test_pipeline(spark, documents):
    import corpus_pipeline as p

    frames, docs = [], spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in p.STAGES:
        docs = stage(spark, docs, DATA).cache()
        frames.append({"name": name, "rows": docs.collect(), "columns": docs.columns})
    good, exact, near, mixed, packed = frames
    assert [f["columns"] for f in frames[:-1]] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4
    keys = {re.sub(r"[\x20\x09-\x0D]+", "", r["text"]) for r in good["rows"]}
    assert len(exact["rows"]) == len(keys)
    sets = [shingle_set(r["text"], 5) for r in exact["rows"]]
    by = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            by[g].append(k)
    pairs = {(a, b) for members in by.values() for a in members for b in members if a < b}
    pairs = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = {r["doc_id"] for r in near["rows"]}
    ids = [r["doc_id"] for r in exact["rows"]]
    assert all(not (ids[a] in kept and ids[b] in kept) for a, b in pairs)
    assert len(ids) - len(kept) <= len(pairs)
    assert {r["doc_id"] for r in mixed["rows"]} <= kept
    assert sum(r["length"] for r in packed["rows"]) > 0
    assert {r["doc_id"] for r in packed["rows"]} == {r["doc_id"] for r in mixed["rows"]}
    assert p.run(spark, DATA).count() == len(packed["rows"])
