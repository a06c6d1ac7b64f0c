"""Operators against plain brute force on small fixtures: nulls, empties, ties, repeats, clashes."""

import hashlib
import math
import random
import re
import struct
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from arbora.llm import components, exact_dedup, licenses, mixing, near_dedup, packing, quality, repeats, rlz_dedup, simhash, suffix_dedup, tokens, urls
from arbora.llm.common import vocabulary
from conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"
ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \t\r\n\x0b\x0c", None),
    (4, "one", "b"),
    (5, "one two", "b"),
    (6, "\u00a0x\u2003y z", "b"),
    (7, "One, TWO; three!! four ... five", "\U0001f600"),
    (7, "One, TWO; three!! four ... five", "\U0001f600"),
    (None, "a b c d e f g h i j k l", None),
    (None, None, None),
    (9, "again " * 60, "a"),
    (10, "again " * 59 + "again", "b"),
    (11, "é中😀 " * 30 + "\n" + "é中😀 " * 30, "c"),
    (-5, "x" * 700, "c"),
    (12, "line one is here\nline one is here\n\nline one is here", "b"),
]


def ascii_lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(odd):
    """Columns that operators use as names of their own."""
    from pyspark.sql import functions as F

    names = "n_words size digest check node row k1 k2 fp gram place length piece slot target rate seed host kept copies label a b key".split()
    return odd.select("*", *(F.lit("x").alias(n) for n in names))


# 9: exact copies


def exact(rows):
    groups = defaultdict(list)
    for k, (d, t, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), d is None, d or 0, k))
    out = []
    for text, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), m[3] == best[3], sha))
    return out


def test_exact_copies(odd, clashing, empty):
    from pyspark.sql import functions as F

    want = Counter((g, keep, kept, sha, d) for d, keep, g, kept, sha in exact(ODD))
    for df in (odd, clashing, odd.repartition(7)):
        got = exact_dedup.mark_copies(df).drop("n_points")
        if df is odd:
            assert rows_of(got.select(F.col("group_size").alias("a"), F.col("keep_id").alias("b"), F.col("kept").alias("c"), F.col("text_sha256").alias("d"), F.col("doc_id").alias("e"))) == want
        assert got.where("kept").count() == got.select("text_sha256").distinct().count()
    assert exact_dedup.mark_copies(empty).count() == 0 == exact_dedup.drop_copies(empty).count()


def test_exact_stage_keeps_one(odd, clashing):
    left = exact_dedup.drop_copies(clashing)
    assert left.columns == clashing.columns
    assert left.count() == len({re.sub(r"[\x20\x09-\x0D]+", "", t or "") for _, t, _ in ODD})
    assert rows_of(exact_dedup.drop_copies(left)) == rows_of(left)


def test_tree_merge_has_any_number_of_rounds(spark):
    rows = [(i, f"t{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    assert rows_of(exact_dedup.mark_copies(df).select("doc_id", "keep_id")) == Counter((i, i % 7) for i, _ in rows)
    from pyspark.sql import functions as F

    for partitions in (1, 3, 40, 5000):
        base = df.select(F.col("text").alias("digest"), F.lit(1).alias("check"), F.lit(1).alias("points"), F.pmod("doc_id", F.lit(partitions)).alias("node"), F.col("doc_id").alias("best"))
        assert rows_of(exact_dedup.tree_merge(base, partitions, 2).select("digest", "best", "size")) == Counter((i, f"t{i}", sum(j % 7 == i for j in range(200))) for i in range(7))


# 2: mixing


def water(sizes):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        left, w = total - sum(full.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 2 * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / w for s in open_}
        full |= {s: 2 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "Z", "é", "\uffee", "\U0001f600", None][: 2 + seed * 2])) for i in range(150)]
    got = {r["doc_id"]: r for r in mixing.mix_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = water(dict(sizes)), Counter()
    for d, t, s in rows:
        r, n = got[d], len(t.split())
        assert (r["size"], r["source_size"], r["target"]) == (n, sizes[s], pytest.approx(want[s]))
        assert n == 0 or r["taken"] / n in (math.floor(want[s] / sizes[s]), math.floor(want[s] / sizes[s]) + 1)
        assert r["taken"] <= 2 * n
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 45 for s in sizes)


def test_mix_repeats_rows(odd, clashing, empty):
    per = Counter()
    for r in mixing.mix_counts(clashing).collect():
        per[r["doc_id"]] += r["copies"]
    out = mixing.mix(clashing)
    assert out.columns == clashing.columns
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == Counter({k: v for k, v in per.items() if v})
    assert rows_of(mixing.mix_counts(odd)) == rows_of(mixing.mix_counts(odd.repartition(5)))
    assert mixing.mix(empty).count() == 0 == mixing.mix_counts(empty).count()


# 5: quality


def measures(t):
    t = t or ""
    words = WORD.findall(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def test_quality_measures(spark, odd, clashing, empty):
    rng = random.Random(1)
    rows = ODD + [(100 + i, "".join(rng.choice(["a ", "b ", "c\n", "#$ ", "the ", "é "]) for _ in range(rng.randint(0, 60))), "s") for i in range(80)]
    got = Counter()
    for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]] += 1
        assert not (r["base_failed"] and r["kept"])
    assert got == Counter((d, *measures(t)) for d, t, _ in rows)
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns
    want = quality.judge(odd).where("kept")
    assert kept.count() == want.count() and quality.keep_good(empty).count() == 0


def test_rules_are_a_table(odd):
    strict = (quality.Rule("long", "n_words", "one", 1000, None),)
    assert quality.keep_good(odd, strict).count() == 0
    assert quality.keep_good(odd, (), ()).count() == len(ODD)


# 1: urls


def page(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return ascii_lower(host), re.match(r"[^?#]*", rest[len(host) :]).group()


def test_urls(spark):
    pages = [None, "", "no scheme", "http://", "http://COM/en/", "https://A.Example.com/en/7x?y", "http://example.com/en/8", "http://notexample.com/en/7", "x://example.net/de/81#a", "http://b.net/de/", "http://example.org/es/a://b", "http://www.x.co.uk/p", "http://É.com/fr?://z/", "http://h.com\n/en/a", "http://xcom/en/1"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(pages)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (7, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in urls.judge(df, urls.page_outcomes(df, labels)).collect()}
    for i, u in enumerate(pages):
        host, path = page(u)
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best.text)
        assert got[i]["verdict"] == best.action if best else got[i]["verdict"] in ("allow", "block")
    assert urls.judge(df.limit(0), urls.page_outcomes(df.limit(0), labels)).count() == 0


def test_reputation_shrinks(spark):
    rows = [("good.a.com", 1, 0)] * 200 + [("bad.b.com", 1, 1)] * 200 + [("new.b.com", 1, 1)] * 2 + [("new.a.com", 1, 1)] * 2 + [("none.a.com", 0, 0)] * 3 + [("x.co.uk", 1, 0)]
    rows += [("a.b.com:8080", 1, 1), ("u@a.b.com", 1, 1), ("10.0.0.1", 1, 0), ("10.2.0.1:80", 1, 0)]
    outcomes = spark.createDataFrame([(h, 1, n, b) for h, n, b in rows], "host string, pages long, labelled long, bad long")
    got = {r["host"]: r for r in urls.reputations(outcomes).collect()}
    assert got["bad.b.com"]["bound"] > urls.THRESHOLD > got["good.a.com"]["mean"]
    assert got["new.b.com"]["mean"] > got["new.a.com"]["mean"]
    assert 0 < got["none.a.com"]["mean"] < got["new.a.com"]["mean"]
    assert got["none.a.com"]["pages"] == 3
    from pyspark.sql import functions as F

    hosts = spark.createDataFrame([("a.b.co.uk",), ("A:x@www.b.com:8080",), ("10.0.0.1:80",), ("[::1]:8080",), ("com",), ("",)], "h string")
    parts = {r[0]: (r[1], r[2]) for r in hosts.select("h", *urls.domain_and_suffix(F.col("h"))).collect()}
    assert parts == {"a.b.co.uk": ("b.co.uk", "co.uk"), "A:x@www.b.com:8080": ("b.com", "com"), "10.0.0.1:80": ("10.0.0.1", "[]"), "[::1]:8080": ("[::1]", "[]"), "com": ("com", "com"), "": ("", "")}


def test_join_by_size(spark):
    """Large groups are joined apart; null keys are keys; no row is lost or repeated."""
    from pyspark.sql import functions as F

    from arbora.llm import common

    rows = [("hot", k) for k in range(3000)] + [(None, k) for k in range(500)] + [(f"k{k}", k) for k in range(1500)] + [("alone", 1)]
    df = spark.createDataFrame(rows, "key string, n int")
    groups = df.where("key <> 'alone' or key is null").groupBy("key").agg(F.count("*").alias("size")).withColumn("extra", F.concat(F.lit("of "), F.col("key")))
    want = Counter((f"of {k}" if k and k != "alone" else None, k, n, {"hot": 3000, None: 500, "alone": None}.get(k, 1)) for k, n in rows)
    assert rows_of(common.join_by_size(df, groups, ["key"], "size").select("key", "n", "size", "extra")) == want
    assert common.join_by_size(df.limit(0), groups.limit(0), ["key"], "size").count() == 0


# 6 and 3: tokens and packing

PIECES = [" ", "  ", "a", "B", "é", "é", "\n", "\t", ".", ",", "'s", "'", "▁", "<|endoftext|>", "<s>", "中文", "😀", "\x1c", "\x00", "\r", "ß", "İ", "K", "23", "...", "ΑΣ", "ς", "\u200b", "_", "µ", "word", "the "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=16).map("".join), st.sampled_from([3, 1 << 20]))
def test_segments_have_the_texts_tokens(text, stretch):
    counter, encoder = (tokens.encoder(kind, vocabulary(name)) for kind, name in ((tokens.PieceCounter, "piece_bpe_32k.model"), (tokens.WordEncoder, "word_bpe_49k.json")))
    old = tokens.stretches.__defaults__
    tokens.stretches.__defaults__ = (stretch,)
    try:
        assert counter.count([text, "", text]) == [len(counter.model.encode(text)), 0, len(counter.model.encode(text))]
        ids = b"".join(x for i, x in encoder.packed(["b", text]) if i == 1)
    finally:
        tokens.stretches.__defaults__ = old
    assert np.frombuffer(ids, "<u4").tolist() == encoder.model.encode(text, add_special_tokens=False).ids


def test_word_encoder_holds_few_segments_at_once(monkeypatch):
    encoder, seen = tokens.WordEncoder(vocabulary("word_bpe_49k.json"), 5000), []
    plain = encoder._segments
    monkeypatch.setattr(encoder, "_segments", lambda x: (seen.append(len(x)), plain(x))[1])
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{k}," for i in range(9000)) for k in ("", "x", "")] + ["", "last  one\n"]
    got = [b""] * len(texts)
    for i, ids in encoder.packed(texts):
        got[i] += ids
    assert max(seen) <= 4096 and sum(seen) >= 18000
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [encoder.model.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encoder.words.young) <= 5000 and len(encoder.words.old) <= 5000


def test_memo_stays_small():
    memo = tokens.Memo(lambda keys: [k * 2 for k in keys], 10)
    for i in range(100):
        assert memo.values([str(i), str(i // 2), str(i)]) == [str(i) * 2, str(i // 2) * 2, str(i) * 2]
        assert len(memo.young) <= 10 and len(memo.old) <= 10


def test_token_counts(spark, odd, empty):
    model = tokens.encoder(tokens.PieceCounter, vocabulary("piece_bpe_32k.model")).model
    got = tokens.count_tokens(odd, vocabulary("piece_bpe_32k.model"))
    assert rows_of(got) == Counter((d, len((t or "").encode()), len(model.encode(t or ""))) for d, t, _ in ODD)
    assert tokens.count_tokens(empty, vocabulary("piece_bpe_32k.model")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=150))))
def test_plan_is_best_fit(case):
    capacity, lengths = case
    counts = Counter(lengths)
    slots, first, n = packing.plan(counts, capacity)
    room = []
    for x in sorted(lengths, reverse=True):
        k = min((k for k, r in enumerate(room) if r >= x), key=lambda k: room[k], default=None)
        if k is None:
            room.append(capacity - x)
        else:
            room[k] -= x
    assert n == len(room)
    use = defaultdict(list)
    for length, number in counts.items():
        for rank in range(number):
            s = next(s for s in slots if s.start <= first[length] + rank < s.start + s.count)
            k = first[length] + rank - s.start
            use[s.sequence + k // s.each].append((s.offset + k % s.each * length, length))
    for places in use.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing(spark, odd, empty):
    model = tokens.encoder(tokens.WordEncoder, vocabulary("word_bpe_49k.json")).model
    long = spark.createDataFrame([(50, "some words, " * 3000, "a"), (51, "xyzzy" * 2000, "a"), (52, "a b " * 4, "a")], SCHEMA)
    df = odd.unionByName(long)
    got = packing.pack(packing.pieces(df, vocabulary("word_bpe_49k.json"), 64), 64, ranked=2).collect()
    want = Counter()
    for d, t, *_ in df.collect():
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 64)):
            own = ids[a : a + 64]
            want[d, k, a, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    use = defaultdict(list)
    for r in got:
        use[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in use.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty, vocabulary("word_bpe_49k.json")).count() == 0


# 4: simhash


def plain_fingerprint(t, n=3):
    words = WORD.findall(ascii_lower(t or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, radius):
    up = list(range(len(values)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return [top(k) for k in range(len(values))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=40, unique=True), st.integers(0, 255), st.integers(0, 4))
def test_bk_tree(values, x, radius):
    tree = simhash.BKTree(values)
    assert sorted(tree.within(x, radius)) == [k for k, v in enumerate(values) if (v ^ x).bit_count() <= radius]
    links = simhash.spanning(values, radius)
    groups = linked(values, radius)
    assert len(links) == len(values) - len(set(groups))
    assert all((values[a] ^ values[b]).bit_count() <= radius and groups[a] == groups[b] for a, b in links)


@pytest.mark.parametrize("shard", [2, 512])
def test_links_miss_none(spark, shard):
    rng = random.Random(shard)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = sorted({v ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for v in base for _ in range(12)})
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    got = {r["node"]: r["label"] for r in simhash.classes(df, shard=shard).collect()}
    groups = linked(values, 2)
    sets = defaultdict(set)
    for v, g in zip(values, groups, strict=True):
        sets[g].add(simhash.signed(v))
    want = {v: min(s) for s in sets.values() if len(s) > 1 for v in s}
    assert got == want


def test_near_copies(spark, odd, clashing, empty):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = ODD + [(1000 + i, " ".join(words[: 250 + rng.randint(0, 3)]), "a") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    values = [plain_fingerprint(t) for _, t, _ in rows]
    groups, least = linked(values, 2), {}
    for (d, *_), g in zip(rows, groups, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    want = Counter((least.get(g), d, f"{v:016x}") for (d, *_), v, g in zip(rows, values, groups, strict=True))
    assert rows_of(simhash.near_copies(df)) == want
    assert simhash.near_copies(empty).count() == 0
    assert simhash.near_copies(clashing).count() == len(ODD)


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(str(k % 50) for k in range(500)).encode()
    whole = [simhash.fingerprint(text, 3, n, r) for n in (1, 4) for r in (True, False)]
    assert int.from_bytes(whole[0]) == plain_fingerprint(text.decode()) and whole[2][:8] == whole[0]
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert [simhash.fingerprint(text, 3, n, r) for n in (1, 4) for r in (True, False)] == whole


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    want = Counter((top(x), x) for e in edges if e[0] != e[1] for x in e)
    got = rows_of(components.components(spark.createDataFrame(edges, "a long, b long")))
    assert got == Counter(set(want))
    assert rows_of(components.components(spark.createDataFrame(edges, "a long, b long"), local=0)) == Counter(set(want))
    for local in (0, 100):
        assert components.components(spark.createDataFrame([], "a long, b long"), local).count() == 0


def test_near_stage(spark, odd, clashing, empty):
    rng = random.Random(9)
    base = [[f"v{rng.randint(0, 5000)}" for _ in range(300)] for _ in range(30)]
    rows = []
    for k, words in enumerate(base):
        rows.append((k, " ".join(words), "a"))
        for c in range(k % 3):
            own = list(words)
            own[rng.randrange(300)] = "changed"
            own[rng.randrange(300)] = "too"
            rows.append((1000 + 10 * k + c, " ".join(own), "a"))
    got = {r["doc_id"] for r in near_dedup.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == set(range(30))
    many = [(k, " ".join([*base[0][:280], f"own{k}"]), "a") for k in range(60)]
    assert [r["doc_id"] for r in near_dedup.drop_near_copies(spark.createDataFrame(many, SCHEMA), shard=8).collect()] == [0]
    left = near_dedup.drop_near_copies(clashing)
    assert left.columns == clashing.columns and near_dedup.drop_near_copies(empty).count() == 0
    assert {t for _, t, _ in ODD if not WORD.search(t or "")} <= {r["text"] for r in left.collect()}


def crowd(seed, n, twins, shared=1000, own=150, both=45):
    """Texts of one template, near 0.8 in similarity but below, and the ids of ``twins`` pairs that are above it."""
    rng = random.Random(seed)
    fresh = lambda k: [f"w{rng.getrandbits(40)}" for _ in range(k)]
    body = fresh(shared)
    texts = {k: body + fresh(own) for k in range(n)}
    for k in range(twins):
        texts[n + k] = texts[k][: shared + both] + fresh(own - both)
    return [(k, " ".join(v), "a") for k, v in texts.items()]


def brute_kept(rows, shingle=5, similarity=0.8):
    """Ids that stay, and the number of pairs at the similarity."""
    sets = {d: near_dedup.shingle_set(t, shingle) for d, t, _ in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {d for d in sets if up[d] == d}, len(pairs)


def test_near_stage_confirms_pairs_that_close_cycles(spark):
    rows = crowd(1, 120, 60)
    want, pairs = brute_kept(rows)
    assert pairs == 60 and len(want) == 120
    got = {r["doc_id"] for r in near_dedup.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert want <= got and len(got - want) <= 1


def test_near_stage_compares_all_of_an_overfull_key(spark):
    rows = crowd(2, 160, 80)
    copies = [(1000 + k, rows[0][1] + f" end{k}", "a") for k in range(60)]
    want, pairs = brute_kept(rows)
    assert pairs == 80 and len(want) == 160
    left = near_dedup.drop_near_copies(spark.createDataFrame(rows + copies, SCHEMA), shard=8, block=16, text_block=1 << 18)
    got = {r["doc_id"] for r in left.collect()}
    assert want <= got and len(got - want) <= 2


def test_near_stage_finds_pairs_just_over_the_threshold(spark):
    rng = random.Random(5)
    fresh = lambda k: [f"w{rng.getrandbits(40)}" for _ in range(k)]
    rows = []
    for k in range(500):
        words, changed = fresh(600), rng.randint(58, 66)  # similarities of 0.80 to 0.83
        rows += [(k, " ".join(words), "a"), (1000 + k, " ".join(words[:-changed] + fresh(changed)), "a")]
    want, pairs = brute_kept(rows)
    assert pairs == 500 == len(want)
    got = {r["doc_id"] for r in near_dedup.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert want <= got and len(got - want) <= 0.05 * 500


def members_of(spark, texts):
    """The members of one crowd, key 0."""
    rows = [(0, k, simhash.fingerprint(t.encode(), 5, 8, repeats=False), t.encode(), len(t)) for k, t in texts.items()]
    return spark.createDataFrame(rows, "key long, node long, fp binary, text binary, weight long")


def test_a_crowd_around_a_template_is_cut_to_its_similar_pairs(spark):
    """Ten times the texts leave as many to be compared as there are pairs, not a hundred times the work."""
    left, lists = [], []
    for n in (30, 300):
        texts = {d: t for d, t, _ in crowd(3, n, 5)}
        members, none = members_of(spark, texts), spark.createDataFrame([], "node long, label long")
        parts = near_dedup.finer(members, spark.createDataFrame([(0,)], "key long"), none)
        left.append({r["node"] for r in parts.select("node").collect()})
        lists.append(near_dedup.meeting_lists(members.withColumn("label", members["node"]), 5, 0.8).count())
    assert left == [{*range(5), *range(n, n + 5)} for n in (30, 300)]
    assert lists[1] <= 12 * lists[0]


@pytest.mark.parametrize("seed", range(2))
def test_parts_of_a_crowd_hold_all_its_similar_pairs(spark, seed):
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(160)]
    texts = {k: " ".join([*base[rng.randint(0, 12) : rng.randint(60, 160)], *(f"x{rng.randint(0, 40)}" for _ in range(rng.randint(0, 25)))]) for k in range(150)}
    texts |= {200: "", 201: "one two", 202: "One  two", 203: base[0]}
    given = {k: min(k, k ^ 1) for k in range(0, 20)}
    members, most = members_of(spark, texts), near_dedup.radius()
    groups = spark.createDataFrame(list(given.items()), "node long, label long")
    sets = {k: near_dedup.shingle_set(t, 5) for k, t in texts.items() if t}
    fps = {r["node"]: int.from_bytes(r["fp"]) for r in members.collect()}

    def parts(pairs):
        up = {k: k for k in texts}
        for a, c in pairs:
            up = {k: up[a] if x == up[c] else x for k, x in up.items()}
        return {tuple(k for k in up if up[k] == x) for x in set(up.values())}

    near = [(a, c) for a in sets for c in sets if a < c and (fps[a] ^ fps[c]).bit_count() <= most and len(sets[a] & sets[c]) >= 0.8 * len(sets[a] | sets[c])]
    cut_up = near_dedup.finer(members, spark.createDataFrame([(0,)], "key long"), groups, block=16)
    found = [tuple(r) for r in near_dedup.joined(cut_up, groups, block=1 << 12).collect()]
    assert len(near) > 20 and parts([*found, *given.items()]) == parts([*near, *given.items()])


@pytest.mark.parametrize("seed", range(4))
def test_joining_gives_the_components_of_similar_pairs(seed):
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base[: (a := rng.randint(60, 120))] + [f"x{rng.randint(0, 9)}" for _ in range(rng.randint(0, 30))]).encode() for _ in range(60)]
    fps = [simhash.fingerprint(t, 5, 8, repeats=False) for t in texts]
    labels = [rng.choice([k, 0, 7]) for k in range(60)]
    import pyarrow as pa

    b = pa.RecordBatch.from_pylist([{"key": 1, "part": 0, "node": k, "label": labels[k], "fp": f, "text": t} for k, (f, t) in enumerate(zip(fps, texts, strict=True))])
    out = [x for r in near_dedup.joining(512, 5, 0.8)([b]) for x in r.to_pylist()]
    sets = [near_dedup.shingle_set(t.decode(), 5) for t in texts]

    def parts(pairs):
        up = list(range(60))
        for a, c in pairs:
            up = [up[a] if x == up[c] else x for x in up]
        return {frozenset(k for k in range(60) if up[k] == x) for x in set(up)}

    same = [(a, c) for a in range(60) for c in range(a) if labels[a] == labels[c]]
    close = [(a, c) for a in range(60) for c in range(a) if len(sets[a] & sets[c]) >= 0.8 * len(sets[a] | sets[c])]
    assert parts([*same, *((x["a"], x["b"]) for x in out)]) == parts([*same, *close])
    assert len(out) < 60


# 7 and 8: substrings


def covered(seqs, width):
    n = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            if n[tuple(s[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 60))) for _ in range(10)]
    rows = []
    for i in range(40):
        text = "".join(rng.choice(base)[rng.randint(0, 10) : rng.randint(10, 60)] for _ in range(rng.randint(0, 4)))
        rows.append((i if rng.random() < 0.9 else None, text if rng.random() < 0.9 else None))
    return rows + [(90, "a " * 200), (91, "a " * 150), (92, "ab" * 100), (92, "ab" * 100), (93, "x" * 50), (94, ""), (95, " ")]


@pytest.mark.parametrize("shard", [2, 4096])
def test_substring_dedup(spark, shard, empty):
    rows = texts(shard)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    data = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (d, _), b, gone in zip(rows, data, covered(data, 20), strict=True):
        runs = len(re.findall("1+", "".join("01"[g] for g in gone)))
        want[d, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest(), len(b), sum(gone), runs] += 1
    assert rows_of(suffix_dedup.strip_substrings(df, 20, 5, shard=shard)) == want
    words = [re.findall(rb"[^\x20\x09-\x0D]+", b) for b in data]
    want = Counter()
    for (d, _), w, gone in zip(rows, words, covered(words, 6), strict=True):
        want[d, hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest(), sum(gone), len(w)] += 1
    assert rows_of(rlz_dedup.strip_word_windows(df, 6, 2, shard=shard).select("doc_id", "kept_sha256", "n_removed", "n_words")) == Counter({(d, s, r, n): c for (d, s, r, n), c in want.items()})
    assert suffix_dedup.strip_substrings(empty).count() == 0 == rlz_dedup.strip_word_windows(empty).count()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=30), st.integers(1, 3))
def test_deep_shallow_sorting(strings, shallow):
    group = np.array([k % 3 for k in range(len(strings))])
    order, prefix = suffix_dedup.deep_shallow(strings, group, shallow)
    keys = [(int(group[k]), strings[k]) for k in order]
    assert keys == sorted(keys)
    for a, b, p in zip(keys, keys[1:], prefix[1:], strict=False):
        assert p == (suffix_dedup.common(a[1], b[1]) if a[0] == b[0] else -1)
    own, shared = suffix_dedup.blind_trie(strings, list(range(len(strings))))
    assert [strings[k] for k in own] == sorted(strings)
    assert shared[1:] == [suffix_dedup.common(strings[a], strings[b]) for a, b in zip(own, own[1:], strict=False)]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    units = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    units[200:260] = units[20:80]
    text, place, gram = repeats.anchors(units, np.array([200, 200]), 5, 20)
    at = defaultdict(set)
    for t, p, g in zip(text.tolist(), place.tolist(), gram.tolist(), strict=True):
        at[t].add((p, g))
    for start in range(0, 41):  # windows of the copied stretch
        own = {(p - 20 - start, g) for p, g in at[0] if start <= p - 20 <= start + 15}
        other = {(p - start, g) for p, g in at[1] if start <= p <= start + 15}
        assert own & other


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([(6, 2), (8, 3), (12, 4), (20, 5)]), st.lists(st.lists(st.tuples(st.sampled_from([b"a", b"ab", b"aab", b"abcab", b"bacbbca"]), st.integers(0, 14), st.binary(max_size=5).map(lambda b: bytes(97 + x % 3 for x in b))), max_size=4), min_size=1, max_size=5))
def test_periodic_texts_keep_every_repeat(shape, parts):
    """The windows that anchors bring together, and the periodic stretches, cover what brute force does."""
    width, gram = shape
    data = [b"".join(unit * n + tail for unit, n, tail in text) for text in parts]
    met = defaultdict(set)
    for i, t in enumerate(data):
        _, place, grams = repeats.anchors(suffix_dedup.BYTES[np.frombuffer(t, dtype=np.uint8)], np.array([len(t)]), gram, width)
        for p, g in zip(place.tolist(), grams.tolist(), strict=True):
            for a in range(max(0, p - width + gram), min(p, len(t) - width) + 1):
                met[g, p - a, t[a : a + width]].add((i, a))
    for i, (t, gone) in enumerate(zip(data, covered(data, width), strict=True)):
        spans = [a << 31 | a + width for found in met.values() if len(found) > 1 for k, a in found if k == i]
        own = [False] * len(t)
        for a, b in repeats.merged(spans, t, gram, width):
            own[a:b] = [True] * (b - a)
        assert own == gone


@pytest.mark.parametrize("unit", [b"a", b"abc ", bytes(range(100)), bytes(range(152))])
def test_periodic_texts_have_few_anchors(unit):
    text = unit * (600_000 // len(unit))
    n = sum(len(repeats.anchors(units, sizes, 96, 400)[0]) for _, _, units, sizes in suffix_dedup.byte_chunks([text], 400))
    assert 2 <= n <= 12
    assert repeats.periodic_span(text, 500, 96, 400) == (0, len(text))


def test_very_long_repetitive_texts(spark):
    """10 MB of one byte, 10 MB of four and a million equal words, beside a few that share a stretch of them."""
    long_ = ["a" * 10_000_000, "abc " * 2_500_000, "again " * 1_000_000]
    rows = [*enumerate(long_), (3, "<" + "a" * 450), (4, ">" + "a" * 399), (5, "x " + "abc " * 40), (6, "again " * 36 + "end"), (7, "again " * 34 + "stop")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.strip_substrings(df).collect()}
    assert got == {0: 10_000_000, 1: 10_000_000, 2: 6_000_000, 3: 450, 4: 0, 5: 0, 6: 0, 7: 0}
    got = {r["doc_id"]: r["n_removed"] for r in rlz_dedup.strip_word_windows(df).collect()}
    assert got == {0: 0, 1: 2_500_000, 2: 1_000_000, 3: 0, 4: 0, 5: 40, 6: 36, 7: 0}


def test_passages_of_over_fifty_words_are_judged_by_bytes(spark):
    """51 to 120 words that two texts share are removed from both, and nothing else, if they have 400 bytes or more."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij\u00e9") for _ in range(rng.randint(2, 8)))
    rows, want = [], {}
    for k, n in enumerate([51, 51, 55, 60, 65, 70, 80, 120]):
        passage = " ".join(word() for _ in range(n))
        if k < 2:  # 51 words of 399 and of 400 bytes
            passage += "z" * (399 + k - len(passage.encode()))
        size = len(passage.encode())
        for d, (before, after) in enumerate(["<>", "[]"]):
            rows.append((2 * k + d, " ".join(word() for _ in range(30)) + before + passage + after + " ".join(word() for _ in range(200))))
            want[2 * k + d] = (size, 1) if size >= 400 else (0, 0)
    assert want[0] == (0, 0) and want[2] == (400, 1) and want[14][0] > 400
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.strip_substrings(df).collect()}
    assert got == want


def test_long_words_and_texts(monkeypatch):
    monkeypatch.setattr(rlz_dedup, "STRETCH", 50)
    text = b"a " * 40 + b"L" * 1000 + b" b" * 40
    words = [w for part in rlz_dedup.words_of(text) for w in part]
    assert len(words) == 81 and len(words[40]) == 17
    sizes = Counter()
    for numbers, begins, hashes, own in rlz_dedup.word_chunks([text, b"", b"x y"], 6):
        assert len(hashes) == own.sum()
        sizes.update(numbers.tolist())
    assert set(sizes) == {0}


# 10: licences


def test_license_scan(spark, odd, empty):
    mit = licenses.TEMPLATES[3][1]
    rows = [
        (1, "Prose.\nReleased under the MIT License.\nMore prose. Licensed under CC BY-NC 4.0. And so on."),
        (2, "Intro\n" + mit.replace("sell copies", "sell some copies") + "\nEnd."),
        (3, "The licence plate of the car was lost in the rain, and nobody could say who had taken it."),
        (None, "All rights reserved."),
        (5, None),
    ]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["block"], r["license"]) for r in got if r["confirmed"]) == [(0, 0, "Proprietary"), (1, 0, "MIT"), (1, 1, "CC-BY-NC-4.0"), (2, 0, "MIT")]
    assert [r["confirmed"] for r in got if r["doc_id"] == 3] == [False]
    two = next(r for r in got if r["doc_id"] == 2)
    assert two["n_differences"] == 1 and "some" in two["differences"] and rows[1][1][two["start"] : two["end"]].startswith("Permission")
    assert licenses.scan_licenses(empty).count() == 0 == licenses.scan_licenses(odd).count()


@pytest.mark.parametrize("k", range(len(licenses.TEMPLATES)))
@pytest.mark.parametrize("width", [30, 78])
def test_license_scan_of_wrapped_texts(k, width):
    name, template = licenses.TEMPLATES[k]
    other = licenses.TEMPLATES[7 if k != 7 else 3]
    for mark in ("", " * ", "# "):
        block = "\n".join(mark + x for x in textwrap.wrap(template, width))
        notice = "\n".join(mark + x for x in textwrap.wrap(other[1], width))
        text = f"Some prose here.\nCopyright (c) 2020 The Authors\n{block}\n{notice}\nint main() {{ return 0; }}\n"
        found = [f for f in licenses.scan(text) if f.confirmed]
        # reserved rights beside a licence belong to its notice
        assert [f.license for f in found] == [name, other[0]][name == licenses.NOBODYS :], mark
        assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))


BSD3 = f"Copyright (c) 2020, The Authors. All rights reserved.\n\n{licenses.BSD_TERMS}\n{licenses.BSD_NAMES}\n\n{licenses.BSD_DISCLAIMER}"


@pytest.mark.parametrize(
    "name, text",
    [
        ("BSD-3-Clause", BSD3),
        ("BSD-3-Clause", "BSD 3-Clause License\n\n" + "\n".join(" * " + x for x in textwrap.wrap(BSD3.replace("1. ", "").replace("2. ", "").replace("3. ", "").replace("copyright holder ", "University "), 78))),
        ("BSD-2-Clause", f"Copyright (c) 2020, The Authors. All rights reserved.\n\n{licenses.BSD_TERMS}\n\n{licenses.BSD_DISCLAIMER}"),
        ("ISC", f"Copyright (c) 2020 The Authors\n\n{licenses.ISC_TERMS}\n\n{licenses.ISC_DISCLAIMER}"),
        ("MIT", f"The MIT License (MIT)\n\nCopyright (c) 2020 The Authors. All rights reserved.\n\n{licenses.WORDINGS[3][1]}"),
        ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n"),
        ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n"),
        ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.,\n51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n\nPreamble"),
        ("AGPL-3.0", licenses.GNU_NOTICE.format(kind="Affero General", version=3).replace("This program", "Frobnicate")),
        *((x, f"// {licenses.TAG}: {x}\n// Copyright (c) 2020 The Authors. All rights reserved.\nint x;") for x in ("MIT", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0", "ISC", "GPL-3.0", "CC0-1.0")),
        ("GPL-2.0", f"# {licenses.TAG}: GPL-2.0-or-later\n"),
        ("LGPL-2.1", f"/* {licenses.TAG}: LGPL-2.1-only */"),
        ("MIT", f"# {licenses.TAG}: (MIT OR Apache-2.0)\n"),
    ],
)
def test_licenses_have_their_own_names(name, text):
    found = licenses.scan(text)
    assert [f.license for f in found if f.confirmed] == [name]
    assert not any(f.license == licenses.NOBODYS for f in found)


def test_license_candidates_by_brute_force(spark):
    """Each block's candidate against every template compressed and compared word by word."""
    import zstandard

    from conftest import DATA

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    raw = [zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in licenses.TEMPLATES]
    n = 0
    for _, text in docs:
        for f in licenses.scan(text or ""):
            block = text[f.start : f.end]
            sizes = [len(zstandard.ZstdCompressor(level=licenses.LEVEL, dict_data=d).compress(block.encode())) for d in raw]
            alone, own = len(zstandard.ZstdCompressor(level=licenses.LEVEL).compress(block.encode())), licenses.words(block)

            def differing(k):
                import difflib

                ops = difflib.SequenceMatcher(None, licenses.words(licenses.TEMPLATES[k][1]), own, autojunk=False).get_opcodes()
                return sum(max(b - a, d - c) for tag, a, b, c, d in ops if tag != "equal")

            k = min((k for k in range(len(sizes)) if sizes[k] <= min(sizes) + max(8, alone // 16)), key=lambda k: (differing(k), sizes[k], k))
            assert (f.license, f.template, f.size_alone, f.size_given, f.n_differences) == (licenses.TEMPLATES[k][0], k, alone, sizes[k], differing(k))
            assert f.confirmed == (differing(k) <= 0.15 * len(licenses.words(licenses.TEMPLATES[k][1])) and alone - sizes[k] >= 0.3 * alone)
            n += 1
    assert n > 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 4))
def test_longest_matches(numbers, levels):
    block = [*numbers, -1]

    def common(i, j):
        n = 0
        while max(i, j) + n < len(block) and block[i + n] == block[j + n]:
            n += 1
        return n

    want = [max((common(i, j) for j in range(len(block)) if j != i), default=0) for i in range(len(block))]
    assert rlz_dedup.longest_matches(np.array(block), levels).tolist() == [min(x, 1 << levels) for x in want]


# all: clashing names and very long texts


def test_clashing_columns_change_nothing(odd, clashing):
    path = vocabulary("word_bpe_49k.json")
    for apply in (
        lambda d: packing.pieces(d, path),
        lambda d: tokens.count_tokens(d, vocabulary("piece_bpe_32k.model")),
        suffix_dedup.strip_substrings,
        rlz_dedup.strip_word_windows,
        licenses.scan_licenses,
    ):
        assert rows_of(apply(clashing)) == rows_of(apply(odd))
    assert packing.pack_documents(clashing, path).columns == packing.pack_documents(odd, path).columns


def test_very_long_texts(spark):
    """Two megabytes in one text, and a near copy of it, through the operators that have no test of their own for this."""
    rng = random.Random(8)
    words = [f"w{rng.getrandbits(20)}" for _ in range(240_000)]
    notice = f"\n{licenses.TAG}: MIT\n"
    rows = [(1, " ".join(words) + notice, "a"), (2, " ".join(words[:-500] + ["other"] * 20) + notice, "b"), (3, "a short text of some few words", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"]: r["fingerprint"] for r in simhash.near_copies(df).collect()} == {d: simhash.fingerprint(t.encode()).hex() for d, t, _ in rows}
    assert {r["doc_id"]: r["text_sha256"] for r in exact_dedup.mark_copies(df).collect()} == {d: hashlib.sha256("".join(t.split()).encode()).hexdigest() for d, t, _ in rows}
    assert {r["doc_id"]: r["n_words"] for r in quality.judge(df).collect()} == {d: len(t.split()) for d, t, _ in rows}
    assert {r["doc_id"]: r["size"] for r in mixing.mix_counts(df).collect()} == {d: len(t.split()) for d, t, _ in rows}
    assert {(r["doc_id"], r["license"], r["start"]) for r in licenses.scan_licenses(df).collect()} == {(d, "MIT", rows[d - 1][1].index(licenses.TAG)) for d in (1, 2)}
    assert {r["doc_id"] for r in near_dedup.drop_near_copies(df).collect()} == {1, 3}
