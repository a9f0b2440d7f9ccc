"""Tokenizer alignment, periodic runs, MinHash near-duplicates: against brute force and the libraries."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from silverloop.llm import alignment, minhash, periods, queries

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASHING = ("_id", "_text", "_t", "key", "n", "bands", "bucket", "u", "v", "c", "links", "groups", "runs", "root", "node")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})


def odd_texts(rng, n):
    units = ["word", "Straße", "日本語", "𐍈", "é", "é", "don't", "x,", "y.", "end.\n", "\n", "\n\n", " ", "  ", "\t", "1234", "<|endoftext|>", "<s>", "a,b", ",", "..", " ", "　", "\r\n", "ﬁ", "‍", "👩‍👩‍👧", "\x00", "'s", "﻿", "▁"]
    return [rng.choice(["", " "]).join(rng.choice([" ", ""]) + rng.choice(units) for _ in range(rng.randint(0, 12))) for _ in range(n)]


# -- alignment ----------------------------------------------------------------


def whole_alignment(texts):
    """Both tokenizers over whole texts; bytes by decoding each token."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_raw, b_raw = alignment.spelled_bytes(a), alignment.spelled_pieces(b)
    out, count = [], Counter()
    for t in texts:
        x = a.encode(f" {t}", add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        raw = f" {t}".encode() if t else b""
        if b"".join(a_raw[i] for i in x) != raw or b"".join(b_raw[i] for i in y) != raw:
            x = y = []
        ends = [dict(zip(np.cumsum([len(r[i]) for i in z]).tolist(), range(len(z)), strict=True)) for r, z in ((a_raw, x), (b_raw, y))]
        groups, pairs, i0, j0 = [], [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            i, j = ends[0][e], ends[1][e]
            groups.append(",".join(map(str, x[i0 : i + 1])) + "|" + ",".join(map(str, y[j0 : j + 1])))
            pairs.append((x[i], y[j]))
            i0, j0 = i + 1, j + 1
        count.update(pairs)
        out.append((len(x), len(y), ";".join(groups), pairs))
    highest = Counter()
    for (_, b_id), n in count.items():
        highest[b_id] = max(highest[b_id], n)
    return [(na, nb, g, len(p), sum(count[x] == highest[x[1]] for x in p), sum(count[x] for x in p)) for na, nb, g, p in out]


def test_parts_align_as_whole_texts_do():
    rng = random.Random(11)
    texts = odd_texts(rng, 6000) + ["", " ", "  ", "a ", " a", "\na", "a\n", "a,", "a, b", "▁", "a▁b"]
    aligner = alignment._Aligner(*PATHS)
    assert aligner.cuts and aligner.breaks and aligner.stops == {",", "."}
    got = aligner(texts)
    for t, x, want in zip(texts, got, whole_alignment(texts), strict=True):
        n, groups, links = x or (0, "", b"")
        assert (n >> 32, n & 0xFFFFFFFF, groups, len(links) // 4) == want[:4], repr(t)


def test_memory_of_parts_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    aligner = alignment._Aligner(*PATHS)
    texts = odd_texts(random.Random(3), 400)
    assert aligner(texts[:200]) + aligner(texts[200:]) == alignment._Aligner(*PATHS)(texts)


def test_no_more_parts_are_held_between_steps_than_remembered(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    aligner, texts = alignment._Aligner(*PATHS), odd_texts(random.Random(3), 400)
    for a in range(0, 400, 100):
        aligner(texts[a : a + 100])
        assert len(aligner.known) + len(aligner.inner) <= 50


def test_alignment_query_against_whole_texts(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want = whole_alignment([t for _, t in docs])
    got = sorted(queries.QUERIES["op11_alignment"](spark, SF).collect())
    for (i, _), w, r in zip(docs, want, got, strict=True):
        digest = hashlib.sha256(w[2].encode()).hexdigest() if w[0] else ""
        assert tuple(r) == (i, w[0], w[1], w[3], w[3], w[4], w[5], digest)


def test_alignment_of_odd_rows(spark):
    long = "lorem ipsum, dolor. " * 60_000 + "日本" * 1000
    rows = [(1, None), (1, ""), (None, "a b"), (2, "a b"), (2, "a b"), (3, "has ▁ mark"), (4, long)]
    made = alignment.align(frame(spark, rows), *PATHS)
    made.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/odd-rows")
    got = alignment.weigh(spark.read.parquet(path), *PATHS).collect()
    want = whole_alignment([t for _, t in rows])
    key = lambda x: str(x)
    assert sorted([(r.doc_id, r.n_a, r.n_b, r.groups, r.n_links, r.n_best, r.count_sum) for r in got], key=key) == sorted([(i, *w) for (i, _), w in zip(rows, want, strict=True)], key=key)
    assert alignment.align(frame(spark, []).where("false"), *PATHS).count() == 0


def test_pairs_are_bounded_by_the_vocabularies():
    pairs = alignment.possible_pairs([b"", b"ab", b"b"], [b"b", b"xab", b"ab", b""])
    assert [divmod(int(p), 4) for p in pairs] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]


# -- periodic runs ------------------------------------------------------------


def brute_lyndon(s):
    return [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]


def brute_runs(s, min_words, min_exponent):
    found, n = set(), len(s)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            run = s[i : j + q]
            if len(run) >= max(min_words, min_exponent * q) and not any(run[r:] == run[:-r] for r in range(1, q)):
                found.add((i, len(run), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def rows_of_words(rng, n):
    for _ in range(n):
        size, letters = rng.randint(1, 60), rng.randint(1, 5)
        s = [rng.randrange(letters) for _ in range(size)]
        if rng.random() < 0.6:
            a, p = rng.randrange(size), rng.randint(1, 9)
            s = [s[i] if i < a else s[min(a + (i - a) % p, size - 1)] for i in range(size)]
        yield s


def test_grouping_makes_the_lyndon_array():
    for s in rows_of_words(random.Random(5), 1500):
        rank = {v: i for i, v in enumerate(sorted(set(s)))}
        s = [rank[v] for v in s]
        assert periods.lyndon_array(s, len(rank)).tolist() == brute_lyndon(s)


@pytest.mark.parametrize("limits", [(2, 2), (6, 3), (24, 3), (10, 4)])
def test_runs_against_brute_force(limits):
    for s in rows_of_words(random.Random(sum(limits)), 800):
        words = [f"w{x}".encode() for x in s]
        assert periods.text_runs(words, *limits) == brute_runs(words, *limits)


def tailed(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_periodic_query_against_brute_force(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    with_runs = 0
    for d in docs:
        words = tailed(d.doc_id, d.text)
        r = got[d.doc_id]
        if len(words) > 700:  # square time
            continue
        runs = brute_runs(words, 24, 3)
        with_runs += bool(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert with_runs > 5


def test_periodic_runs_of_odd_rows(spark):
    line = "to be or not to be " * 10
    rows = [(1, None), (1, ""), (None, line), (None, line), (2, " \n\t"), (3, "x " * 1_500_000), (4, "a b " * 11 + "a"), (5, "a b " * 12 + "  b")]
    got = sorted(([r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed] for r in periods.periodic_runs(frame(spark, rows)).collect()), key=str)
    want = [
        [1, 0, [], ""], [1, 0, [], ""], [2, 0, [], ""], [3, 1_500_000, [(0, 1_500_000, 1)], "x"],
        [4, 23, [], "a b " * 11 + "a"], [5, 26, [(0, 24, 2)], "a b   b"], [None, 60, [(0, 60, 6)], "to be or not to be"], [None, 60, [(0, 60, 6)], "to be or not to be"],
    ]
    assert got == sorted(want, key=str)
    assert periods.periodic_runs(frame(spark, []).where("false")).count() == 0


def test_steepest_run_compares_fractions(spark):
    rows = [([(0, 30, 7), (5, 60, 14), (9, 31, 7)],), ([(4, 60, 14), (0, 30, 7)],), ([],)]
    df = spark.createDataFrame(rows, "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    assert [tuple(r.t) if r.t else None for r in df.select(periods.steepest(F.col("runs")).alias("t")).collect()] == [(9, 31, 7), (4, 60, 14), None]


# -- MinHash ------------------------------------------------------------------


def shingles(text, k=3):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_classes(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[top(i)] = min(low.get(top(i), doc_id), doc_id)
    return [(d, len(s), low.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(rng, n_groups, copies):
    """Families of texts of which each copy changes a word or two of another one of the family."""
    rows, doc_id = [], 0
    for _ in range(n_groups):
        family = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 8, 25, 60, 120]))]]
        for _ in range(copies):
            words = list(rng.choice(family))
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(5000)}"
            family.append(words)
        for words in family:
            rows.append((doc_id, " ".join(words)))
            doc_id += 1
    rng.shuffle(rows)
    return rows


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_minhash_against_brute_force(spark):
    rows = near_copies(random.Random(13), 25, 16)
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "One two"), (9004, "one  TWO"), (9005, "one"), (9006, "one two three"), (9007, "ÄB c d"), (9008, "äb c d")]
    assert as_rows(minhash.classes(frame(spark, rows))) == sorted(brute_classes(rows), key=str)


def test_minhash_chain_through_a_centre_that_links_nobody(spark):
    """A bucket of several classes is worked on until no star finds a link."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(40):  # neighbours are similar, the ends of the chain are not
        rows.append((k, " ".join([f"z{i}" if i < 2 * k else w for i, w in enumerate(base)] if k < 30 else [f"q{rng.randrange(99)}" for _ in base])))
    assert as_rows(minhash.classes(frame(spark, rows), bands=24, rows=2)) == sorted(brute_classes(rows), key=str)


def test_minhash_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_minhash"](spark, SF)
    assert as_rows(got) == sorted(brute_classes(docs), key=str)
    assert got.where("kept <> (doc_id = component_id)").count() == 0


def test_minhash_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (None, text), (7, text + " more"), (7, "another text altogether"), (None, "alone but null"), (3, None)]
    assert as_rows(minhash.classes(frame(spark, rows))) == sorted(brute_classes(rows), key=str)
    only_empty = [(1, None), (2, ""), (2, "")]
    assert as_rows(minhash.classes(frame(spark, only_empty))) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]
    assert minhash.classes(frame(spark, []).where("false")).count() == 0


def test_minhash_of_a_very_long_text_and_a_hot_set(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one text in a third of all rows").alias("text"))
    docs = copies.unionByName(frame(spark, [(5000, long), (5001, long[:-9])]).select("doc_id", "text"))
    got = minhash.classes(docs)
    assert got.groupBy("component_id").count().orderBy("component_id").collect() == [(0, 3000), (5000, 2)]


def test_densified_signatures_of_equal_sets_are_equal_and_filled():
    few = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 3).astype(np.uint64) * np.uint64(2))
    values = minhash.signature(few, 192)
    assert set(values.tolist()) == set(few.tolist())
    shares = [np.mean(values == v) for v in few]
    assert min(shares) > 0.2  # empty bins choose among all that are full


def one_bucket(spark, words):
    """Nodes and texts of word lists that all share one bucket."""
    rows = [(str(i).encode(), hashlib.md5(t.encode()).digest(), len(minhash.shingle_set(t, 3)), [7], t) for i, t in enumerate(map(" ".join, words))]
    df = spark.createDataFrame(rows, "key binary, _t binary, n long, bands array<long>, _text string")
    return df.select("key", "_t", "n", "bands"), df.select("_t", "_text")


def test_minhash_loses_no_link_of_a_large_bucket(spark):
    """Two similar texts among 150 others of one bucket, in which no star of the first rounds finds a link."""
    words = [[f"a{k}_{i}" for i in range(60)] for k in range(150)]
    words += [[f"z{i}" for i in range(60)], [f"z{i}" for i in range(60)] + ["end"]]
    linked = minhash.links(*one_bucket(spark, words)).collect()
    assert {(bytes(r.node), bytes(r.root)) for r in linked} - {(b"150", b"150")} == {(b"151", b"150")}


def test_blocks_of_a_large_bucket_meet_across_classes(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    words = [[w if rng.random() > 0.0004 * k else f"x{rng.random()}" for w in base] for k in range(70)]
    nodes, texts = one_bucket(spark, words)
    members = nodes.selectExpr("7L AS bucket", "70L AS size", "key", "n")
    kept = nodes.join(texts, "_t").select("key", "_text")
    # forty are of one class, the others of classes of their own
    roots = nodes.select(F.col("key").alias("node"), F.lit(b"0").alias("root")).where("CAST(CAST(node AS string) AS int) < 40")
    got = {(bytes(r.u), bytes(r.v)) for r in minhash._rest(members, roots, kept, 3, 85, side=8).collect()}
    sets = {str(i).encode(): set(minhash.shingle_set(" ".join(w), 3).tolist()) for i, w in enumerate(words)}
    across = {(a, b) for a in sets for b in sets if a < b and max(int(a), int(b)) >= 40}
    wanted = {(a, b) for a, b in across if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert wanted and wanted <= got < across
