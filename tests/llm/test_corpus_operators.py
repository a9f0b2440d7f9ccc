"""Fingerprints, decontamination, substring dedup, SimHash, tool calls."""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from silverloop.llm import decontaminate, fingerprint, simhash, substrings, toolcalls

CLASHING = ("_id", "_text", "_row", "_t", "_with", "fp", "n", "first", "hash", "kind", "cell", "runs", "spans", "_key", "_b", "d0")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})


def collected(df, *columns):
    order = lambda r: tuple((x is not None, x) if not isinstance(x, list) else str(x) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=order)


# -- fingerprints -------------------------------------------------------------


def paragraphs(text):
    return Counter(int(hashlib.md5(u.encode()).hexdigest()[:10], 16) for u in re.findall(fingerprint.UNITS, text))


def alike(a, b):
    n = sum(a.values()) + sum(b.values())
    return 1.0 if not n else (n - sum(abs(a[d] - b[d]) for d in {*a, *b})) / n


def edits(rows):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        yield i, t, t[: len(t) - len(t) // 4] + following[: len(t) // 4], following


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(7)
    line = lambda: "".join(rng.choices("abcdé ", k=rng.randint(0, 300)))
    rows = [(10 * i, "\n".join(line() for _ in range(rng.randint(0, 12)))) for i in range(40)]
    rows += [(401, None), (402, ""), (403, "same\n" * 50), (404, "same\n" * 50), (404, "twin"), (None, "null id"), (405, "\n".join(line() for _ in range(400)))]
    for buckets in (1, 7):
        got = collected(fingerprint.fingerprints(frame(spark, rows), buckets=buckets), "doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")
        want = [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), alike(paragraphs(t), paragraphs(e)), alike(paragraphs(t), paragraphs(n))) for i, t, e, n in edits(rows)]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(1, "a\nb"), (2, "c"), (3, "a\nb"), (4, None), (5, "")]
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    assert got[1] == got[3] != got[2] and got[4] == got[5] == "0;"
    alone = fingerprint.fingerprints(frame(spark, [(9, "abcdefgh")])).collect()
    assert alone[0].near_next == 1.0 and alone[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprint.fingerprints(frame(spark, []).where("false")).count() == 0


def test_native_plans_only(spark):
    plan = fingerprint.fingerprints(frame(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- decontamination ----------------------------------------------------------


def words10(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute_hits(docs, items, span):
    windows = {}
    for key, t in items:
        w = words10(t)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if key is None else str(key))
    out = []
    for key, t in docs:
        w, hit, found = words10(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (it := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= it
        out.append((key, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize(("span", "gram", "sent"), [(10, 5, 1000), (10, 5, 0), (6, 3, 1000), (4, 4, 1000)])
def test_winnowing_against_brute_force(spark, span, gram, sent):
    rng = random.Random(span)
    pick = lambda n: " ".join(rng.choices(["a", "B", "c1", "dé", "e-f", "G"], k=n))
    items = [(i, pick(rng.randint(0, 25))) for i in range(20)] + [(3, "x y"), (3, "x y"), (None, pick(12)), (77, None), (78, "-- !")]
    docs = [(i, pick(rng.randint(0, 60)) + rng.choice([" ", "\n", "..."]) + rng.choice(items[:20])[1]) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "X, Y!"), (5, docs[5][1]), (None, docs[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"kind": F.lit(1), "hash": F.lit(2)})
    found = decontaminate.contamination(frame(spark, docs), bench, span=span, gram=gram, max_sent=sent)
    got = collected(found, "doc_id", "n_words", "n_hit", "items")
    assert sorted(got, key=str) == sorted(brute_hits(docs, items, span), key=str)
    if span == 10 and sent:
        kept = decontaminate.clean(frame(spark, docs), bench)
        clean = [(k, t) for (k, t), r in zip(docs, brute_hits(docs, items, 10), strict=True) if not r[2]]
        assert sorted(collected(kept, "doc_id", "text"), key=str) == sorted(clean, key=str)
        nothing = decontaminate.contamination(frame(spark, docs), bench.where("false"))
        assert nothing.where("n_hit > 0").count() == 0 and nothing.count() == len(docs)
        assert decontaminate.contamination(frame(spark, docs).where("false"), bench).count() == 0


# -- substring dedup ----------------------------------------------------------


def brute_repeats(docs, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    count = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(docs, split, strict=True):
        gone = {i for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for i in range(k, k + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repetitive(seed):
    rng, docs = random.Random(seed), []
    for i in range(200):
        kind = i % 5
        if kind == 0:
            t = " ".join(rng.choices("abcdefgh", k=rng.randint(0, 80)))
        elif kind == 1:
            t = "x " * rng.randint(0, 90)
        elif kind == 2:
            t = " ".join(["p", "q", "r"][: rng.randint(2, 3)] * rng.randint(0, 40))
        else:
            t = docs[rng.randrange(len(docs))][1] or ""
            t = f"{t[: rng.randint(0, len(t))]}\t z {t}"
        docs.append((i, t))
    return [*docs, (900, None), (901, ""), (902, " \n"), (7, docs[7][1]), (None, docs[8][1])]


@pytest.mark.parametrize(("window", "rounds"), [(35, 6), (8, 3), (5, 0), (2, 1)])
def test_recompression_against_brute_force(spark, window, rounds):
    docs = repetitive(window)
    found = substrings.repeated_words(frame(spark, docs).repartition(5), window=window, rounds=rounds, filter_bits=14)
    got = collected(found, "doc_id", "n_words", "n_removed", "kept", "kept_sha256")
    assert sorted(got, key=str) == sorted(brute_repeats(docs, window), key=str)


def test_a_full_filter_changes_nothing(spark):
    docs = repetitive(1)
    found = substrings.repeated_words(frame(spark, docs), window=12, rounds=3, filter_bits=6)
    assert sorted(collected(found, "doc_id", "n_removed"), key=str) == sorted(((r[0], r[2]) for r in brute_repeats(docs, 12)), key=str)
    assert substrings.repeated_words(frame(spark, docs).where("false")).count() == 0


def test_rows_without_repeats_stay_as_they_are(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = [(1, f"one\n\n{passage}"), (2, passage), (3, "own  text\n"), (4, None)]
    out = substrings.without_repeats(frame(spark, docs))
    assert out.columns == ["doc_id", "text", *CLASHING]
    assert collected(out, "doc_id", "text") == [(1, "one"), (3, "own  text\n"), (4, None)]


def test_texts_under_one_id_are_told_apart(spark):
    """Different texts whose hashes agree in the low 31 bits, under a null id."""
    passage = " ".join(f"w{i}" for i in range(60))
    low = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) & 0x7FFFFFFF
    with_it = {low(t): t for t in (f"{passage} {k}" for k in range(150_000))}
    own = " ".join(f"own{i}" for i in range(20))
    clean = next(t for t in (f"{own} {k}" for k in range(1_000_000)) if low(t) in with_it)
    docs = [(None, with_it[low(clean)]), (None, clean), (5, with_it[low(clean)]), (1, passage)]
    got = collected(substrings.repeated_words(frame(spark, docs)), "doc_id", "n_words", "n_removed", "kept", "kept_sha256")
    assert sorted(got, key=str) == sorted(brute_repeats(docs, 35), key=str)
    assert collected(substrings.without_repeats(frame(spark, docs)).where("text like 'own%'"), "doc_id", "text") == [(None, clean)]


def test_symbols_depend_on_what_they_say(spark):
    """A symbol of a passage whose dependence lies inside it is in every text with the passage."""
    rng = random.Random(4)
    passage = [rng.getrandbits(64) for _ in range(80)]
    seen = []
    for _ in range(20):
        left, right = ([rng.choice(passage[:3]) if rng.random() < 0.3 else rng.getrandbits(64) for _ in range(rng.randint(0, 40))] for _ in range(2))
        text = np.array(left + passage + right, np.uint64)
        names, first, end, low, high = substrings.recompress(text, np.array([len(text)]), 5)
        inside = (low >= len(left)) & (high <= len(left) + 80)
        seen.append(set(zip(names[inside].tolist(), (first[inside] - len(left)).tolist(), (end[inside] - len(left)).tolist(), strict=True)))
    assert all(x == seen[0] for x in seen) and len(seen[0]) > 5


# -- SimHash ------------------------------------------------------------------


def brute_classes(docs):
    prints = []
    for _, t in docs:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs)))
    label = list(range(len(docs)))
    while True:
        new = [min(label[j] for j in range(len(docs)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(docs))]
        if new == label:
            break
        label = new
    low = {k: min((docs[i][0] for i in range(len(docs)) if label[i] == k and docs[i][0] is not None), default=None) for k in set(label)}
    return [(docs[i][0], prints[i], low[label[i]]) for i in range(len(docs))]


def test_simhash_classes_against_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choices(["Aa", "b", "cé", "d", "e", "f", "g"], k=300)) for _ in range(8)]
    docs = []
    for i in range(80):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "new"
        docs.append((i, rng.choice([" ", "\n"]).join(w)))
    docs += [(200, None), (201, ""), (202, " \t"), (203, "one two"), (204, "ONE two"), (5, docs[5][1]), (None, docs[6][1]), (None, "quite alone here then")]
    want = brute_classes(docs)
    got = collected(simhash.classes(frame(spark, docs)), "doc_id", "fp", "component_id")
    assert sorted(got, key=str) == sorted(((i, f - (1 << 64) if f >> 63 else f, c) for i, f, c in want), key=str)
    kept = simhash.keep_one(frame(spark, docs)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted({str(c) for _, _, c in want})
    assert simhash.classes(frame(spark, docs).where("false")).count() == 0


def test_one_row_of_each_class_whatever_the_ids(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(300)) for k in "abcd")
    docs = [(3, f"{a} end"), (5, a), (5, b), (5, b), (None, c), (None, d), (None, d), (None, a), (9, None), (None, "")]
    low = {i: l for (i, t), (_, _, l) in zip(docs, brute_classes(docs), strict=True) if t == a}
    assert low == {5: 3, None: 3}
    for parts in (1, 7):
        kept = simhash.keep_one(frame(spark, docs).repartition(parts))
        assert kept.columns == ["doc_id", "text", *CLASHING]
        assert collected(kept, "doc_id", "text") == [(None, c), (None, d), (3, f"{a} end"), (5, b), (9, None)]
    # of rows alike in id and text the same one stays, and a null in one column is not one in another
    rows = [(None, a, x, y) for x, y in (("p", None), (None, "p"), ("q", "r"))]
    for k in range(3):
        turned = spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, x string, y string").repartition(k + 1)
        chosen = [tuple(r) for r in simhash.keep_one(turned).collect()]
        first = chosen if not k else first
        assert len(chosen) == 1 and chosen == first


def test_bk_tree_links_connect_what_all_pairs_connect(spark):
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 14, 400).astype(np.uint64) * np.uint64(0x1000100010001))
    u, v = simhash.bk_links(values, 4)

    def count(pairs):
        root = {int(x): int(x) for x in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(int(a))] = find(int(b))
        return len({find(x) for x in root})

    pairs = [(a, b) for a in values for b in values if (int(a) ^ int(b)).bit_count() <= 4]
    assert count(zip(u, v, strict=True)) == count(pairs) and len(u) == len(values) - count(pairs)


@pytest.mark.parametrize("rows", [3, 1_000_000])
def test_shards_of_any_size_give_the_same_classes(spark, rows):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 40)
    values = np.unique(np.concatenate([base ^ (1 << int(b)) ^ (1 << int(c)) for b, c in rng.integers(0, 62, (6, 2))]))
    nodes = spark.createDataFrame([(int(x),) for x in values], "fp long")
    roots = simhash.components(simhash.links(nodes, 4, rows))
    label = {int(x): int(x) for x in values}
    changed = True
    while changed:
        changed = False
        for a in label:
            low = min(label[b] for b in label if (a ^ b).bit_count() <= 4)
            changed |= low < label[a]
            label[a] = min(low, label[a])
    got = {int(x): int(x) for x in values} | {r.node: r.root for r in roots.collect()}
    assert got == label


# -- tool calls ---------------------------------------------------------------

TOOLS = {
    "find": {
        "properties": {"q": {"type": "string"}, "n": {"type": "integer"}, "how": {"enum": ["a", "b"]}},
        "required": ["q"],
        "additionalProperties": False,
    },
    "free": {},
}
CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"


def test_tool_calls(spark):
    calls = [
        (1, "a", 1, "find", '{"q": "x", "n": 2, "how": "a"}', None), (1, "b", 2, "find", '{"n": 1.5, "how": "z", "more": 1}', ["a"]),
        (1, "c", 3, "free", "[1]", ["d"]), (1, "d", 4, "gone", "{}", ["zz", None]), (1, "e", 5, "find", "no json", []), (1, "e", 4, "find", '{"q": null}', []),
        (2, "a", 1, "free", '{"b": {"d": 1, "c": "é\\n"}, "a": [true, null]}', None), (2, "p", 1, "free", "{}", ["q"]), (2, "q", 1, "free", "{}", ["p"]),
        (None, "a", 1, "free", None, None), (1, None, 1, "free", "{}", None), (1, None, 2, "free", "{}", None),
    ]
    results = [(1, "a", 2, "late"), (1, "a", 1, "r"), (2, "a", 2, None), (None, "a", 2, "n"), (3, "a", 1, "lost"), (1, None, 1, "lost")]
    calls = spark.createDataFrame(calls, CALLS).withColumns({"line": F.lit(1), "_conv": F.lit(2)})
    results = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    plan = toolcalls.link(calls, results, TOOLS)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link(calls, results, TOOLS).collect()}
    assert len(got) == 10
    assert got[1, "a"].errors == [] and got[1, "a"].n_results == 2
    assert json.loads(got[1, "a"].line) == {"arguments": {"how": "a", "n": 2, "q": "x"}, "id": "a", "name": "find", "result": "r"}
    assert got[1, "b"].errors == ["how: not in enum", "n: not integer", "q: missing", "more: not allowed", "no result"]
    assert got[1, "c"].errors == ["arguments are not an object", "no result"] and (got[1, "c"].ready, got[1, "c"].depth) == (4, 1)
    assert got[1, "d"].errors == ["unknown tool", "after: unknown zz", "no result"] and got[1, "d"].depth == 0
    assert got[1, "e"].errors == ["q: not string", "repeated id", "no result"] and got[1, "e"].turn == 4
    assert got[2, "a"].line == '{"arguments":{"a":[true,null],"b":{"c":"é\\n","d":1}},"id":"a","name":"free","result":null}'
    assert "circular" in got[2, "p"].errors and "circular" in got[2, "q"].errors
    assert got[None, "a"].errors == ["arguments are not JSON"] and got[None, "a"].n_results == 1
    assert got[1, None].errors == ["no id", "repeated id", "no result"] or "no id" in got[1, None].errors
    assert toolcalls.link(calls.where("false"), results, TOOLS).count() == 0
    assert toolcalls.link(calls, results.where("false"), {}).count() == 10


def test_order_is_topological(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(6):
        names = [f"k{i}" for i in range(12)]
        rng.shuffle(names)  # dependencies go along this hidden order, whatever the turns
        for i, k in enumerate(names):
            rows.append((conv, k, rng.randint(0, 6), "free", "{}", rng.sample(names[:i], min(i, rng.randint(0, 3)))))
    calls = spark.createDataFrame(rows, CALLS)
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    at = {(r.conv_id, r.call_id): (r.ready, r.depth, r.turn) for r in toolcalls.link(calls, results, TOOLS).collect()}
    for conv, k, _, _, _, after in rows:
        assert all(at[conv, a] < at[conv, k] for a in after)
