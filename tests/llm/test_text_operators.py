"""Language ID, HTML, SentencePiece, token files, WARC packages."""

from __future__ import annotations

import hashlib
import io
import random
import zipfile
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from silverloop.llm import htmltext, langid, pieces, queries, tokenfiles, warczip
from silverloop.llm.common import shared_path

# Names that operators use inside, as columns of their own.
CLASHING = {"_id": "x", "_text": "y", "_row": "z", "_t": "w", "lang_pred": "v", "ids": "u", "n": "t", "start": "s"}
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
TEXTS = [None, "", " ", "a", "The cat sat on the mat.", "The cat sat on the mat.", "Der Hund läuft über die Straße", "1234 !!", "日本語 🎉\x00 x", "a  b\n\n c\t", "word " * 3000]


@pytest.fixture
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (None, "null id")]
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in CLASHING.items()})


@pytest.fixture
def none(docs):
    return docs.where("false")


def test_languages(spark, docs, none):
    rng = random.Random(3)
    words = {"en": "the of and to in that is was for with".split(), "de": "der die und das nicht ist mit ein zu auf".split(), "fr": "le la les et des que une dans est pour".split()}
    made = [(i, " ".join(rng.choices(words[k], k=20)), k) for i, k in enumerate(list(words) * 40)]
    train = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = langid.train(train.where("doc_id % 4 <> 2").unionByName(spark.createDataFrame([(None, None, None), (900, None, "en")], train.schema)))
    assert model[0] == ["de", "en", "fr"]
    held = langid.predict(train.where("doc_id % 4 = 2"), model).join(train, "doc_id")
    assert held.where("lang = lang_pred").count() == held.count() == 30
    got = langid.predict(docs, model).collect()
    assert len(got) == docs.count()
    assert all((r.lang_pred == "und" and r.score == 0) == (r.doc_id in (0, 1, 2, 7)) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    # a score does not depend on what is in the batch
    one = {r.doc_id: r.score for r in langid.predict(docs.repartition(7), model).collect()}
    assert one == {r.doc_id: r.score for r in got}
    assert langid.predict(none, model).count() == 0
    empty = langid.train(train.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    kept = langid.filtered(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    with pytest.raises(ValueError):
        langid.train(train, max_cells=1 << langid.BUCKET_BITS)


def test_naive_bayes_against_brute_force(spark):
    train = spark.createDataFrame([(1, "ab ba", "x"), (2, "cd", "y"), (3, "abc", "x")], "doc_id long, text string, lang string")
    names, logs = langid.train(train)
    counts = {k: np.ones(1 << langid.BUCKET_BITS) for k in names}
    for t, k in (("ab ba", "x"), ("cd", "y"), ("abc", "x")):
        for a in langid.features([t])[0]:
            np.add.at(counts[k], a, 1)
    for i, k in enumerate(names):
        assert np.array_equal(logs[i], np.rint(np.log(counts[k] / counts[k].sum()) * langid.UNIT).astype(np.int32))
    # n-grams of 1 to 3 letters inside words padded by one space, none over the end of a text
    assert [len(a) for a in langid.features(["ab", "c"])[0]] == [7, 5, 3]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies on this site to make it better for you and for all others.</div>
<nav><ul><li><a href=x>menu</a></ul></nav><main><article><h1>Title &amp; more</h1><p>First <b>&lt;para&gt;</b> of the   text,
long enough to be a peak of text in the page.<script>var t="</p>";</script><p>Second para</p><div class="ad">Buy now</div><p>Tail</p></article></main>
<aside>side</aside><div class=comments><p>I think that this very long reader comment is about the article in question.</p></div>
<form><p>sign up</p></form><footer>&copy; foot</footer></body></html>"""


def test_html(spark):
    found = htmltext.main_lines(htmltext.lines(PAGE))
    assert found == ["Title & more", "First <para> of the text, long enough to be a peak of text in the page.", "Second para", "Tail"]
    long = "long text " * 20
    assert htmltext.main_lines(htmltext.lines(f"<nav>x</nav><div><p>{long}</p><p>short</p></div><div class='sidebar'>no</div><p>end</p>")) == [long.strip(), "short"]
    assert htmltext.main_lines(htmltext.lines("plain")) == ["plain"]
    assert htmltext.main_lines(htmltext.lines("a < b")) == ["a < b"]
    assert htmltext.main_lines(htmltext.lines("<!-- x")) == []
    assert htmltext.main_lines(htmltext.lines("<script>x")) == []
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (4, "w", "<p>" + "x" * 300_000)], "page_id long, url string, html string")
    pages = pages.withColumns({"_id": F.lit(1), "_url": F.lit(2), "text": F.lit(3)})
    out = htmltext.extract(pages)
    got = out.collect()
    assert out.columns == ["page_id", "url", "text"] and len(got) == 5
    assert sorted(len(r.text) for r in got)[:2] == [0, 0] and max(len(r.text) for r in got) == 300_000
    assert htmltext.extract(pages.where("false")).count() == 0


def test_short_lines_of_the_main_region_stay():
    main = lambda html: htmltext.main_lines(htmltext.lines(html))
    long, ad = ("long text " * 20).strip(), "<div class='ad'>Buy now</div>"
    for tag in ("p", "div"):
        block = lambda t: f"<{tag}>{t}</{tag}>"  # noqa: E731, B023
        page = f"<nav>x</nav><div><h2>Title</h2>{ad}{block('one')}{ad}{block(long)}<aside>y</aside>{block('two')}{ad}{block('end')}</div><div><p>other</p></div>"
        assert main(page) == ["Title", "one", long, "two", "end"]
    assert main(f"<section><div>Title</div>{ad}<ul><li>{long}</li></ul>{ad}<p>end</section>") == ["Title", long, "end"]
    assert main(f"<article><h1>Title</h1><p>short</p></article>{ad}<div><p>{long}</p></div>") == ["Title", "short", long]
    for name in ("content has-sidebar", "post-header", "no-ads", "with-nav main"):
        assert main(f"<div class='{name}'><h1>Title</h1><p>{long}</p></div><div class='main-nav'>menu</div>") == ["Title", long]
    assert main(f"<nav>x</nav><div class='widget'><p>{long}</p></div>") == [long]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def test_sentencepiece_against_the_library(spark, vocabulary, docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    alphabet = list("abcdefghij  the ing\n\té日本—,.;ABC123")
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(500)]
    texts += [" " * k + "the" + " " * j for k in range(20) for j in range(0, 40, 3)]
    texts += ["".join(rng.choices(vocabulary.pieces, k=rng.randint(1, 40))).replace("▁", " ") for _ in range(500)]
    texts += [t for t in TEXTS if t is not None] + ["▁a", "ab" * 2000]
    encoder = pieces.Encoder(vocabulary)
    for t, raw in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(raw, "<i4").tolist() == sp.encode(t), t[:80]
    encoded = pieces.encode(docs, vocabulary)
    rows = pieces.decode(encoded, vocabulary).collect()
    assert len(rows) == docs.count()
    want = sorted((r.text or "") for r in docs.collect())
    assert sorted(r.text for r in rows) == want
    assert all(r.ids == sp.encode(r.text) for r in rows)
    assert pieces.decode(pieces.encode(none, vocabulary), vocabulary).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [1, 2, int(vocabulary.byte_ids[0xFF])])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(odd, vocabulary).collect()} == {1: "", 2: "", 3: "�"}


def test_one_python_pass_encodes_and_decodes(spark, vocabulary, docs, none):
    two = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    one = pieces.encode_and_decode(docs, vocabulary)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and two._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert pieces.encode_and_decode(none, vocabulary).count() == 0
    assert corpus_pipeline.encoded(spark, docs, "")._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_sentencepiece_query_is_one_python_pass(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    folder = "/root/testdata/sf0.001"
    made = queries.QUERIES["op1_sentencepiece"](spark, folder)
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = sp.encode(r.text or "")
        want[r.doc_id] = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in made.collect()} == want


def test_decoding_of_odd_lists(vocabulary):
    the, byte = vocabulary.spelled.index(b" the"), vocabulary.byte_ids
    lists = [[], [the], [the, the], [1, the], [], [byte[0xE6]], [byte[0x97], byte[0xA5]], [byte[0x20], byte[0x20]], []]
    offsets = np.cumsum([0, *map(len, lists)])
    ids = np.array([i for x in lists for i in x], np.int32)
    got = pieces.Decoder(vocabulary)(offsets, ids).to_pylist()
    assert got == ["", "the", "the the", "the", "", "\ufffd", "\ufffd\ufffd", " ", ""]
    assert pieces.Decoder(vocabulary)(np.array([0, 0]), ids[:0]).to_pylist() == [""]
    for wrong in (-1, vocabulary.size):
        with pytest.raises(ValueError):
            pieces.Decoder(vocabulary)(np.array([0, 1]), np.array([wrong], np.int32))


def test_words_are_matched_by_units(vocabulary, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    met = []
    paths = pieces.Encoder._paths
    monkeypatch.setattr(pieces.Encoder, "_paths", lambda self, units: met.extend(units) or paths(self, units))
    monkeypatch.setattr(pieces, "REMEMBERED", 60)
    monkeypatch.setattr(pieces, "AT_ONCE", 40)
    encoder, rng = pieces.Encoder(vocabulary), random.Random(9)
    assert encoder(["thing.\nThing thing,\nThing"]) and sum("hing" in x for x in met) == 2  # each unit once
    units = ["word", "Straße", "日本語", "𐍈", "é", "don't", "x,", "y.", "end.\n", "\n", " ", "  ", "\t", "1234", "<s>", "..", "　", "\x00", "▁", "a" * 40]
    for _ in range(8):
        texts = [rng.choice(["", " "]).join(rng.choice([" ", ""]) + rng.choice(units) for _ in range(rng.randint(0, 12))) for _ in range(60)]
        for t, raw in zip(texts, encoder(texts), strict=True):
            assert np.frombuffer(raw, "<i4").tolist() == sp.encode(t), repr(t)
        assert len(encoder.known) < 1000 and len(encoder.units) < 1000


def test_pieces_side_by_side_are_those_of_merging(vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoder, rng = pieces.Encoder(vocabulary), random.Random(5)
    starts = [p for p in vocabulary.pieces if p.startswith("▁") and len(p) > 1]
    inner = [p for p in vocabulary.pieces if "▁" not in p]
    a, b = rng.choices(starts, k=2000), rng.choices(inner, k=2000)
    got = encoder.side_by_side(*(np.array([sp.piece_to_id(p) for p in x]) for x in (a, b)))
    assert got.tolist() == [sp.encode(x[1:] + y, out_type=str) == [x, y] for x, y in zip(a, b, strict=True)]


def test_packed_integers():
    edge = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    for v in (edge, edge[:1], edge[:0], np.arange(70_000, dtype=np.uint32)):
        assert np.array_equal(tokenfiles.unpack(*tokenfiles.pack(v), len(v)), v)
    control, data = tokenfiles.pack(edge)
    assert len(control) == 3 and len(data) == 1 * 3 + 2 * 2 + 3 * 2 + 4 * 2
    with pytest.raises(ValueError):
        tokenfiles.unpack(control, data[:-1], len(edge))


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_compressed_ids(kind):
    ids, counts = np.array([0, 1, 255, 256, 50256, 65535, 0, 0], "<u4"), np.array([1, 6, 1])
    if kind == "<u4":
        ids[3] = 2**24
    made = tokenfiles._zip(ids, counts, kind)
    assert len(made) == 3 and tokenfiles._unzip(made, counts).tolist() == ids.tolist()
    assert tokenfiles._unzip(made[1:2], counts[1:2]).tolist() == ids[1:7].tolist()


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    tokens, rng = tokenfiles._Tokens(path, False), random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", " \n", "\t", "'s", "9", "é", "!", " x", "\x1c", "<|endoftext|>", "日"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(3000)]
    for t, raw in zip(texts, tokens(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == model.encode(t, add_special_tokens=False).ids, t
    shards = tokenfiles.write(docs, shared_path(spark, "t"), path, shards=3)
    got = sorted(tokenfiles.read(spark, shards).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start = 0
    for r, (key, text) in zip(got, rows, strict=True):
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (r.key, r.start, bytes(r.ids)) == (key, start, ids) and zlib.crc32(r.ids) == zlib.crc32(ids)
        start += len(ids) // 4
    assert tokenfiles.read(spark, tokenfiles.write(none, shared_path(spark, "t"), path)).count() == 0


class _Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, model):
        self.model, self.n = model, 0

    def encode_batch_fast(self, texts, **kw):
        self.n += len(texts)
        return self.model.encode_batch_fast(texts, **kw)


def test_new_words_are_encoded_together():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, tokens, rng = Tokenizer.from_file(path), tokenfiles._Tokens(path, False), random.Random(7)
    words = ["".join(rng.choices("abcdefé9", k=8)) for _ in range(9000)]
    text = "".join(w + rng.choice([" ", ", ", ".\n", "\n", "\n- "]) for w in words)
    tokens.model = counted = _Counted(tokens.model)
    for t in (text, text[::-1]):
        ids, n = tokens.flat([t])
        assert ids.tolist() == model.encode(t, add_special_tokens=False).ids and n.tolist() == [len(ids)]
    assert counted.n < 400


def test_words_are_told_apart(tmp_path, monkeypatch):
    from tokenizers import AddedToken, Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.add_special_tokens([AddedToken("<m>", lstrip=True)])  # takes the space before it
    model.save(path := str(tmp_path / "t.json"))
    rng = random.Random(3)
    units = ["a", "b.", "<|endoftext|>", "Ġ", "Ċ", "é", "\n", "\nc", " ", "  ", "\t", "x,\ny.", ",", "\u00a0", "\u0085", "\x1c", "\r\n", "9", "日本"]
    texts = ["".join(rng.choice(units) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["a <m> b c", "d <m> e, <m> f\ng <m>"]
    expected = [model.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 300)
    monkeypatch.setattr(tokenfiles, "JOINED", 3)
    tokens = tokenfiles._Tokens(path, False)
    for a in range(0, len(texts), 40):
        got = [np.frombuffer(x, "<u4").tolist() for x in tokens(texts[a : a + 40])]
        assert got == expected[a : a + 40]
        assert tokens.ends[len(tokens.known)] <= len(tokens.ids)


class _Bytes:
    def __init__(self, data):
        self.data, self.size = data, len(data)

    def __call__(self, start, length):
        return self.data[start : start + length]


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_forms(zip64):
    raw = b"".join(warczip.package([("a/b", [b"xy", b"z"]), ("c", [])], zip64=zip64))
    assert zipfile.ZipFile(io.BytesIO(raw)).read("a/b") == b"xyz"
    found = warczip.members(_Bytes(raw))
    at, size = found["a/b"]
    assert raw[at : at + size] == b"xyz" and found["c"][1] == 0
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as made:
        made.writestr("one", b"PK\x05\x06 in the data")
        made.comment = b"PK\x05\x06 in a comment"
        made.writestr(zipfile.ZipInfo("two"), b"2")
        made.writestr("packed", b"0" * 100, zipfile.ZIP_DEFLATED)
    raw = buffer.getvalue()
    found = warczip.members(_Bytes(raw))
    assert set(found) == {"one", "two"} and raw[found["two"][0] :][:1] == b"2"
    with pytest.raises(ValueError):
        warczip.members(_Bytes(b"no zip"))


def test_warc(spark):
    long, other = "é" * 80, "b" * 100
    rows = [(5, "u 1", long), (3, "u", long), (3, None, long), (None, "n", long), (7, "v", other), (8, "w", "short"), (9, "x", "short"), (10, "y", None), (11, "z", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"_id": F.lit(1), "_digest": F.lit(2), "_first": F.lit(3)})
    got = warczip.read(spark, warczip.write(pages, shared_path(spark, "w"))).collect()
    key = lambda r: (r.id is None, r.id or 0, r.record_type)
    found = [(r.id, r.record_type, r.refers_to, r.payload_bytes) for r in sorted(got, key=key)]
    assert found == [
        (3, "response", None, 160), (3, "revisit", 3, 160), (5, "revisit", 3, 160), (7, "response", None, 100), (8, "response", None, 5),
        (9, "response", None, 5), (10, "response", None, 0), (11, "response", None, 0), (None, "revisit", 3, 160),
    ]
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {long, other, "short", ""}
    assert warczip.write(pages.where("false"), shared_path(spark, "w")) == []
    assert warczip.read(spark, []).count() == 0
