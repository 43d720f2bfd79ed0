"""Token counts, language ID, token files, PII and SentencePiece against brute force."""

import hashlib
import io
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kestrel.llm import language_id as I
from kestrel.llm import pii as P
from kestrel.llm import queries as Q
from kestrel.llm import sentencepiece_codec as C
from kestrel.llm import token_counts as T
from kestrel.llm import token_files as W

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "the  the", " lead", "trail  ", "tab\tand\r\nline", "é ß ☃ 😀", "x" * 5000,
       "don't can't 12345 ___ --- ...", "<|endoftext|> text", "nul\0byte", "a b   c", "wordswithoutend" * 40]


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# --- token counts -------------------------------------------------------------------

def greedy(word, initial, inner):
    n, i, pieces = 0, 0, initial
    while i < len(word):
        end = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if end is None:
            return 1, 1
        i, n, pieces = end, n + 1, inner
    return n, 0


@given(st.lists(st.text("abc", min_size=1, max_size=5), max_size=12), st.lists(st.text("abc", min_size=1, max_size=5), max_size=12),
       st.lists(st.text("abcd", min_size=1, max_size=14), min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_automaton_is_greedy_longest_match(initial, inner, words):
    initial, inner, words = ({x.encode() for x in s} for s in (initial, inner, words))
    if not initial and not inner:
        return
    words = sorted(words)
    got = T.Automaton.build(initial, inner).count(words).tolist()
    assert got == [n + unknown * T.UNKNOWN for n, unknown in (greedy(w, initial, inner) for w in words)]


def test_token_counts_match_a_wordpiece_model(spark, rows):
    from tokenizers import Tokenizer, models, pre_tokenizers

    initial, inner = T.byte_level_vocabulary(public_tokenizers.path(T.VOCABULARY))
    # The library works on characters: one character per byte.
    name = lambda b: b.decode("latin-1")
    vocab = {p: i for i, p in enumerate(dict.fromkeys(
        ["[UNK]", *map(name, initial), *("##" + name(b) for b in inner)]))}
    model = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**9)
    got = {r.doc_id: r for r in Q.QUERIES["op2_token_counts"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, r in list(rows.items())[:60]:
        words = r.text.encode().split()
        assert got[i].n_words == len(words)
        assert got[i].n_tokens == sum(len(model.tokenize(name(w))) for w in words)


def test_token_counts_cases(spark, make_docs):
    a = T.Automaton.build([b"the", b"t", b"a"], [b"he", b"e", b"end"])
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown)
           for r in T.token_counts(make_docs(["the then\tthee", None, "", " \n", "thend a zz", (None, "a")]), a).collect()}
    assert got == {1: (3, 4, 1), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (3, 3, 2), None: (1, 1, 0)}
    assert T.token_counts(make_docs([]), a).collect() == []


# --- language ID --------------------------------------------------------------------

def test_language_held_out_accuracy(spark, rows):
    got = Q.QUERIES["op5_language_id"](spark, SF).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_folded_weights_equal_the_kernel_form():
    """Scores by the folded matrix are the kernel columns of the landmarks times the dual weights."""
    texts = [f"der die das {x} und" for x in "abcdef"] + [f"the of and {x} is" for x in "abcdef"]
    codes, labels = [I.grams(t) for t in texts], ["de"] * 6 + ["en"] * 6
    model = I.solve(codes, labels, landmarks=len(texts))
    k = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in codes] for a in codes])
    y = np.array([[float(a == b) for b in ("de", "en")] for a in labels])
    lhs = k.T @ k + I.RIDGE * len(texts) * k + 1e-9 * len(texts) * np.eye(len(texts))
    want = k @ np.linalg.solve(lhs, k.T @ (y - y.mean(axis=0))) + y.mean(axis=0)
    assert np.allclose(model.scores(codes), want, atol=1e-3)


def test_language_cases(spark, make_docs):
    train = [(i, f"der die das und {i} nicht" if i % 2 else f"the of and {i} is not", "de" if i % 2 else "en")
             for i in range(1, 60)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "12 34 !!", "de"), (103, "die der und das", None), (None, "the of and", "en")]
    got = {r.doc_id: r for r in I.identify(make_docs(train + odd).withColumn("score", F.lit("clash"))).collect()}
    assert [got[i].language.lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].language.score == 0
    assert got[103].language.lang_pred == "de" and got[None].language.lang_pred == "en"
    assert {r.doc_id for r in I.known_language(make_docs(train + odd)).collect()} == set(got) - {100, 101, 102}
    assert [r.language.lang_pred for r in I.identify(make_docs([(1, "x", None)])).collect()] == ["und"]
    assert I.identify(make_docs([])).collect() == []


def test_language_learns_from_every_row(spark, make_docs):
    """Model and threshold follow rows far beyond the weight of a language, however they are dealt."""
    rng = np.random.default_rng(3)
    words = {"de": "der die das und nicht ist".split(), "en": "the of and is not are".split()}
    docs = [(i, " ".join(rng.choice(words["de" if i % 2 else "en"], 3)), "de" if i % 2 else "en") for i in range(3000)]
    df = make_docs(docs)
    model, again = I.fit(df), I.fit(df.repartition(7))
    assert (model.weights == again.weights).all() and (model.bias == again.bias).all()

    def kernel_form(rows, marks):
        k = np.stack([marks.columns(I.grams(t)) for _, t, _ in rows])
        y = np.array([[float(lang == x) for x in ("de", "en")] for *_, lang in rows])
        w = y @ (np.minimum(800, y.sum(axis=0)) / y.sum(axis=0))
        bias = (w[:, None] * y).sum(axis=0) / w.sum()
        phi = marks.present / marks.root
        lhs = (k * w[:, None]).T @ k + I.RIDGE * w.sum() * phi.T @ phi + 1e-9 * w.sum() * np.eye(k.shape[1])
        return phi @ np.linalg.solve(lhs, (k * w[:, None]).T @ (y - bias)), bias

    train = [r for r in docs if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    sizes = spark.createDataFrame([(x, sum(r[2] == x for r in train)) for x in words], "lang string, rows long")
    learned = df.filter(I.fold(F.col("doc_id")) != 1)
    weights, bias = kernel_form(train, I.Landmarks(I._landmarks(learned, sizes, I.LANDMARKS)))
    assert min(r.rows for r in sizes.collect()) > 800
    assert np.allclose(model.weights, weights, atol=1e-2 * np.abs(weights).max()) and np.allclose(model.bias, bias)


def test_least_gain_is_of_all_held_out_rows(spark, make_docs):
    docs = [(i, "der die das und nicht" if i % 2 else "the of and is not", "de" if i % 2 else "en") for i in range(14_000)]
    model = I.fit(make_docs(docs))
    held = [i for i, *_ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    share = {r.id: r.share for r in spark.createDataFrame([(i,) for i in held], "id long").select(
        "id", I.hash_share(F.col("id")).alias("share")).collect()}
    last = sorted(held, key=share.get)[-40:]          # a sample by the hash never came to these
    poor = {i: "der qwx zzy und" if i % 2 else "the qwx zzy and" for i in last}
    mixed = make_docs([(i, poor.get(i, t), lang) for i, t, lang in docs])
    gains = sorted(r.f.gain for r, lang in ((r, r.lang) for r in mixed.filter(I.fold(F.col("doc_id")) == 1).select(
        "lang", I.predict(spark, model)(F.col("text")).alias("f")).collect()) if r.f.lang_pred == lang)
    want = max(I.LEAST, I.SLACK * gains[-(-len(gains) * 5 // 1000) - 1])
    assert want < I.SLACK * gains[len(gains) // 2] and abs(I.least_gain(mixed, model) - want) < 1e-9


def test_long_words_before_other_signs_end():
    """A word of Latin letters followed by anything else is not tried in all its parts; ids are the library's."""
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path(W.TOKENIZER))
    words = ["x" * 70 + "中", "ab" * 40 + "1.", "Donaudampfschifffahrtsgesellschaft7", "the...end\nof", "a", "...", "'s", "", "\t", "é!"]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words, 8)) for _ in range(300)] + ["", " ", "a\n", "a \n b", " a", words[0]]
    encoder = W.ChunkEncoder(tokenizer.to_str(), special=True)
    for _ in range(2):        # the second time from the cache
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


JUNK = ["asdkjh qwlkj zxmcn qpwoei lkjasd mnbzxc qwepoi", "xkcd zzzz qqqq vvvv wwww kkkk", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ",
        "for (int i = 0; i < n; ++i) { a[i] += b[i]; }", "Это русский текст о погоде и природе в нашей стране",
        "この文章は日本語で書かれています", "to jest polski tekst o pogodzie w naszym kraju"]


@pytest.mark.parametrize("languages", [("de", "en"), ("de", "en", "fr"), ("de", "en", "es", "fr")])
def test_unclear_languages_are_rejected(spark, make_docs, languages):
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("lang").isin(*languages))
    junk = make_docs([(10**9 + i, t, None) for i, t in enumerate(JUNK)]).select(clean.columns)
    kept = {r.doc_id for r in I.known_language(clean.unionByName(junk)).select("doc_id").collect()}
    assert max(kept) < 10**9
    assert len(kept) >= 0.985 * clean.count()


# --- token files --------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(W.TOKENIZER))
    t.encode_special_tokens = True
    return t


def test_chunk_encoder_equals_the_library(tokenizer, rows):
    enc = W.ChunkEncoder(tokenizer.to_str())
    texts = [t or "" for t in ODD] + [r.text for r in rows.values()]
    for _ in range(2):   # the second time from the cache
        for t, ids in zip(texts, enc.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


@given(st.text(st.sampled_from(" \n\t \x1c'ab1é_-😀"), max_size=25))
@settings(max_examples=200, deadline=None)
def test_chunk_encoder_on_odd_blanks(text):
    from tokenizers import Tokenizer

    global _ENC, _TOK
    if "_ENC" not in globals():
        _TOK = Tokenizer.from_file(public_tokenizers.path(W.TOKENIZER))
        _ENC = W.ChunkEncoder(_TOK.to_str())
    assert np.frombuffer(_ENC.encode([text])[0], "<u4").tolist() == _TOK.encode(text, add_special_tokens=False).ids


def test_seekable_files_read_single_frames_and_find_damage():
    import zstandard

    out = io.BytesIO()
    w = W.SeekableWriter(out)
    parts = [b"first" * 100, b"", b"third"]
    assert [w.append(p) for p in parts] == [0, 1, 2]
    w.close()
    r = W.SeekableReader(io.BytesIO(out.getvalue()))
    assert [r.read(i) for i in (2, 0, 1)] == [parts[2], parts[0], parts[1]]
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(parts)
    bad = bytearray(out.getvalue())
    bad[int(r.offsets[2]) + 12] ^= 1
    with pytest.raises(Exception):
        W.SeekableReader(io.BytesIO(bytes(bad))).read(2)
    assert W.SeekableReader(io.BytesIO(bytes(bad))).read(0) == parts[0]
    with pytest.raises(ValueError):
        W.SeekableReader(io.BytesIO(out.getvalue()[:-1]))


def test_token_files_query(spark, rows, tokenizer):
    got = {r.doc_id: r for r in Q.QUERIES["op6_token_files"](spark, SF).collect()}
    at = 0
    for i in sorted(rows):
        ids = [*tokenizer.encode(rows[i].text or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


def test_added_tokens_in_a_text_are_those_of_the_library_as_loaded(spark, make_docs, rows, tmp_path):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(public_tokenizers.path(W.TOKENIZER))
    odd = [*ODD, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  <|endoftext|>\n", "<|endoftext |>", "a <|endoftext|"]
    want = {i: loaded.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(odd, 1)}
    assert 50256 in want[len(ODD) + 1]
    path = str(tmp_path / "files")
    manifest = W.write_token_files(make_docs(odd), loaded.to_str(), path)
    assert {r.doc_id: r.ids[:-1] for r in W.read_token_files(manifest, path).collect()} == want
    enc = W.ChunkEncoder(loaded.to_str(), special=True)
    texts = [t or "" for t in odd] + [r.text for r in rows.values()]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [
            loaded.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_cases(spark, make_docs, tokenizer, tmp_path):
    docs = make_docs([(5, "five"), (2, None), (None, "none"), (5, "five"), (9, "")])
    path = str(tmp_path / "files")
    manifest = W.write_token_files(docs, tokenizer.to_str(), path)
    only = W.read_token_files(manifest.filter("doc_id = 5"), path).collect()
    assert [r.ids for r in only] == [[*tokenizer.encode("five").ids, 0]] * 2
    assert W.write_token_files(make_docs([]), tokenizer.to_str(), path).collect() == []


# --- PII ----------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(t) if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m.group().split("."))]
    out += [(m.start(), m.end(), 2) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and P.luhn(digits(m))]
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


@given(st.text(st.sampled_from("a1250.@+- ()x%é"), max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans_match_the_patterns(text):
    assert P.base_spans(text) == brute_spans(text)


def test_base_spans_cases(rows):
    for t in ["a@b.c@d.e", "x@@y.z", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111-1111 1111", "4111  1111", "+1 (017) 555-7713",
              "+123", "0000001.2.3.4", "9" * 9000, "a." * 3000 + "@b.c", *(r.text for r in rows.values())]:
        assert P.base_spans(t) == brute_spans(t), t[:80]


def test_pii_query_keeps_base_spans(spark, rows):
    got = Q.QUERIES["op9_pii"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute_spans(rows[r.doc_id].text or "")
        joined = [f"{P.KINDS[k]}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for *_, k in base) for x in range(4))
        assert set(joined) <= set(r.spans.split(",")) and len(r.spans.split(",")) - (r.spans == "") == len(base) + r.n_added


def test_selector_adds_other_writings_and_leaves_clean_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = P.fit(docs)
    assert max(model.thresholds) <= 1
    text = "write to jane.doe@mail1.example.com or jane.doe at mail1 dot example dot com please"
    added = model.added(text, P.base_spans(text))
    assert [text[a:b] for a, b, _ in added] == ["jane.doe at mail1 dot example dot com"]
    text = "seen from 10[.]20[.]30[.]40 today"
    assert [text[a:b] for a, b, _ in model.added(text, [])] == ["10[.]20[.]30[.]40"]
    for clean in ("Licensed under CC BY-NC 4.0.", "version 3.1.4 of 2019", "pages 12 - 34, 56 to 78", "1234567812345678", ""):
        assert model.added(clean, P.base_spans(clean)) == [], clean


def test_pii_cases(spark, make_docs):
    docs = make_docs([None, "", "a@b.cd", (None, "1.2.3.4"), ("x" and 9, "no")]).withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in P.find_pii(docs, P.fit(docs)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1].base_sha256 == got[2].base_sha256 == got[9].base_sha256 == empty and got[1].spans == ""
    assert got[3].spans == "email:0:6" and got[None].spans == "ip:0:7"
    assert P.find_pii(make_docs([]), P.fit(make_docs([]))).collect() == []


# --- SentencePiece ------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return C.production_vocabulary()


def best_segmentation(v, word):
    """Plain Viterbi over one word."""
    ints = lambda b: np.frombuffer(b, np.int32).tolist()
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            hit = v.pieces.get(word[start:end])
            if hit is None and end - start > 1:
                continue
            score, ids = (hit[0], ints(hit[1])) if hit else (
                v.unknown, [i for b in word[start:end].encode() for i in ints(v.byte_ids[b])])
            if best[end] is None or best[start][0] + score > best[end][0]:
                best[end] = (best[start][0] + score, best[start][1] + ids)
    return best[-1][1]


def test_words_match_plain_viterbi(vocabulary, rows):
    words = {w for r in list(rows.values())[:40] for w in C.marked_words(r.text)}
    words |= {w for t in ODD if t and len(t) < 200 for w in C.marked_words(t)}
    got = {w: np.frombuffer(x, np.int32).tolist() for w, x in vocabulary.encode_words(words).items()}
    assert got == {w: best_segmentation(vocabulary, w) for w in words}
    assert vocabulary.cut and vocabulary._viterbi(words) == vocabulary.encode_words(words)


def test_long_runs_take_memory_linear_in_their_length(vocabulary):
    import tracemalloc

    rng = np.random.default_rng(5)
    runs = ["".join(map(chr, rng.integers(0x4E00, 0x9FA6, 200_000))),
            "".join(map(chr, rng.integers(ord("a"), ord("z") + 1, 200_000)))]
    for run in runs:
        tracemalloc.start()
        try:
            # Grows with the square of the length or not: seen on a tenth, before the whole run is tried.
            vocabulary.encode(run[:20_000])
            assert tracemalloc.get_traced_memory()[1] < 20_000 * 1000
        finally:
            tracemalloc.stop()
        ids = vocabulary.encode(run)
        assert vocabulary.decode(ids) == run
        assert ids[:100] == vocabulary.encode(run[:2000])[:100]


def test_segmentations_match_the_library_lattice(vocabulary, rows):
    """The same vocabulary loaded as a unigram model: its lattice's best path has the same score."""
    import sentencepiece

    def field(b, number, start, end):
        """Start and end of a field of a protocol buffer message."""
        def varint(i):
            v = s = 0
            while True:
                c, i = b[i], i + 1
                v, s = v | (c & 127) << s, s + 7
                if not c & 128:
                    return v, i
        i = start
        while i < end:
            key, i = varint(i)
            at = i
            if key & 7 == 0:
                _, i = varint(i)
            elif key & 7 == 2:
                size, at = varint(i)
                i = at + size
            else:
                i += {1: 8, 5: 4}[key & 7]
            if key >> 3 == number:
                return at, i

    model = bytearray(open(public_tokenizers.path(C.MODEL), "rb").read())
    model[field(model, 3, *field(model, 2, 0, len(model)))[0]] = 1   # model_type: unigram
    sp = sentencepiece.SentencePieceProcessor(model_proto=bytes(model))
    words = sorted({w for r in list(rows.values())[:10] for w in r.text.split() if w.isalpha()})[:400]
    score = lambda ids: sum(sp.get_score(i) for i in ids)
    for w in words:
        assert score(vocabulary.encode(w)) == score(sp.nbest_encode_as_ids(w, 1)[0])


def test_marked_words_and_decoding_match_the_library(vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(C.MODEL))
    for t in ODD:
        t = t or ""
        assert "".join(C.marked_words(t)) == "".join(sp.id_to_piece(i) if not sp.is_byte(i) else "?" for i in sp.encode(t)) \
            or any(sp.is_byte(i) for i in sp.encode(t))
        ids = vocabulary.encode(t)
        assert vocabulary.decode(ids) == t == sp.decode(ids)


@given(st.text(max_size=40))
@settings(max_examples=100, deadline=None)
def test_round_trip(text):
    global _VOC
    if "_VOC" not in globals():
        _VOC = C.production_vocabulary()
    text = text.encode("utf-8", "ignore").decode()
    ids = _VOC.encode(text)
    assert _VOC.decode(ids) == text.replace(C.MARK, " ")


def test_sentencepiece_query_and_cases(spark, make_docs, rows, vocabulary):
    got = Q.QUERIES["op10_sentencepiece"](spark, SF).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    want = {i: [x for w in C.marked_words(rows[i].text) for x in best_segmentation(vocabulary, w)] for i in list(rows)[:20]}
    assert {r.doc_id: list(r.ids) for r in got if r.doc_id in want} == want
    docs = make_docs([*ODD, (None, "x")]).withColumn("ids", F.lit("clash"))
    out = C.encode(docs, vocabulary).collect()
    assert [r.n_tokens for r in out[:2]] == [0, 0] and len(out) == len(ODD) + 1
    assert C.encode(make_docs([]), vocabulary).collect() == []


def test_octets_of_thousands_of_digits(spark, make_docs):
    for text in ("1.2.3." + "0" * 5000, "1.2.3." + "0" * 5000 + "255", "1.2.3." + "0" * 5000 + "256", "9" * 5000 + ".1.1.1"):
        assert P.base_spans(text) == brute_spans(text)
        assert P.find_pii(make_docs([text]), None).first().n_ip == sum(s[2] == 1 for s in brute_spans(text))


def test_spelled_out_addresses_are_proposed():
    for text in ("jane [at] example.com", "jane(at)example.com", "jane at example.com", "jane AT example dot com", "x (at) y.z"):
        assert any(k == 0 and (a, b) == (0, len(text)) for a, b, k in P.proposals(text)), text
    assert P.proposals("we met at noon. Then at home we ate") == []


def test_proposals_recall_of_rewritings():
    """Every rewriting the trees learn from is proposed as a whole."""
    rng = random.Random(5)
    want = got = 0
    for _ in range(300):
        kind = rng.randrange(4)
        s = [f"ann.{rng.randrange(99)}@mail{rng.randrange(9)}.example.org", ".".join(str(rng.randrange(256)) for _ in range(4)),
             "4" + "".join(rng.choice("0123456789") for _ in range(15)), f"+{rng.randrange(10, 99)} {rng.randrange(100, 999)} {rng.randrange(10**6, 10**7)}"][kind]
        for text in P.rewritings(s, kind):
            near = f"See {text} now"
            want += 1
            got += (4, 4 + len(text), kind) in P.proposals(near)
    assert got >= 0.9 * want


def test_many_spans_in_one_text():
    text = " ".join(f"user{i}@host{i}.example.com and u{i}(at)h{i}.org" for i in range(20_000))
    start = time.process_time()
    base = P.base_spans(text)
    taken = P.Taken(base)
    free = [p for p in P.proposals(text) if not taken.meets(p[0], p[1])]
    assert len(base) == 20_000 and len(free) >= 20_000 and time.process_time() - start < 8
    for p in random.Random(1).sample(free, 200):
        assert not any(p[0] < b[1] and b[0] < p[1] for b in base)


def test_long_words_are_counted_by_the_same_automaton():
    automaton = T.Automaton.build([b"a", b"ab", b"abc", b"b"], [b"a", b"b", b"c", b"ab", b"bca", b"cab"])
    rng = random.Random(9)
    words = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (1, 2, 5, 40, 511, 512, 513, 3000)] + [b"abx" * 400]
    assert [automaton.count_one(w) for w in words] == [int(automaton.count([w])[0]) for w in words]
    batch = T.LONGEST_BATCHED
    try:
        T.LONGEST_BATCHED = 10_000
        assert automaton.count(words).tolist() == [automaton.count_one(w) for w in words]
    finally:
        T.LONGEST_BATCHED = batch
    start = time.process_time()
    automaton.count([b"abc" * 350_000])
    assert time.process_time() - start < 3
