"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import os
import random
import string

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, html, jaccard, media, mixing, quality, substring, warc
from corpusloom.llm.words import hash_words

DOCS = "doc_id long, text string, k string, spans int"  # extra columns with names that the operators use themselves


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 6))) for _ in range(150)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 120))) for _ in range(n)]
    shared = " ".join(rng.choices(vocab, k=40))
    for i in range(0, n, 4):
        w = texts[i].split()
        at = rng.randint(0, len(w))
        texts[i] = " ".join(w[:at]) + "\n" + shared + "\t" + " ".join(w[at:])
    for i in range(1, n, 6):
        w = texts[i - 1].split()
        if w:
            w[rng.randrange(len(w))] = "CHANGED"
        texts[i] = " ".join(w)
    texts += [texts[0], texts[0], texts[5], None, "", "   ", "one", "one two", "One two", " ".join(["same"] * 40), "x" * 5000]
    rows = [(i * 3, t, "k", 1) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, texts[0], "k", 1), (None, None, None, None)]


def words(t):
    return (t or "").encode().split()


def test_substring_matches_brute_force(spark):
    rows = corpus()
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    want = collections.Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = bytearray(len(w))
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = b"\1" * 13
        kept = [x for x, g in zip(w, gone) if not g]
        want[(i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    out = substring.remove_repeats(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, out)) == want
    assert sum(x[2] * n for x, n in want.items()) > 500


def test_substring_automaton_statistics():
    a = substring.SuffixAutomaton()
    a.append("a b c d b c".split())
    a.append("x b c e".split())
    assert a.statistics("b c d z b c e".split()) == [1, 2, 3, 0, 1, 2, 3]
    assert substring.matched_spans([1, 2, 3, 0, 1, 2, 3, 4], 3) == [(0, 3), (4, 8)]


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_matches_brute_force(spark, n, percent):
    rows = corpus(seed=9)
    lower = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().translate(lower).split()
        if i is not None:
            sets[i] = frozenset([tuple(w)]) if 0 < len(w) < n else frozenset(zip(*[w[q:] for q in range(n)]))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    out = jaccard.near_duplicate_components(spark.createDataFrame(rows, DOCS), n, percent, block=4).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root(r.doc_id))
    kept = jaccard.keep_one(spark.createDataFrame(rows, DOCS), n, percent)
    assert kept.columns == ["doc_id", "text", "k", "spans"]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in sets if root(i) == i)
    assert ids.count(None) == 2


def test_group_bound_never_cuts_a_link():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 2**63, rng.integers(9, 200), dtype=np.uint64)
        a = np.unique(a)
        b = np.unique(np.concatenate((rng.permutation(a)[: len(a) - rng.integers(0, 4)], rng.integers(0, 2**63, rng.integers(0, 4), dtype=np.uint64))))
        both = jaccard.overlap(a, b)
        points = jaccard.common_points([jaccard.group_counts(a), jaccard.group_counts(b)])
        assert np.minimum(*points).sum() >= both
        linked = 100 * both >= 90 * (len(a) + len(b) - both)
        found = bool(jaccard.link_forest([(1, 1, a)], [(2, 2, b)], 90))
        assert found == linked


def test_large_group_of_near_copies_is_linked_by_few_rows(spark):
    """Copies of two templates with their own edits, in blocks of 16: components as by brute force, edges in proportion to documents."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("aeinrst") for _ in range(5)) for _ in range(400)]
    rows = []
    for base in (rng.choices(vocab, k=90), rng.choices(vocab, k=70)):
        for _ in range(150):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "EDIT" + str(rng.randrange(10**6))
            rows.append((len(rows), " ".join(w)))
    sets = {i: frozenset(zip(*[t.lower().split()[q:] for q in range(3)])) for i, t in rows}
    union = jaccard.Union()
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                union.join(a, b)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard.near_duplicate_components(docs, 3, 90, block=16).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: union.root(i) for i in sets}
    assert len(set(union.root(i) for i in sets)) > 2
    hot, jaccard.HOT = jaccard.HOT, 8
    try:
        again = jaccard.near_duplicate_components(docs, 3, 90, block=16).collect()
    finally:
        jaccard.HOT = hot
    assert sorted(again) == sorted(out)
    clusters = spark.createDataFrame([(i, 0, len(s)) for i, s in sets.items()], "doc_id long, cluster long, n_shingles long")
    assert jaccard._links(docs, clusters, 3, 90, 16).count() <= 3 * len(sets)


def test_long_structured_words_do_not_collide():
    """Two words of the Thue-Morse sequence and its complement, which any polynomial modulo 2**64 confuses."""
    a = bytes(97 + bin(i).count("1") % 2 for i in range(4096))
    b = bytes(97 + (bin(i).count("1") + 1) % 2 for i in range(4096))
    h, doc = hash_words([a, b, a.upper()], lower=True)
    assert h[0] != h[1] and h[0] == h[2] and doc.tolist() == [0, 1, 2]


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["a", "b", "b", "b", None]), 1) for i in range(300)]
    rows += [(1, rows[1][1], rows[1][2], 1), (None, "a b", "c", 1), (7000, None, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.plan_mix(df, interval_rows=16).collect()
    assert len(out) == len(rows)
    assert sorted(map(str, out)) == sorted(map(str, mixing.plan_mix(df.repartition(7), interval_rows=16).collect()))
    total = sum(len(words(t)) for _, t, *_ in rows)
    per = {}
    for r in out:
        p = per.setdefault(r.source, [r.source_size, r.target, 0, 0])
        p[2] += r.taken
        p[3] += r.size
        assert 0 <= r.taken <= 2 * r.size
    assert abs(sum(p[1] for p in per.values()) - 1.5 * total) < 1e-6
    for size, target, taken, added in per.values():
        assert size == added and abs(taken - target) <= 1 and target <= 2 * size + 1e-9
    # weights 3, 1, 2, 3 over a, b, c, null: sources below their cap share by weight
    share = {s: p[1] / w for (s, p), w in zip(sorted(per.items(), key=lambda x: (x[0] is None, x[0] or "")), (3, 1, 2, 3)) if p[1] < 2 * p[0] - 1e-9}
    assert max(share.values()) - min(share.values()) < 1e-6
    mixed = mixing.mix(df.drop("size"), interval_rows=16)
    assert mixed.columns == ["doc_id", "text", "source"]
    assert mixing.plan_mix(df.limit(0)).count() == 0


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(2)
    letters = "aethinorsABÉßΣςσ'sd.,!?12½²Ⅷ٣ \t\n\x1c\x85 é́中文字🙂<|endoftext|>İǅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += [None, "", "<|endoftext|>a<|startoftext|>", "".join(rng.choice("aethinors") for _ in range(12000)), "!?.-" * 4000]
    out = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    dec = {r.doc_id: r for r in bpe.decode(out, path).collect()}
    trip = {r.doc_id: r for r in bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert dec[i].ids == ids and dec[i].decoded == text
        assert trip[i].n_tokens == len(ids) and trip[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert trip[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_runs_without_spaces_are_linear_and_equal(spark):
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    enc, library = bpe.Encoder(bpe.MergeTable(path)), Tokenizer.from_file(path)
    rng = random.Random(2)
    for text in ("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(30_000)), "the" * 9000, "é" * 7000, "ab" * 5000 + " " + "中文字" * 2000):
        assert enc(text) == library.encode(text, add_special_tokens=False).ids
    began = time.time()
    assert len(enc("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(300_000)))) > 100_000
    assert time.time() - began < 15


def test_bpe_of_no_rows_null_ids_and_clashing_columns(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    schema = "doc_id long, text string, ids string, n_tokens string"
    assert bpe.round_trip(spark.createDataFrame([], schema), path).collect() == []
    got = bpe.round_trip(spark.createDataFrame([(None, None, "x", "y"), (None, "a b", "x", "y")], schema), path).collect()
    assert sorted(r.n_tokens for r in got) == [0, 2] and {r.doc_id for r in got} == {None}


def test_bpe_stream_emits_before_the_end():
    import public_tokenizers

    table = bpe.MergeTable(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    ids = [table.vocab[c] for c in (rng.choice("ethanorsi") for _ in range(20000))]
    seen = 0

    def counted():
        nonlocal seen
        for i in ids:
            seen += 1
            yield i

    stream = table.stream(counted())
    head = next(stream)
    assert seen < len(ids)
    assert head and [*head, *(i for part in stream for i in part)] == table.merge(list(ids))


def test_bpe_stream_settles_words_where_no_merge_crosses():
    """Cut at every place that no merge crosses, runs of several blocks give the tokens of a merge over the whole."""
    import public_tokenizers

    table = bpe.MergeTable(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(9)
    alphabet = [table.vocab[c] for c in "abcdefghijklmnopqrstuvwxyz0123456789-.éß" if c in table.vocab]
    many = 0
    for _ in range(600):
        ids = [rng.choice(alphabet) for _ in range(rng.randint(1, 1500))]
        parts = list(table.stream(ids))
        many += len(parts) > 1
        assert [i for part in parts for i in part] == table.merge(list(ids))
    assert many > 300
    assert list(table.stream([])) == []


def test_bpe_long_texts_come_in_chunks():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    enc, library = bpe.Encoder(bpe.MergeTable(path)), Tokenizer.from_file(path)
    rng = random.Random(3)
    words = ["".join(rng.choice("aethinorsd.,é!2") for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    gaps = [" ", "\n", "\t", "\u3000", "\xa0", " <|endoftext|> ", "\x1c", "   "]
    for text in ("".join(rng.choice(words) + rng.choice(gaps) for _ in range(40_000)), "x" * 70_000 + " " + "y1" * 70_000, " " * 200_000, "a " * 100_000):
        chunks = list(enc.chunks(text))
        assert [i for c in chunks for i in c] == library.encode(text, add_special_tokens=False).ids
        assert max(map(len, chunks), default=0) < bpe._CHUNK + 4 * bpe._TEXT < len(text)


def test_quality_learns_and_scores_all(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    good = [" ".join(rng.choices(vocab, k=80)) + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(vocab, k=40)) for _ in range(150)]
    rows = list(enumerate([*good, *bad])) + [(900, None), (901, ""), (None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(out) == len(rows) and all(0 <= s <= 1 for s in out.values())
    hidden = [r.doc_id for r in docs.where(quality.held_out(docs.doc_id)).collect() if r.doc_id is not None and r.doc_id < 300]
    assert len(hidden) > 40 and sum((out[i] >= 0.7) == (i < 150) for i in hidden) / len(hidden) > 0.95
    empty = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_html_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class="ad banner">Buy</div>
    <article><h1>Head &amp; line</h1><p>First   one<br>two&nbsp;three</p><p>Tiny.</p><form><input>go</form><script>var t="</p>";</script><p><b>bold</p></article>
    <div id="comments"><p>reader says</p></div><footer>end</footer>"""
    assert html.main_text(page) == "Head & line\n\nFirst one two three\n\nTiny.\n\nbold"
    plain = "<body><ul>" + "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(8)) + "</ul>" + "<p>" + "A long sentence of the text. " * 20 + "</p>" * 1
    assert html.main_text(plain + "<p>" + "More words follow here. " * 20 + "</p></body>").startswith("A long sentence")
    assert html.main_text("") == "" and html.main_text("<p>") == "" and html.main_text("just text") == "just text"


def test_html_implied_ends_and_class_names_lose_no_text():
    body = "<p>First para of the text.</p><p>Second</p>"
    assert html.main_text("<html><head><title>T</title><meta charset=x>" + body) == "First para of the text.\n\nSecond"
    assert html.main_text('<div class="content has-sidebar">' + body + "</div>") == "First para of the text.\n\nSecond"
    assert html.main_text('<article><p>One</p><p class="notice">N<p>Second real para<p>Third</article>') == "One\n\nSecond real para\n\nThird"
    assert html.main_text('<article><ul><li class="share">Share<li>Real item<li>x</ul><p>After</article>') == "Real item\n\nx\n\nAfter"
    assert html.main_text('<article><div class="entry-header"><h1>Title</h1></div><p>Text of it.</p></article>') == "Title\n\nText of it."
    assert html.main_text('<article><table><tr><td class="ad">Buy<td>Cell<tr><td>Next</table></article><div id="site-footer">F</div>') == "Cell\n\nNext"
    assert html.main_text("<main>" + "<div>" * 3000 + "deep" + "<p>x " * 3000 + "</main>").startswith("deep\n\nx")


def test_html_extract_of_no_pages_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text int, n_chars string")
    assert html.extract(empty).collect() == [] and html.extract(empty).columns == ["page_id", "url", "text", "n_chars"]
    one = spark.createDataFrame([(None, "u", "<p>a", 7, "x")], "page_id long, url string, html string, text int, n_chars string")
    assert [tuple(r) for r in html.extract(one).collect()] == [(None, "u", "a", 1)]


def test_html_extract_edges(spark):
    rows = [(1, "u", None), (2, None, "<p>a &unknown; b"), (2, None, "<p>a &unknown; b"), (3, "u", "<article><p>" + "é" * 9)]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in out) == [(1, "", 0), (2, "a &unknown; b", 13), (2, "a &unknown; b", 13), (3, "é" * 9, 9)]


def test_warc_records_are_linked(spark):
    rows = [(1, "http://a/", "<html lang=\"en\"><title>A &amp; B</title><p>Hello<script>x</script></p><a href='/b'>b</a>"), (2, None, None)]
    src = warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))
    ids = {r.record_id for r in src.collect()}
    made = warc.derivatives(src)
    out = made.withColumn("raw", warc.serialised(made)).collect()
    assert len(out) == 4 and {r.refers_to for r in out} == ids and len({r.record_id for r in out}) == 4
    for r in out:
        assert r.content_length == len(r.block.encode()) and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.headers and r.raw.endswith("\r\n\r\n")
        assert ("WARC-Target-URI" in r.headers) == (r.target_uri is not None)
    text = {(r.warc_type, r.target_uri): r.block for r in out}
    assert text["conversion", "http://a/"] == "Hello\nb" and text["conversion", None] == ""
    assert "title: A & B\r\n" in text["metadata", "http://a/"] and "outlinks: 1\r\n" in text["metadata", "http://a/"]


def test_media_round_trip(spark, tmp_path):
    texts = ["", None, "a", "é" * 300, "x" * 576, "y" * 577, "z" * 200_000, "a"]
    rows = list(enumerate(texts)) + [(None, "b"), (2, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "archives")
    media.write_archives(media.pack(docs), path)
    back = media.read_archives(spark, path, range_bytes=700)
    assert back.rdd.getNumPartitions() > 3
    out = collections.defaultdict(list)
    for r in media.describe(back).collect():
        out[r.doc_id].append(r)
    assert sum(map(len, out.values())) == len(rows) and len(out[2]) == 2
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        r = out[i][0]
        padded = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
    assert out[2][0][1:] == out[7][0][1:]
    assert media.describe(media.read_archives(spark, str(tmp_path / "none"))).count() == 0


def test_media_member_is_retried(tmp_path, spark):
    path = str(tmp_path / "a")
    media.write_archives(media.pack(spark.createDataFrame([(1, "abc")], "doc_id long, text string")), path)
    reader = media.ArchiveReader(path, 1 << 20, 3)
    fs, root = media.filesystem(path)
    span = next(s for s in reader.partitions() if s.path)

    class Flaky:
        left = 1

        def open_input_file(self, p):
            if Flaky.left:
                Flaky.left -= 1
                raise OSError("lost")
            return fs.open_input_file(p)

    import zipfile

    info = zipfile.ZipFile(fs.open_input_file(span.path)).infolist()[0]
    assert media.from_wav(reader._member(Flaky(), span.path, info)).startswith(b"abc")


def test_quality_held_out_accuracy_on_the_tables(spark):
    """Area under the curve over the held-out labels of sf0.01, by ranks."""
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels)).where(quality.held_out(F.col("doc_id")))
    rows = scored.join(labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 10 and len(bad) > 10
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_quality_of_no_rows_and_clashing_columns(spark):
    schema = "doc_id long, text string, quality int, score double, x string"
    rows = [(1, "a b", 5, 9.0, "x"), (1, "a b", 5, 9.0, "x"), (2, None, None, None, None), (3, "y" * 300_000, 1, 1.0, "z")]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    model = quality.train(docs.drop("quality"), labels)
    out = quality.score(docs, model).collect()
    assert sorted(r.doc_id for r in out) == [1, 1, 2, 3] and out[0].score == out[1].score
    assert quality.score(none, quality.train(none.drop("quality"), labels)).collect() == []
    assert quality.keep_good(docs, model, 0.0).count() == 4 and quality.keep_good(none, model).columns == none.columns


def test_warc_of_no_pages_ties_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, record_id int, payload string, digest string, block int, made string"
    assert warc.derivatives(warc.responses(spark.createDataFrame([], schema))).collect() == []
    rows = [(1, "u", "<p>a</p>" * 20_000, 1, "p", "d", 1, "m"), (1, "u", "<p>a</p>" * 20_000, 1, "p", "d", 1, "m"), (None, None, "", None, None, None, None, None)]
    out = warc.derivatives(warc.responses(spark.createDataFrame(rows, schema))).collect()
    assert len(out) == 6 and len({tuple(r) for r in out}) == 4
    assert {r.block for r in out if r.warc_type == "conversion"} == {"\n".join("a" * 20_000), ""}
    odd = spark.createDataFrame([("r", "u", None, None, "x", 1, "t")], "record_id string, target_uri string, date string, http_headers string, payload string, warc_type int, title string")
    assert {r.warc_type for r in warc.derivatives(odd).collect()} == {"metadata", "conversion"}


def test_media_of_no_rows_and_clashing_columns(spark):
    schema = "doc_id long, text string, media string, n_bytes string"
    assert media.media_columns(spark.createDataFrame([], schema)).collect() == []
    out = media.media_columns(spark.createDataFrame([(1, "a", "m", "n"), (1, "a", "m", "n"), (None, None, None, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in out) == [(0, 0), (1, 1), (1, 1)] and len({tuple(r) for r in out}) == 2


LONG = "A long sentence of the article that goes on for a while, with words. " * 6


def test_html_regions_come_from_ratios_and_keep_what_is_between_their_ends():
    page = "<body><h2>Title</h2>" + f"<p>{LONG}</p>" * 6 + "<p>Short last.</p><p>ok</p></body>"
    assert html.main_text(page).split("\n\n")[0] == "Title" and html.main_text(page).endswith("Short last.\n\nok")
    assert html.main_text('<body><form id="aspnetForm"><h1>T</h1>' + f"<p>{LONG}</p>" * 4 + "</form></body>").startswith("T\n\nA long")
    assert html.main_text('<article><p>One two.</p><section class="related-work"><p>Work.</p></section><p class="share-price">Price 3.</p><div class="related-posts">More</div></article>') == "One two.\n\nWork.\n\nPrice 3."
    assert html.main_text("<p>Let <math><mi>x</mi></math> be <script>s()</script>real.</p>") == "Let x be real."
    comments = f'<article><p>{LONG}</p></article><ol class="commentlist"><li>I agree</li></ol><div class="discussion"><p>{LONG}</p></div><article class="comment"><p>{LONG}</p></article>'
    assert html.main_text(comments) == LONG.strip()
    assert html.main_text(f'<article><p>{LONG}</p><section id="discussion"><p>We discuss.</p></section></article>').endswith("We discuss.")
    # Without any mark, the block that holds most of the text is the article; links stay between text, and go in runs.
    menu = "<ul>" + "".join(f"<li><a href=x>Item {i}</a></li>" for i in range(8)) + "</ul>"
    plain = f"<body>{menu}<div>Some advert text here.</div><div><h1>Head</h1><p>{LONG}</p><p><a href=y>A lone link</a></p><p>{LONG}</p><p>Tiny.</p></div><div>Foot</div></body>"
    assert html.main_text(plain).split("\n\n") == ["Head", LONG.strip(), "A lone link", LONG.strip(), "Tiny."]


def test_html_without_marks_is_the_same_text(small):
    """The tables' pages with article elements as plain blocks and without class, id and role give the text that they give with them."""
    import re

    import pandas as pd

    pages = [h for h in pd.read_parquet(f"{small}/pages.parquet").html if h]
    same = 0
    for h in pages:
        bare = re.sub(r'\s(class|id|role)="[^"]*"', "", h.replace("<article", "<div").replace("</article", "</div"))
        same += html.main_text(bare) == html.main_text(h)
    assert same >= 0.9 * len(pages)  # the rest are articles no longer than the advert beside them


def test_warc_text_after_a_bare_bracket_and_unclosed_elements(spark):
    rows = [
        (1, "u", "<p>if a < b then</p><p>second <3 block</p><p>third</p>"), (2, "u", "<p>seen</p><script>var x = 1; if (a) { b }"), (3, "u\r\nX-Bad: 1", "<p>a<!-- open <p>b"), (4, "u", "last <b"),
        (None, "5", ""), (5, None, ""), (None, None, None),
    ]
    made = warc.derivatives(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    text = {r.refers_to: r.block for r in made if r.warc_type == "conversion"}
    assert sorted(text.values()) == sorted(["if a < b then\nsecond <3 block\nthird", "seen", "a", "last", "", "", ""]) and len(text) == 7
    assert all("\nX-Bad" not in r.headers and r.headers.count("\r\n") == r.headers.count("\n") for r in made)


def test_mix_keeps_the_planned_words_of_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e f", "s", 0, 7), (1, "g h", "s", 0, 7), (None, "i j k", "s", 0, 7), (None, "l", "s", 0, 7), (2, "m n o p", "t", 0, 7), (3, None, "t", 0, 7), (4, "", None, 0, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _taken int, size int")
    planned = mixing.plan_mix(docs).agg(F.sum("taken")).first()[0]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sum(len(r.text.split()) for r in mixed.collect()) == planned > 0
    assert mixing.mix(docs.limit(0)).collect() == []
