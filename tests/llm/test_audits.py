"""Source divergence, whitening and license scan against brute force, with the odd cases of each."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import divergence, licenses, whitening

DOCS = "doc_id long, text string, lang string, source string, term int, p string, no int, h long, key string, spans int"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "k", 4) for r in rows], DOCS)


def _audit(rows, top):
    """The audit in plain Python over dense rows of counts."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        df[lang].update(set(words))
        count[lang, source].update(words)
        groups.add((lang, source))
    kept = {lang: sorted(t for t, n in c.items() if n >= 3) for lang, c in df.items()}
    f = lambda p, q: (p - q) * (p - q) // q

    def ps(counts, lang):
        n = sum(counts[t] for t in kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept[lang])) for t in kept[lang]}

    p = {g: ps(count[g], g[0]) for g in groups}
    q = {lang: ps(sum((count[g] for g in groups if g[0] == lang), Counter()), lang) for lang in kept}
    out = set()
    for lang, source in groups:
        own = p[lang, source]
        pairs = [(-sum(f(own[t], p[lang, o][t]) for t in own), o.encode()) for la, o in groups if la == lang and o != source]
        terms = [(-f(own[t], q[lang][t]), t.encode()) for t in own if count[lang, source][t] and own[t] > q[lang][t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_by_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    terms = ["a", "É", "é", "straße", "the", "fish", "k'2", "日本", "x_y", "B", "b", "ω"] + [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(terms, weights=range(len(terms), 0, -1), k=rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "S4", "ü", None])) for i in range(150)]
    rows += [(200, None, "en", "null text"), (201, "", "en", "empty"), (202, "once only words", "fr", "alone"), (203, "a " * 30_000 + "é " * 10_000, "en", "long")]
    rows += [(204, "one two", "it", "s1"), (205, "three four", "it", "s2")] + [rows[0]] * 3
    got = divergence.divergence(_docs(spark, rows), top_terms=7).collect()
    assert {tuple(r) for r in got} == _audit(rows, 7) and len(got) == len({tuple(r) for r in got})


def test_divergence_in_small_pieces(spark, monkeypatch):
    """Runs of paths, of combinations and of held terms that are cut anywhere give the same sums."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefghijklmnop", k=12)), "en", f"s{rng.randrange(9)}") for i in range(60)]
    paths = [sorted((no, rng.randint(1, 3) * 10, 7) for no in rng.sample(range(1, 8), rng.randint(1, 5))) for _ in range(80)]
    many = Counter(map(tuple, paths))
    import pyarrow as pa

    kind = pa.list_(pa.struct([("no", pa.int32()), ("p", pa.int64()), ("p0", pa.int64())]))
    ordered = sorted(many)

    def sums(step, combinations):
        monkeypatch.setattr(divergence, "COMBINATIONS", combinations)
        total = Counter()
        for at in range(0, len(ordered), step):
            some = ordered[at : at + step]
            batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(some)), pa.array([many[s] for s in some], pa.int64()), pa.array([[dict(zip(("no", "p", "p0"), e)) for e in s] for s in some], kind)], ["lang", "m", "path"])
            for out in divergence._tree_corrections([batch]):
                for r in out.to_pylist():
                    total[r["a"], r["b"], 0] += r["ab"]
                    total[r["a"], r["b"], 1] += r["ba"]
        return total

    f = lambda p, q: (p - q) * (p - q) // q
    want = Counter()
    for path, m in many.items():
        for i, (b, pb, qb) in enumerate(path):
            for a, pa_, qa in path[:i]:
                want[a, b, 0] += m * (f(pa_, pb) - f(pa_, qb) - f(qa, pb) + f(qa, qb))
                want[a, b, 1] += m * (f(pb, pa_) - f(pb, qa) - f(qb, pa_) + f(qb, qa))
    assert sums(1000, 1 << 20) == sums(7, 5) == sums(1, 1) == want
    monkeypatch.setattr(divergence, "HELD", 3)
    assert {tuple(r) for r in divergence.divergence(_docs(spark, rows)).collect()} == _audit(rows, 200)


def test_divergence_of_no_documents(spark):
    assert divergence.divergence(_docs(spark, [])).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, key binary, many long, n int, dims int, whitened string"


def _vectors(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(*r, 1, b"k", 2, 3, 4, "w") for r in rows], schema)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_by_brute_force(spark, weights):
    rng = np.random.default_rng(4)
    base = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) + 3).astype(np.float32)
    all_rows = np.concatenate([base, base[:40], np.repeat(base[:1], 200, 0), base[5:6] * 3000])
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(all_rows)]
    bad = [(900, None), (901, [float("nan")] * 12), (902, [1.0, None] + [0.0] * 10), (903, [float("inf")] + [0.0] * 11), (904, [])]
    out = whitening.whiten(_vectors(spark, rows + bad), components=8, weights=weights).toPandas().set_index("vec_id").sort_index()
    assert list(out.index) == list(range(len(rows)))
    x = np.floor(64 * all_rows.astype(np.float64)).astype(np.int64) + 1_000_000
    fit = x if weights == "counts" else np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    z = (x - s / n) @ v[:, ::-1][:, :8] / np.sqrt(e[::-1][:8])
    got = np.array(out.whitened.tolist())
    sign = np.sign((got * z).sum(axis=0))
    assert np.allclose(got, z * sign, rtol=1e-6, atol=1e-6)
    assert (out.n == n).all() and [int(d) for d in out.deviation] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    assert np.allclose(out.explained.iloc[0], e[::-1][:8] / e.sum()) and out.identity_error.max() < 1e-8


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(_vectors(spark, [])).collect() == []
    # All equal: no direction has variance. A vector of another length has a fit of its own. Repeated and null ids are rows.
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (4, [1.0, 2.0, 3.0]), (5, [2.0, 2.0, 3.0])]
    out = whitening.whiten(_vectors(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.n, r.deviation) for r in out) == [(0, 3, 0), (1, 3, 0), (1, 3, 0), (4, 2, 64**2), (5, 2, 64**2)]
    assert all(r.whitened == [None, None] and r.explained == [0.0, 0.0] for r in out if r.n == 3)
    three = {r.vec_id: r.whitened for r in out if r.n == 2}
    assert three[4][1:] == [None, None] and abs(abs(three[4][0]) - 1) < 1e-9 and three[4][0] == -three[5][0]
    # Entries of any size stay exact, and other element types are taken as doubles.
    big = [(1, [1e18, 0.0]), (2, [-3e15, 1.0]), (3, [0.5, 70000.0])]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(_vectors(spark, big, VECTORS.replace("float", "double"))).collect()}
    x = {i: [int(np.floor(64 * min(2.0**56, max(-(2.0**56), c)))) for c in v] for i, v in big}
    s = [sum(v[d] for v in x.values()) for d in range(2)]
    assert got == {i: sum((3 * v[d] - s[d]) ** 2 for d in range(2)) for i, v in x.items()}


def _scan(text):
    """Base places and labels of whole phrases, in plain Python."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, base = [], set()
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base))


def test_license_base_places_by_brute_force(spark):
    rng = random.Random(9)
    bits = ["Released under the MIT License.", "CC BY-NC 4.0", "under the\nMIT ", "license", "Apache License, Version 2.0", "apache license", "version 2", "cc", "by", "nc", "é", "word", "Ünder the mit license", "the"]
    texts = [" ".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(120)] + [None, "", "cc by nc " * 3, "cc by nc", "by nc", "x " * 140_000 + "under the MIT license " + "y " * 10]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s"), (0, "cc by nc", "en", "s"), (None, "cc by nc", "en", "s"), (None, "", "en", "s")]
    got = licenses.scan(_docs(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_base, repr(r.first_word), repr(r.last_word), r.base_labels) for r in got) == sorted(
        (i is None, i or 0, *(repr(x) if k in (2, 3) else x for k, x in enumerate(_scan(t)))) for i, t, _, _ in rows
    )
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and (r.score == 1.0) == bool(r.labels) for r in got)
    assert licenses.scan(_docs(spark, [])).collect() == []


def test_license_texts_with_changes(spark):
    """Words inserted, left out and replaced move the diagonal by little; half a text is no license; templates find themselves alone."""
    rows = [(i, text, "en", "s") for i, (_, text) in enumerate(licenses.TEXTS)]
    mit = licenses.TEXTS[0][1].split()
    changed = mit[:30] + ["and", "also"] + mit[30:80] + mit[82:120] + ["indeed"] + mit[121:]
    rows += [(10, "before " * 50 + " ".join(changed) + " after" * 50, "en", "s"), (11, " ".join(mit[: len(mit) // 2]), "en", "s"), (12, " ".join(reversed(mit)), "en", "s"), (13, "plain prose about the software and its use", "en", "s")]
    got = {r.doc_id: r for r in licenses.scan(_docs(spark, rows)).collect()}
    for i, (label, _) in enumerate(licenses.TEXTS):
        assert label in got[i].labels.split(",") and got[i].score == 1.0 and got[i].n_base == 0
    assert got[10].labels == "mit" and licenses.ACCEPT <= got[10].score < 1
    assert got[11].labels == "" and licenses.LEAST <= got[11].score < licenses.ACCEPT
    assert got[12].labels == got[13].labels == "" and got[12].score == got[13].score == 0
    marked = licenses.label_documents(_docs(spark, rows))
    assert marked.count() == len(rows) and {r.doc_id: r.licenses for r in marked.collect()}[10] == ["mit"]


def test_license_candidates_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(licenses, "PIECE", 4)
    rows = [(1, "a b c under the mit license and cc by nc d e", "en", "s"), (2, "none", "en", "s")]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(_docs(spark, rows)).collect()}
    assert got == {1: (13, 2, 3, 8, "cc-by-nc,mit", "cc-by-nc,mit", 1.0), 2: (1, 0, None, None, "", "", 0.0)}
