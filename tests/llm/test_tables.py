"""Conversations, vectors, components, and the registered queries on the small tables."""

import hashlib
import random

import numpy as np

from corpusloom.llm import chat, components, embeddings, queries

EVENTS = "conv_id long, seq int, msg int, kind string, role string, text string"


def test_events_fold_into_final_messages(spark):
    rows = [
        (1, 1, 1, "message", "user", "hi"),
        (1, 2, 2, "message", "assistant", "he"), (1, 3, 2, "delta", "assistant", "llo"),
        (1, 4, 3, "message", "user", "more"),
        (1, 5, 2, "regenerate", "assistant", "new"), (1, 6, 2, "delta", "assistant", "er"),
        (1, 7, 3, None, "user", "again"), (1, 8, 1, "edit", "user", "Hi!"),
        (2, 1, 1, "delta", "assistant", None), (2, 2, 1, "delta", "assistant", "x"),
    ]
    out = chat.fold_events(spark.createDataFrame(rows, EVENTS)).collect()
    assert sorted(map(tuple, out)) == [(1, 1, "user", "Hi!"), (1, 2, "assistant", "newer"), (1, 3, "user", "again"), (2, 1, "assistant", "x")]


def test_template_is_reversible(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "odd: role", None]), "".join(rng.choice("\\<#:/turn>\n blhc### é") for _ in range(rng.randint(0, 40)))) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(50, 1, "assistant", None), (50, 1, "assistant", "tie"), (None, 1, "user", "no id"), (51, None, "user", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df)
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(back) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in back[c].turns] == turns
        assert back[c].loss_text == "".join(t for r, t in turns if r == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(900 + i, 901 + i) for i in range(60)] + [(5, 5), (None, 3)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    out = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in out} == {x: root(x) for x in up}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_recall_and_precision(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:30] + 0.12 * rng.standard_normal((30, 16)), base[:3], rng.standard_normal((400, 16))]).astype(np.float32)
    label = rng.integers(0, 3, len(x))
    label[60:93] = label[[*range(30), 0, 1, 2]]
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(len(x))]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, rows[0][1], None), (1004, [1.0, None], 1), (1005, [], 0)]
    out = embeddings.near_duplicate_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), leaf_rows=64).toPandas().set_index("vec_id")
    assert len(out) == len(rows) + len(odd)
    u = embeddings.unit(x)
    links = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(links, False)
    want = links.sum(1)
    got = out.n_links.loc[range(len(x))].to_numpy()
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum() > 0
    assert (out.loc[1000:, "n_links"] == 0).all() and (out.loc[1000:, "component_id"] == out.loc[1000:].index).all()
    assert (out.kept == (out.component_id == out.index)).all()


def test_embeddings_recall_at_the_registered_parameters(spark, tmp_path):
    """1,500 planted pairs just above the threshold among 21,500 vectors: at least nine in ten found, none linked falsely, and exact components."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(7)
    x = embeddings.unit(rng.standard_normal((20_000, 64)))
    y = rng.standard_normal((1500, 64))
    y -= (y * x[:1500]).sum(1, keepdims=True) * x[:1500]
    x = np.concatenate([x, 0.934 * x[:1500] + np.sqrt(1 - 0.934**2) * embeddings.unit(y)]).astype(np.float32)
    label = np.arange(len(x)) % 3
    label[20_000:] = label[:1500]
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "label": label.astype(np.int32), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), str(tmp_path / "v.parquet"))
    out = embeddings.near_duplicate_vectors(spark.read.parquet(str(tmp_path))).toPandas().set_index("vec_id").sort_index()
    assert (out.n_links[20_000:] > 0).mean() >= 0.9 and (out.n_links[1500:20_000] == 0).all()
    found = out.index[out.n_links > 0]
    assert all(out.component_id[i] == (i if i < 20_000 else i - 20_000) for i in found)


def test_embeddings_of_no_rows_repeated_ids_and_clashing_columns(spark):
    schema = "vec_id long, embedding array<double>, label string, rep string, leaf int, many int, v string"
    assert embeddings.near_duplicate_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [2.0, 0.001], "a"), (2, [0.0, 1.0], "a"), (3, [1.0, 0.0], "b"), (None, [1.0, 0.0], "a"), (4, [1.0, 0.0, 0.0], "a")]
    out = embeddings.near_duplicate_vectors(spark.createDataFrame([(*r, "x", 1, 1, "y") for r in rows], schema)).collect()
    assert len(out) == len(rows)
    by = {r.vec_id: r for r in out}
    assert by[1].component_id == by[2].component_id == 1 and by[3].n_links == by[4].n_links == 0 and by[1].n_links >= 2 and by[None].component_id is None


def test_queries_and_pipeline_run(spark, small):
    import corpus_pipeline
    import __spark_entry__ as entry

    found = entry.queries()
    for name in queries.QUERIES:
        assert name in found
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    assert found["op4_mixing"](spark, small).count() == docs
    out = found["pipeline"](spark, small)
    rows = out.collect()
    assert len(corpus_pipeline.STAGES) == 5 and 0 < len(rows) and out.columns[0] == "doc_id"


def test_pipeline_stages_by_brute_force(spark, small):
    """Each later stage on all rows of the one before: near copies, repeats and mixing recomputed in plain Python."""
    import corpus_pipeline as p
    from corpusloom.llm.common import materialize, table

    docs = table(spark, small, "documents")
    good = materialize(p.quality_stage(spark, docs, small))
    assert good.columns == p.COLUMNS and good.count() <= docs.count()
    one = materialize(p.near_copies_stage(spark, good, small))
    kept = {r.doc_id: r.text for r in one.collect()}
    sets = {i: frozenset(zip(*[t.lower().split()[q:] for q in range(5)])) for i, t in kept.items()}
    ids = sorted(i for i in sets if sets[i])
    assert not [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    cut = materialize(p.repeats_stage(spark, one, small))
    first, want = {}, {}
    for i in sorted(kept):
        w = kept[i].encode().split()
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, t in kept.items():
        w = t.encode().split()
        gone = bytearray(len(w))
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = b"\1" * 13
        left = [x for x, g in zip(w, gone) if not g]
        if left or not any(gone):
            want[i] = b" ".join(left).decode() if any(gone) else t
    assert {r.doc_id: r.text for r in cut.collect()} == want
    mixed = p.mix_stage(spark, cut, small)
    total = sum(len(t.encode().split()) for t in want.values())
    assert abs(sum(len(r.text.encode().split()) for r in mixed.collect()) - 1.5 * total) < 30
    assert hashlib.sha256(b"").hexdigest()


def test_chat_of_no_rows_and_clashing_columns(spark):
    schema = "conv_id long, turn long, role string, text string, seq int, msg string, formatted string"
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], schema))).collect() == []
    rows = [(1, 0, "user", "hi", 9, "m", "f"), (1, 1, "assistant", None, 8, "m", "f"), (1, 1, "assistant", None, 8, "m", "f"), (2, None, None, "x" * 100_000, None, None, None)]
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, schema))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "hi"), ("assistant", ""), ("assistant", "")]
    assert [tuple(t) for t in back[2].turns] == [("", "x" * 100_000)] and back[2].loss_text == ""


def test_pipeline_of_empty_and_odd_documents(spark, tmp_path):
    """No documents give no tokens; nulls, repeated rows and columns with the operators' own names pass through all stages."""
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, k string, spans int, score double, h long"
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 1), (3, None)], "doc_id long, quality int")
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i : i + 30]), "en", "s", 100, "k", 1, 0.1, 2) for i in range(8)]
    rows += [rows[0], (50, None, None, None, None, None, None, None, None), (51, "", "en", None, 0, None, None, None, None), (None, "no id at all", "en", "s", 12, None, None, None, None)]
    for name, some in (("none", []), ("odd", rows)):
        where = tmp_path / name
        spark.createDataFrame(some, schema).write.parquet(f"{where}/documents.parquet")
        (labels if some else labels.limit(0)).write.parquet(f"{where}/labels.parquet")
        out = p.run(spark, str(where))
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert some or out.collect() == []
        out.collect()
    docs = spark.createDataFrame(rows, schema)
    for _, stage in p.STAGES[1:-1]:  # the classifier may well drop all of so few rows
        kept = stage(spark, docs, "")
        assert kept.columns == p.COLUMNS and 0 < kept.count()


def test_long_conversations_are_linear_and_ties_have_an_order(spark):
    n = 6000
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}: <#\\>") for i in range(n)] + [(2, 7, "assistant", "b"), (2, 7, "assistant", "a"), (2, 7, None, "c")]
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [t.text for t in back[1].turns] == [r[3] for r in rows[:n]] and back[1].loss_text == "".join(r[3] for r in rows[:n] if r[2] == "assistant")
    assert [tuple(t) for t in back[2].turns] == [("", "c"), ("assistant", "a"), ("assistant", "b")] and back[2].loss_text == "ab"
    events = [(3, i, i, "message", "user", str(i)) for i in range(n)] + [(3, n, n - 5, "regenerate", "user", "x")]
    folded = chat.fold_events(spark.createDataFrame(events, EVENTS)).collect()
    assert len(folded) == n - 4 and {r.msg: r.text for r in folded}[n - 5] == "x"
