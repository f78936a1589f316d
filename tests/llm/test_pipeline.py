"""The pipeline's stages against brute force, on what each one's predecessor kept; and on odd tables."""

import itertools
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest

from ratersight.llm import decontamination, line_dedup, quality, scratch
from test_dedup import by_rule, classes, shingle_set
from test_operators import semi_global

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")


def lines_left(rows):
    """The line stage by pairs: {doc_id: text}."""
    own = [(r.doc_id, n, x.strip()) for r in rows for n, x in enumerate((r.text or "").split("\n"))]
    s = line_dedup.Settings()
    # the rule needs a full table for each pair; lines that share no half of their words or characters are far
    items = {x for *_, x in own if len(x) >= s.min_chars - s.edits}
    parts = {x: {w for w in x.split()} for x in items}
    near = lambda x, y: abs(len(x) - len(y)) < 60 and 2 * len(parts[x] & parts[y]) >= min(len(parts[x]), len(parts[y])) and by_rule(x, y)
    of = classes(items, near)
    joined = {c for c in of.values() if sum(v == c for v in of.values()) > 1}
    first, out = {}, {}
    for doc, n, x in sorted(own):
        c = of.get(x, x)
        if (len(x) >= s.min_chars or line_dedup.is_sentence(x) or c in joined) and first.setdefault(c, (doc, n)) != (doc, n):
            out.setdefault(doc, set()).add(n)
    kept = {}
    for r in rows:
        gone = out.get(r.doc_id, ())
        text = r.text if not gone else "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in gone)
        if not gone or text.strip():
            kept[r.doc_id] = text
    return kept


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near", "benchmark", "packing"]

    def step(name):
        nonlocal docs
        before = docs.collect()
        docs = scratch.table(stages[name](spark, docs, SF), name)
        after = docs.collect()
        assert docs.columns == columns and len(after) == len({r.doc_id for r in after})
        return before, {r.doc_id: r for r in after}

    before, after = step("quality")
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet").limit(60), spark.read.parquet(f"{SF}/labels.parquet"))
    plain = {}
    for r in before:  # the additive score, term by term
        x = quality.features([r.text])[0]
        b = [int((e <= v).sum()) for e, v in zip(model.edges, x)]
        z = model.base + sum(t[i] for t, i in zip(model.tables, b)) + sum(t[b[f], b[g]] for f, g, t in model.pairs)
        plain[r.doc_id] = 1 / (1 + np.exp(-z))
    assert set(after) == {d for d, v in plain.items() if v >= quality.Settings().threshold} and 0 < len(after) < 60

    before, after = step("lines")
    assert {d: r.text for d, r in after.items()} == lines_left(before)
    assert all(r.n_chars == len(r.text) for r in after.values())

    before, after = step("near")
    sets = {r.doc_id: shingle_set(r.text, 5) for r in before}
    of = classes(sets, lambda x, y: bool(sets[x] and sets[y]) and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]))
    assert set(after) == {d for d, c in of.items() if d == c}

    before, after = step("benchmark")
    items = [decontamination.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = set()
    for r, item in itertools.product(before, items):
        words, own = set(item.split()), decontamination.normal(r.text)
        # a held item has most of its words there; only then the full table
        if r.doc_id not in held and 2 * sum(w in own for w in words) >= len(words) and semi_global(item, own) <= len(item) // 20:
            held.add(r.doc_id)
    assert set(after) == {r.doc_id for r in before} - held

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    packed = stages["packing"](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == set(after)
    for r in packed.itertuples():
        ids = np.array([*library.encode(after[r.doc_id].text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32


def test_lines_and_names_and_empty_tables(spark):
    rng = random.Random(2)
    lines = [" ".join(f"w{rng.randrange(999)}" for _ in range(12)) for _ in range(9)]
    schema = "doc_id long, text string, n_lines int, was string, own int, n_chars long"
    rows = [(1, "\n".join(lines)), (2, "\n".join(["Contents", *lines])), (3, "\n".join([lines[0], "what is new here, and long enough to stay"])), (4, None), (5, "\n".join(["", *lines[3:], " "])), (6, " "), (7, "\n".join(lines))]
    got = {r.doc_id: r for r in corpus_pipeline.line_stage(spark, spark.createDataFrame([(i, t, 7, "x", 3, 1) for i, t in rows], schema), SF).collect()}
    assert {i: r.text for i, r in got.items()} == {1: rows[0][1], 2: "Contents", 3: "what is new here, and long enough to stay", 4: None, 6: " "}
    assert all((r.n_lines, r.was, r.own) == (7, "x", 3) for r in got.values()) and [got[i].n_chars for i in (1, 2, 3)] == [1, 8, 41]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_odd_rows_go_through_all_stages(spark):
    """Null, empty, blank and very long texts, repeated rows, null and shared ids and further columns."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    plain = [" ".join(word() for _ in range(80)) + "." for _ in range(6)]
    texts = [None, "", " \n ", plain[0], plain[0], plain[1], " ".join(word() for _ in range(60_000)), "\n".join(plain[2:4]), "!!!"]
    rows = [(i if i % 4 else None, t, f"s{i}", 5, 0.5) for i, t in enumerate(texts)]
    rows += [rows[7], (7, plain[5], "s", 5, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score int, sequence_id double")
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.table(stage(spark, docs, SF), name)
        if name == "packing":
            assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
        else:
            assert out.columns == docs.columns and out.count() <= docs.count()
        if name not in ("quality", "packing"):  # quality may reject any of them
            docs = out
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert sum(t == plain[0] for _, t in kept) == 1 and (5, plain[1]) in kept and any(len(t or "") > 200_000 for _, t in kept)
    assert sum(t == texts[7] for _, t in kept) == 1 and (7, plain[5]) in kept
