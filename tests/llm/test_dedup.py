"""Near-duplicates and lines against brute force, on families whose members a hub alone doesn't join."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratersight.llm import line_dedup, linkage, near_dedup

DOCS = "doc_id long, text string, component_id string, node int, lines int"


def classes(items, linked):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(sorted(items), 2):
        if linked(x, y):
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else ({tuple(w)} if w else set())


def drifting(n, rng, size=80):
    """Documents of which each differs from the one before by a word: near ones are linked, far ones are not."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, words, percent, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 8)
    rng = random.Random(3)
    texts = [*drifting(60, rng), *drifting(25, rng, 30), None, "", "  \t\n", "a", "A", "a b", "one two three", "ONE two\nthree", "é è", "\x0bx\x0c"]
    texts += [texts[5]] * 4
    rows = [(i * 3, t, "z", i, i) for i, t in enumerate(texts)]
    rows += rows[:2]  # repeated rows
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), near_dedup.Settings(words=words, percent=percent)).collect()
    sets = {i: shingle_set(t, words) for i, t, *_ in rows}
    want = classes(sets, lambda x, y: bool(sets[x] and sets[y]) and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_null_ids_and_empty_tables(spark):
    text = "the same words again and again here"
    got = near_dedup.near_duplicates(spark.createDataFrame([(None, text, "", 0, 0), (7, text, "", 0, 0), (None, None, "", 0, 0)], DOCS)).collect()
    assert sorted((r.doc_id is None, r.component_id or -1, r.kept) for r in got) == [(False, 7, True), (True, -1, False), (True, 7, False)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_dedup_keeps_columns_and_one_of_each_group(spark):
    rows = [(1, "a b c d e f g", "x", 1, 1), (2, "a b c d e f g", "y", 2, 2), (3, "other words stand here now ok", "z", 3, 3), (None, "a b c d e f g", "n", 4, 4)]
    got = near_dedup.dedup(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "text", "component_id", "node", "lines"]
    assert sorted(r.component_id for r in got.collect()) == ["x", "z"]
    one, two = "a b c d e f g", "some quite other words are here for all"
    rows = [(5, one, "a", 1, 1), (5, one, "b", 1, 1), (5, two, "c", 1, 1), (6, one, "d", 1, 1), (6, None, "e", 1, 1), (6, "", "f", 1, 1), *[(None, "only null ids have these words", x, 1, 1) for x in "gh"]]
    got = sorted(r.component_id for r in near_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect())
    assert len(got) == 5 and got[0] in "ab" and got[1:4] == ["c", "e", "f"] and got[4] in "gh"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_and_keys_lose_nothing():
    rng = random.Random(1)
    for _ in range(4000):
        k = rng.randrange(5)
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(14)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", "a", "c"])
        b = "".join(b)
        near = distance(a, b) <= k
        assert line_dedup.within(a, b, k) == near
        if near and min(len(a), len(b)) > k:
            x, y = line_dedup.keys_of([a.encode("utf-32-le"), b.encode("utf-32-le")], k)
            assert set(x) & set(y)


def test_every_pair_goes_through_bit_vectors(monkeypatch):
    rng = random.Random(2)
    lines, seen = [], {"alone": 0, "together": 0}
    for i in range(40):
        base = "".join(rng.choice("abcdefgh ") for _ in range(60))
        for _ in range(30 if i == 0 else 3):
            x = list(base)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(x) + 1)
                x[k : k + rng.randrange(2)] = rng.choice(["", "a", "z"])
            lines.append("".join(x))
    alone, together = line_dedup.within, line_dedup.Sequences._together

    def one(a, b, k):
        seen["alone"] += 1
        return alone(a, b, k)

    def many(self, xs, ys, pairs, k):
        seen["together"] += len(pairs)
        return together(self, xs, ys, pairs, k)

    monkeypatch.setattr(line_dedup, "within", one)
    monkeypatch.setattr(line_dedup.Sequences, "_together", many)
    lines.sort(key=len)
    xs, ys = np.triu_indices(len(lines), 1)
    near = np.abs(np.array([len(lines[x]) - len(lines[y]) for x, y in zip(xs, ys)])) <= 2
    few = rng.sample(range(len(xs)), 60)
    pairs = np.array(sorted({i for i in range(len(xs)) if near[i] and xs[i] < 20} | {i for i in few if near[i]}))
    got = line_dedup.Sequences(lines).linked(xs[pairs], ys[pairs], 2)
    assert seen["alone"] and seen["together"] and seen["alone"] + seen["together"] == len(pairs)
    assert got.tolist() == [distance(lines[x], lines[y]) <= 2 for x, y in zip(xs[pairs], ys[pairs])]


def test_lines_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linkage, "MEMBERS", 8)
    rng = random.Random(5)
    base = "this is a line of some length, number {:04d} of the family"
    lines = [base.format(rng.randrange(10000)) for _ in range(60)] + ["short", "", "   ", "another line that stands alone in all documents é"]
    rows = [(i, None if i == 11 else "\n".join(rng.choice(lines) + rng.choice(["", " ", "x"]) for _ in range(rng.randrange(9))), "c", 1, 1) for i in range(30)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    own = [(i, n, x.strip()) for i, t, *_ in rows for n, x in enumerate((t or "").split("\n")) if len(x.strip()) >= 24]
    of = classes({x for *_, x in own}, lambda x, y: distance(x, y) <= 2)
    first = {}
    for i, n, x in sorted(own):
        first.setdefault(of[x], (i, n))
    gone = {(i, n) for i, n, x in own if first[of[x]] != (i, n)}
    assert gone and len(set(of.values())) < len(of)
    for i, t, *_ in rows:
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        assert (got[i].text, got[i].n_removed) == (kept, sum(j == i for j, _ in gone))
        assert got[i].component_id == "c" and got[i].n_lines == (0 if t is None else t.count("\n") + 1)


def test_line_links_are_all_counted(spark, monkeypatch):
    monkeypatch.setattr(linkage, "MEMBERS", 4)
    rng = random.Random(8)
    family = [f"a family of lines that are all near, number {c}" for c in "abcdefghijkl"] + ["a line apart from every other one of them"]
    rows = [(i, "\n".join(rng.choice(family) for _ in range(1 + i % 3)), "c", 1, 1) for i in range(20)]
    distinct = {x for _, t, *_ in rows for x in t.split("\n")}
    degree = {x: sum(x != y and distance(x, y) <= 2 for y in distinct) for x in distinct}
    assert sum(degree.values()) > 2 * len(distinct)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: got[i].n_links for i in got} == {i: sum(degree[x] for x in t.split("\n")) for i, t, *_ in rows}
    assert got[0].n_removed == 0 and got[0].n_links > 0 and got[0].class_doc_id == 0


def by_rule(a, b, s=line_dedup.Settings()):
    """The rule of Settings, by full tables."""
    x, y = a.encode().split(), b.encode().split()
    if max(len(x), len(y)) >= s.min_words:
        return distance(x, y) <= s.edits
    return max(len(a), len(b)) >= s.min_chars and distance(a, b) <= s.edits


def test_pairs_by_words_and_by_characters_share_keys():
    rng = random.Random(4)
    s = line_dedup.Settings()
    seen = [0, 0]
    for n in [*range(15, 26), 40, 90] * 8:
        a = [f"w{rng.randrange(50)}" for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(b))
            b[i : i + rng.randrange(2)] = rng.choice([[], ["x"], ["yy"], [b[i] + "z"]])
        own = [" ".join(a), " ".join(b)]
        order, odd = line_dedup.sketches(own, s)
        own = [own[i] for i in np.argsort(order, kind="stable")]
        odd = odd[np.argsort(order, kind="stable")]
        near = by_rule(*own)
        seen[near] += 1
        if near:
            at, keys = line_dedup.all_keys(own, s)
            assert set(keys[at == 0]) & set(keys[at == 1])
        compared = line_dedup.Comparer(own, odd, s)
        tried = list(compared.near(0))
        assert near <= (tried == [1]) and (tried == [1] and bool(compared.linked(np.array([0]), np.array([1]))[0])) == near
    assert min(seen) > 10


def test_a_replaced_word_leaves_a_paragraph_linked(spark):
    words = [f"word{i}" for i in range(60)]
    other = [*words[:30], "wabcde", *words[31:]]
    rows = [(1, " ".join(words), "c", 1, 1), (2, " ".join(other), "c", 1, 1), (3, " ".join(f"other{i}" for i in range(60)), "c", 1, 1)]
    got = {r.doc_id: (r.n_removed, r.n_links, r.class_doc_id) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (0, 1, 1), 2: (1, 1, 1), 3: (0, 0, 3)}


def test_short_sentences_go_and_short_headings_stay(spark):
    near = "abcdefghijklmnopqrstuvwx"
    lines = ["All rights reserved.", "Contents", near, near[:22], "tiny one.", "a heading of 22 letters"[:22]]
    rows = [(1, "\n".join([*lines[:3], lines[5]]), "c", 1, 1), (2, "\n".join([*lines[:2], lines[3], "tiny two.", *lines[4:]]), "c", 1, 1)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].n_removed == 0 and got[1].n_links == 1
    assert got[2].text == "\n".join(["Contents", "tiny two.", "tiny one.", lines[5]])


def edited(text, n, rng):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out) + 1)
        out[i : i + rng.randrange(2)] = rng.choice(["", "a", "c", "xy"])
    return "".join(out)


@pytest.mark.parametrize(("size", "k"), [(30, 2), (160, 5), (530, 14), (1900, 33)])
def test_many_pairs_at_a_time_equal_one_at_a_time(size, k, monkeypatch):
    monkeypatch.setattr(line_dedup.Sequences, "PAIRS", 500)
    rng = random.Random(size)
    base = "".join(rng.choice("abcdé fgh") for _ in range(size))
    lines = [edited(base, rng.randrange(k + 2), rng) for _ in range(50)]
    xs, ys = np.triu_indices(50, 1)
    want = [line_dedup.within(lines[x], lines[y], k) for x, y in zip(xs, ys)]
    assert line_dedup.Sequences(lines).linked(xs, ys, k).tolist() == want and 0 < sum(want) < len(want)


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    again, new = "a line that was seen before, in full", "a line that is found nowhere else at all"
    rows = [(1, again, "c", 1, 1), (5, f"first\n{again}", "c", 1, 1), (5, f"{again}\n{new}", "c", 2, 2), (None, f"x\n{again}", "c", 1, 1), (None, f"y\n{again}", "d", 1, 1)]
    rows += [rows[2]] * 2
    got = sorted((r.doc_id or 0, r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert [t for d, t, _ in got if d == 1] == [""]
    assert sorted(t for d, t, _ in got if d == 5) == ["", "", new, "first"]
    assert sorted(n for d, _, n in got if d == 0) == [0, 1] and {t[0] for d, t, _ in got if d == 0} == {"x", "y"}


def test_names_of_columns_cannot_clash(spark):
    schema = "doc_id long, text string, _doc int, _lines int, own int, row int, copies int, again int, n_lines string, gone_doc int"
    rows = [(1, "one line that is long enough to count", 1, 2, 3, 4, 5, 6, "x", 7), (2, "one line that is long enough to count\nb", 1, 2, 3, 4, 5, 6, "x", 7)]
    got = sorted(line_dedup.dedup_lines(spark.createDataFrame(rows, schema)).collect())
    assert [(r.text, r._doc, r._lines, r.own, r.row, r.copies, r.again, r.gone_doc, r.n_lines, r.n_removed) for r in got] == [(rows[0][1], 1, 2, 3, 4, 5, 6, 7, 1, 0), ("b", 1, 2, 3, 4, 5, 6, 7, 2, 1)]


def test_whole_runs():
    import pyarrow as pa

    rng = random.Random(1)
    for _ in range(200):
        keys = sorted(rng.randrange(5) for _ in range(rng.randrange(30)))
        batches, at = [], 0
        while at < len(keys):
            n = rng.randrange(1, 6)
            batches.append(pa.RecordBatch.from_pydict({"k": keys[at : at + n]}))
            at += n
        got = [t.column("k").to_pylist()[a:b] for t, cuts in linkage.whole_runs(batches, ["k"]) for a, b in zip(cuts, cuts[1:])]
        assert got == [list(g) for _, g in itertools.groupby(keys)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 400)], "a long, b long")
    got = {r.node: r.component for r in linkage.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}
    assert linkage.components(edges.filter(F.lit(False))).collect() == []
