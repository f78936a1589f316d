"""The three-way merge against a plain one, line by line, and against SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ratersight.llm import branch_merge, queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def merged(rows, kinds=7):
    """(doc_id, lang, source, text, counts) of rows (doc_id, lang, source, text), without bitmaps."""
    out = []
    for i, lang, source, text in rows:
        base, own = [lang or "", source or ""], (text or "").split("\n")
        code = lambda b, name: zlib.crc32(f"{b}:{'' if i is None else i}:{name}".encode()) % kinds
        mark = {1: "!", 2: "?"}
        state = {}
        for b in "LR":
            c = [code(b, k) for k in range(len(own))]
            columns = ["" if (k := code(b, name)) == 0 else v + mark.get(k, "") for name, v in zip(("lang", "source"), base)]
            state[b] = (columns, [x if x <= 2 else None for x in c], [x if x in (3, 4) else None for x in c])
        changed = {b: s[0] != base or any(x is not None for x in s[1] + s[2]) for b, s in state.items()}
        gone = {b: code(b, "row") == 0 for b in "LR"}

        def applied(columns, lines, gaps):
            kept = []
            for x, c, g in zip(own, lines, gaps):
                kept += [] if c == 0 else [x + mark.get(c, "")]
                kept += [] if g is None else ["!?"[g - 3]]
            return (*columns, "\n".join(kept))

        n = dict.fromkeys(branch_merge.COUNTS, 0)
        if any(gone.values()):
            stays = gone["L"] and not gone["R"] and changed["R"]
            other = gone["R"] and not gone["L"] and changed["L"]
            n["n_edit_delete" if stays or other else "n_clean"] = 1
            row = applied(*state["R"]) if stays else (None, None, None)
        else:
            def one(base, x, y, conflict):
                """One place: its state, counted."""
                if x != base or y != base:
                    n["n_clean" if x == y or base in (x, y) else conflict] += 1
                return y if y != base else x

            (lc, ll, lg), (rc, rl, rg) = state["L"], state["R"]
            row = applied([one(b, x, y, "n_edit_edit") for b, x, y in zip(base, lc, rc)], [one(None, x, y, "n_edit_delete" if 0 in (x, y) else "n_edit_edit") for x, y in zip(ll, rl)], [one(None, x, y, "n_insert_insert") for x, y in zip(lg, rg)])
        out.append((i, *row, *n.values()))
        adds = [{3: "!", 4: "?"}.get(code(b, "row")) for b in "LR"]
        if any(adds):
            clash = all(adds) and adds[0] != adds[1]
            out.append((None if i is None else -1 - i, *base, adds[1] or adds[0], int(not clash), 0, 0, int(clash)))
    return sorted(out, key=str)


def rows_of(rng, n):
    words = ["", "a", "é𝄞", "x!", "?", "long line " * 5]
    return [(i, rng.choice([None, "", "en", "de!"]), rng.choice([None, "web"]), None if i % 11 == 0 else "\n".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 63, 64, 65, 130, 200])))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 5) for r in rows], "doc_id long, lang string, source string, text string, n_clean int, left string, right string, `lines of it` int")


def test_merges_equal_brute_force(spark):
    rows = rows_of(random.Random(3), 300)
    rows += [rows[5], rows[5], (-1 - 7, "en", "x", "a\nb"), (None, "en", None, "a\nb"), (None, None, None, None), (400, "", "", ""), (401, "a", "b", "x\n" * 70_000), (7, "other", "row", "same id")]
    got = branch_merge.merge_coded(frame(spark, rows))
    assert got.columns == ["doc_id", "lang", "source", "text", *branch_merge.COUNTS]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == merged(rows) and len(got) > len(rows)
    assert all(sum(r[4 + k] for r in got) > 0 for k in range(4)) and any(r[3] is None for r in got) and any(r[3] == "" for r in got)
    assert branch_merge.merge_coded(frame(spark, [])).collect() == []


def test_rows_that_a_branch_drops(spark):
    """Of each kind of row drop there are some, in conflict and clean, and of rows that both branches add."""
    rows = [(i, "", "", "") for i in range(3000)]  # one line, so that some branches change nothing
    got = sorted(map(tuple, branch_merge.merge_coded(frame(spark, rows)).collect()), key=str)
    assert got == merged(rows)
    code = lambda b, i: zlib.crc32(f"{b}:{i}:row".encode()) % 7
    kinds = {(code("L", r[0]) == 0, code("R", r[0]) == 0, r[3] is None, r[6]) for r in got if r[0] >= 0}
    assert {(True, False, False, 1), (True, False, True, 0), (False, True, True, 1), (False, True, True, 0), (True, True, True, 0)} <= kinds
    assert {(r[4], r[7]) for r in got if r[0] < 0} == {(1, 0), (0, 1)}


def test_bitmaps(spark):
    codes = [random.Random(1).randrange(5) for _ in range(200)]
    words = spark.createDataFrame([(codes,)], "c array<int>").select(branch_merge.bitmap(F.col("c"), 3).alias("w")).first().w
    assert len(words) == 4 and [words[i // 64] >> (i % 64) & 1 for i in range(200)] == [int(c == 3) for c in codes]


def test_branches_of_other_making(spark):
    """merge() takes any branches: here bitmaps that are shorter than the text, and no rule."""
    c = branch_merge.Changes(columns=("lang",), edits=("*",), inserts=("+",))
    branch = "struct<dropped boolean, added string, lang string, drop array<bigint>, edit0 array<bigint>, insert0 array<bigint>>"
    rows = [(1, "en", "a\nb\nc", (False, None, "en", [1], [0], []), (False, "new", "fr", [], [3], [4])), (2, "en", "a", (True, None, "en", [], [], []), (False, None, "en", [], [], []))]
    docs = spark.createDataFrame(rows, f"doc_id long, lang string, text string, l {branch}, r {branch}")
    got = sorted(map(tuple, branch_merge.merge(docs, "l", "r", c).collect()), key=str)
    assert got == [(-2, "en", "new", 1, 0, 0, 0), (1, "fr", "a*\nb*\nc\n+", 3, 0, 1, 0), (2, None, None, 1, 0, 0, 0)]


def test_no_row_leaves_its_task(spark):
    plan = branch_merge.merge_coded(frame(spark, [(1, "", "", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql_and_brute_force(spark):
    own = queries.op13_branch_merge(spark, SF)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = sorted(map(tuple, own.collect()), key=str)
    assert got == sorted(con.execute(queries.ORACLE_SQL["op13_branch_merge"]).fetchall(), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "source", "text").collect()]
    digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(*r[:3], digest(r[3]), *r[4:]) for r in merged(rows)], key=str)
