"""Three-way merge of two branches of documents: bitmaps of each branch's lines, merged word by word.

A branch is a struct column beside the documents: dropped (the row goes), added (the text of a row that it adds, or null), the
new value of each column, and bitmaps of 64 lines a word (arrays of longs): drop, one for each text that edits append and one
for each line that may be inserted after a line. AND, XOR and counts of bits give the clean changes and the conflicts; the
merged bitmaps are applied to the lines. No row leaves its task: the merge has no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Changes:
    """columns: those that are merged by value. edits: texts that an edit may append. inserts: lines that may follow a line,
    and texts of added rows."""

    columns: tuple[str, ...] = ("lang", "source")
    edits: tuple[str, ...] = ("!", "?")
    inserts: tuple[str, ...] = ("!", "?")

    @property
    def maps(self) -> list[str]:
        return ["drop", *(f"edit{i}" for i in range(len(self.edits))), *(f"insert{i}" for i in range(len(self.inserts)))]


COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def lines(text: Column) -> Column:
    """The \\n-split lines; an empty text has one, an empty one."""
    return F.split(text, "\n", -1)


def bitmap(codes: Column, code: int) -> Column:
    """Which of an array's entries are equal to a code: bit i % 64 of word i / 64."""
    words = F.sequence(F.lit(0), F.floor((F.size(codes) - 1) / 64).cast("int"))
    add = lambda acc, c: F.shiftleft(acc, 1).bitwiseOR((c == code).cast("long"))
    return F.transform(words, lambda w: F.aggregate(F.reverse(F.slice(codes, w * 64 + 1, F.lit(64))), F.lit(0).cast("long"), add))


def coded(docs: DataFrame, branch: str, to: str, changes: Changes = Changes(), kinds: int = 7) -> DataFrame:
    """docs (doc_id, text, changes.columns; no nulls but in doc_id) with a branch `to` that a rule makes: code
    crc32(`branch:doc_id:name`) % kinds for the names row, each column and each line's number. Code 0 drops (a column: empties
    it), the next codes append the edits in their order, those after them insert; a null doc_id counts as empty."""
    start = F.concat(F.lit(f"{branch}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    code = lambda name: F.crc32(F.concat(start, name).cast("binary")) % kinds
    first = 1 + len(changes.edits)
    pick = lambda c, texts, at: reduce(lambda w, x: w.when(c == at + x[0], x[1]), enumerate(texts), F.when(F.lit(False), F.lit("")))

    def edited(name: str) -> Column:
        own = code(F.lit(name))
        return F.when(own == 0, "").otherwise(F.concat(name, F.coalesce(pick(own, changes.edits, 1), F.lit("")))).alias(name)

    numbers = F.sequence(F.lit(0), F.size(lines(F.col("text"))) - 1)
    row, codes = "row code of " + to, "line codes of " + to
    own = docs.withColumns({row: code(F.lit("row")), codes: F.transform(numbers, lambda i: code(i.cast("string")))})
    maps = [bitmap(F.col(codes), k).alias(m) for k, m in enumerate(changes.maps)]
    return own.withColumn(to, F.struct((F.col(row) == 0).alias("dropped"), pick(F.col(row), changes.inserts, first).alias("added"), *map(edited, changes.columns), *maps)).drop(row, codes)


def _word(a: dict[str, Column], b: dict[str, Column], changes: Changes) -> Column:
    """Merged bitmaps of 64 lines, and how many changes are clean and in conflict: the right branch's state holds where it
    has changed something, else the left one's. Lines and the gaps after them are merged apart."""
    lines_of, gaps = changes.maps[: 1 + len(changes.edits)], changes.maps[1 + len(changes.edits) :]
    either = lambda x, names: reduce(lambda p, q: p.bitwiseOR(q), (x[k] for k in names))
    both = lambda x, y: x.bitwiseAND(y)
    out, count = [], {}
    for names in (lines_of, gaps):
        l, r = either(a, names), either(b, names)
        same = reduce(lambda p, q: p.bitwiseOR(q), (both(a[k], b[k]) for k in names))
        conflict = both(both(l, r), F.bitwise_not(same))
        count[names[0]] = (F.bit_count(l.bitwiseXOR(r)) + F.bit_count(same), conflict)
        out += [b[k].bitwiseOR(both(a[k], F.bitwise_not(r))).alias(k) for k in names]
    (clean_lines, conflict), (clean_gaps, inserts) = count[lines_of[0]], count[gaps[0]]
    deletes = both(conflict, a["drop"].bitwiseXOR(b["drop"]))
    numbers = (clean_lines + clean_gaps, F.bit_count(both(conflict, F.bitwise_not(deletes))), F.bit_count(deletes), F.bit_count(inserts))
    return F.struct(*out, *(n.cast("long").alias(k) for k, n in zip(COUNTS, numbers)))


def merge(docs: DataFrame, left: str = "left", right: str = "right", changes: Changes = Changes()) -> DataFrame:
    """(doc_id, changes.columns, text, n_clean, n_edit_edit, n_edit_delete, n_insert_insert) for each row of docs (doc_id,
    text, changes.columns and the branches, as coded() makes them), and for each id -1 - doc_id at which a branch adds a row.

    Columns are compared by value. A change of one branch, or the same in both, is clean; of others the right branch's state
    holds, as one conflict. A row that a branch drops counts alone: in conflict if the other one keeps and has changed it.
    Rows that are gone have nulls for columns and text; a text all of whose lines are gone is empty. Added rows have the base
    row's columns.

    Nulls in columns and text are empty; a null doc_id stays, as does that of a row added for it. Repeated rows are merged
    each by itself, and an added row whose id is there already (negative ids) stands beside it. Texts of any length: a task
    holds one at a time. Other columns are ignored, whatever their names. An empty table gives an empty result."""
    own, cols, zero = _filled(docs, changes, (left, right)), changes.columns, F.lit(0).cast("long")
    l, r, base = F.col(left), F.col(right), F.col
    any_bit = lambda side: F.exists(F.concat(*(side[m] for m in changes.maps)), lambda w: w != 0)
    changed = lambda side: reduce(or_, (side[c] != base(c) for c in cols), any_bit(side))
    # what the left branch does to a row that it drops isn't merged
    bit = lambda side, m, w: F.coalesce(F.get(side[m], w), zero)
    word = lambda w: _word({m: F.when(l["dropped"], zero).otherwise(bit(l, m, w)) for m in changes.maps}, {m: bit(r, m, w) for m in changes.maps}, changes)
    words = F.sequence(F.lit(0), F.floor((F.size("lines of it") - 1) / 64).cast("int"))
    own = own.withColumn("lines of it", lines(F.col("text"))).withColumns({"words of it": F.transform(words, word), "left changed": changed(l), "right changed": changed(r)})

    kept = ~r["dropped"] & (~l["dropped"] | base("right changed"))
    alone = l["dropped"] | r["dropped"]
    at_odds = (l["dropped"] & ~r["dropped"] & base("right changed")) | (r["dropped"] & ~l["dropped"] & base("left changed"))
    of = lambda c: (F.when(l["dropped"], base(c)).otherwise(l[c]), r[c], base(c))
    merged = {c: F.when(y != v, y).otherwise(x) for c in cols for x, y, v in [of(c)]}
    clash = sum((((x != v) & (y != v) & (x != y)).cast("long") for x, y, v in map(of, cols)), zero)
    moved = sum((((x != v) | (y != v)).cast("long") for x, y, v in map(of, cols)), zero)
    total = lambda k: F.aggregate(F.transform("words of it", lambda w: w[k]), zero, lambda s, x: s + x)
    counts = {
        "n_clean": F.when(alone, (~at_odds).cast("long")).otherwise(total("n_clean") + moved - clash),
        "n_edit_edit": F.when(alone, zero).otherwise(total("n_edit_edit") + clash),
        "n_edit_delete": F.when(alone, at_odds.cast("long")).otherwise(total("n_edit_delete")),
        "n_insert_insert": F.when(alone, zero).otherwise(total("n_insert_insert")),
    }

    def applied(line: Column, i: Column) -> Column:
        """A line's own text and the line after it, null where there is none."""
        here = F.get("words of it", F.floor(i / 64).cast("int"))
        on = lambda m: F.getbit(here[m], i % 64) == 1
        chosen = lambda names, texts: F.coalesce(*(F.when(on(m), F.lit(x)) for m, x in zip(names, texts)), F.lit(None).cast("string"))
        edits, inserts = changes.maps[1 : 1 + len(changes.edits)], changes.maps[1 + len(changes.edits) :]
        return F.array(F.when(~on("drop"), F.concat(line, F.coalesce(chosen(edits, changes.edits), F.lit("")))), chosen(inserts, changes.inserts))

    text = F.array_join(F.flatten(F.transform("lines of it", applied)), "\n")
    fields = lambda i, values, t, n: F.struct(i.alias("doc_id"), *(v.alias(c) for c, v in values.items()), t.alias("text"), *(n[k].alias(k) for k in COUNTS))
    own_row = fields(base("doc_id"), {c: F.when(kept, v) for c, v in merged.items()}, F.when(kept, text), counts)
    x, y = l["added"], r["added"]
    twice = x.isNotNull() & y.isNotNull() & (x != y)
    added = fields(-1 - base("doc_id"), {c: base(c) for c in cols}, F.coalesce(y, x), {"n_clean": F.when(twice, zero).otherwise(F.lit(1).cast("long")), "n_edit_edit": zero, "n_edit_delete": zero, "n_insert_insert": twice.cast("long")})
    both = F.array(own_row, F.when(x.isNotNull() | y.isNotNull(), added))
    return own.select(F.explode(F.array_compact(both)).alias("row")).select("row.*")


def _filled(docs: DataFrame, changes: Changes, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns and the text, nulls empty; nothing else of docs but `more`."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*changes.columns, "text")), *more)


def merge_coded(docs: DataFrame, left: str = "L", right: str = "R", changes: Changes = Changes()) -> DataFrame:
    """merge() of two branches that coded() makes of docs; the same holds for odd rows as there."""
    own = _filled(docs, changes)
    return merge(coded(coded(own, left, "left", changes), right, "right", changes), "left", "right", changes)


def oracle_sql() -> str:
    """The merge of the query in DuckDB's SQL, by joins and sums over single lines in place of bitmaps."""
    crc = lambda b, name: f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split('{b}:' || coalesce(cast(doc_id as varchar), '') || ':' || {name}, ''), lambda x: cast(ord(x) as bigint))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 7"
    column = lambda b, c: f"case {crc(b, repr(c))} when 0 then '' when 1 then {c} || '!' when 2 then {c} || '?' else {c} end as {c}_{b}"
    mark = lambda c: f"case {c} when 1 then '!' when 2 then '?' else '' end"
    put = lambda c: f"case {c} when 3 then '!' when 4 then '?' end"
    return f"""with crc as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
base as (select doc_id, row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, tab from documents, crc),
rows as materialized (select doc_id, r, lang, source, text, {crc('L', "'row'")} as l, {crc('R', "'row'")} as rr, {', '.join(column(b, c) for c in ('lang', 'source') for b in 'LR')} from base),
split as (select doc_id, r, tab, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from base),
coded as materialized (select r, line, i, {crc('L', 'cast(i as varchar)')} as a, {crc('R', 'cast(i as varchar)')} as b from split),
of_l as (select r, case when l = 0 then 99 else a end as x, line, i, a, b from coded join rows using (r)),
line_state as (select r, i, a, b, case when b <= 2 then b when x <= 2 then x else 99 end as st, case when b in (3, 4) then b when x in (3, 4) then x end as gap, line from of_l),
sums as (select r, bool_or(a <= 4) as any_l, bool_or(b <= 4) as any_r,
sum(case when (a <= 2 or b <= 2) and (a > 2 or b > 2 or a = b) then 1 else 0 end) + sum(case when (a in (3, 4) or b in (3, 4)) and (a not in (3, 4) or b not in (3, 4) or a = b) then 1 else 0 end) as clean,
sum(case when a in (1, 2) and b in (1, 2) and a <> b then 1 else 0 end) as ee, sum(case when a <= 2 and b <= 2 and a <> b and (a = 0 or b = 0) then 1 else 0 end) as ed, sum(case when a in (3, 4) and b in (3, 4) and a <> b then 1 else 0 end) as ii,
coalesce(string_agg(concat_ws(chr(10), case when st <> 0 then line || {mark('st')} end, {put('gap')}), chr(10) order by i) filter (where st <> 0 or gap is not null), '') as merged from line_state group by r),
j as (select *, any_l or lang_L <> lang or source_L <> source as ch_l, any_r or lang_R <> lang or source_R <> source as ch_r, l = 0 as dl, rr = 0 as dr from rows join sums using (r)),
k as (select *, not dr and (not dl or ch_r) as kept, dl or dr as alone, (dl and not dr and ch_r) or (dr and not dl and ch_l) as odds,
case when lang_R <> lang then lang_R when dl then lang else lang_L end as m_lang, case when source_R <> source then source_R when dl then source else source_L end as m_source,
{' + '.join(f'case when {c}_L <> {c} and {c}_R <> {c} and {c}_L <> {c}_R then 1 else 0 end' for c in ('lang', 'source'))} as clash, {' + '.join(f'case when {c}_L <> {c} or {c}_R <> {c} then 1 else 0 end' for c in ('lang', 'source'))} as moved from j)
select doc_id, case when kept then m_lang end as lang, case when kept then m_source end as source, case when kept then sha256(merged) end as text_sha256,
cast(case when alone then case when odds then 0 else 1 end else clean + moved - clash end as bigint) as n_clean, cast(case when alone then 0 else ee + clash end as bigint) as n_edit_edit, cast(case when alone then case when odds then 1 else 0 end else ed end as bigint) as n_edit_delete, cast(case when alone then 0 else ii end as bigint) as n_insert_insert from k
union all select -1 - doc_id, lang, source, sha256(coalesce({put('rr')}, {put('l')})), cast(case when l in (3, 4) and rr in (3, 4) and l <> rr then 0 else 1 end as bigint), cast(0 as bigint), cast(0 as bigint), cast(case when l in (3, 4) and rr in (3, 4) and l <> rr then 1 else 0 end as bigint) from k where l in (3, 4) or rr in (3, 4)"""
