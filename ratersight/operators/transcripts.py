"""Transcripts: cues, and segments of words at pauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratersight.functions.text import clock

#: The marks of a sentence's and of a clause's end. In seconds: pauses that end a segment anywhere, after a sentence, after a clause and after a question;
#: the least length of a segment that a clause ends, and the length that ends any.
SENTENCE_MARKS, CLAUSE_MARKS = (".", "!", "?"), (",", ";", ":", "\u2014", "\u2013")
LONG, SENTENCE, CLAUSE, QUESTION, LEAST, MOST = 2.0, 0.2, 0.3, 0.3, 2.0, 30.0


def vtt(cues: DataFrame, key: str, order: str, start: str, end: str, text: str) -> DataFrame:
    """One WEBVTT text per key, cues in order; a null text is an empty cue. See also whole_vtt()."""
    cue = F.concat(clock(F.col(start)), F.lit(" --> "), clock(F.col(end)), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n"))
    own = cues.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, cue.alias("cue")))).alias("cues"))
    return own.select(key, F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("cues", lambda c: c["cue"]), "\n")).alias("vtt"))


def whole_vtt(text: Column) -> Column:
    """The WEBVTT text of a transcript without segments: one cue over all."""
    return F.concat(F.lit("WEBVTT\n\n00:00:00.000 --> 99:59:59.999\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def merged(chunks: DataFrame, key: str = "track") -> DataFrame:
    """Words of a recording that was transcribed in chunks (key, chunk, length, words array<struct<word, start, end>>), their
    times shifted by the lengths of the chunks before: (key, no, word, start, end), no counting from 0."""
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    own = chunks.withColumns({"offset": F.coalesce(F.sum("length").over(before), F.lit(0.0)), "first": F.coalesce(F.sum(F.size("words")).over(before), F.lit(0))})
    words = own.select(key, "offset", "first", F.posexplode("words").alias("at", "w"))
    return words.select(key, (F.col("first") + F.col("at")).cast("long").alias("no"), "w.word", (F.col("w.start") + F.col("offset")).alias("start"), (F.col("w.end") + F.col("offset")).alias("end"))


def spoken(turns: DataFrame) -> DataFrame:
    """(track, no, word, start, end) of conversations, at an even pace with a pause after each turn."""
    words = turns.select(F.col("conv_id").alias("track"), "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("at", "word")).filter("word <> ''")
    start = F.col("turn") * 600.0 + F.col("at") * 0.5 + F.when(F.col("at") % 7 == 6, 0.3).otherwise(0.0)
    return words.select("track", (F.col("turn") * 100_000 + F.col("at")).cast("long").alias("no"), "word", start.alias("start"), (start + 0.2).alias("end"))


def _named(value: Column, body) -> Column:
    """body(value), in which value is worked out once however often it stands there."""
    return F.get(F.transform(F.array(value), body), 0)


def _after(state: Column, x: Column) -> Column:
    """The state (first, began, asked, cuts) of a fold over words after one more (i, word, start, end, gap): where the segment
    began, the last word with a question mark, and the ends found so far, by the first rule that holds. A clause mark with
    its pause ends the search even where the segment is too short."""
    began = F.when(x["i"] == state["first"], x["start"]).otherwise(state["began"])
    asked = F.when(F.contains(x["word"], F.lit("?")), x["i"]).otherwise(state["asked"])
    gap, length, mark = x["gap"], x["end"] - began, F.right(F.regexp_replace(x["word"], r"(?U)\s+$", ""), F.lit(1))
    reason = (
        F.when(gap.isNull(), "final")
        .when(gap >= LONG, F.concat(F.lit("pause_"), F.call_function("format_number", gap, F.lit("0.00")), F.lit("s")))
        .when(mark.isin(*SENTENCE_MARKS) & (gap > SENTENCE), "sentence_end")
        .when(mark.isin(*CLAUSE_MARKS) & (gap > CLAUSE), F.when(length >= LEAST, "clause_boundary"))
        .when(length >= MOST, "max_duration")
        .when((gap > QUESTION) & (asked >= F.greatest(x["i"] - 4, state["first"])), "post_question")
    )

    def then(reason: Column) -> Column:
        cut = reason.isNotNull()
        own = F.struct(state["first"].alias("first"), x["i"].alias("last"), reason.alias("reason"))
        return F.struct(F.when(cut, x["i"] + 1).otherwise(state["first"]).alias("first"), began.alias("began"), asked.alias("asked"), F.when(cut, F.array_append(state["cuts"], own)).otherwise(state["cuts"]).alias("cuts"))

    return _named(reason, then)


def pause_segments(words: DataFrame) -> DataFrame:
    """Segments (track, no, start, end, text, start_offset, end_offset, reason) of words (track, no, word, start, end): a word
    ends one by the pause after it, its last mark and the segment's length; offsets count 10 ms.

    A pause of LONG ends a segment whatever came before, so tracks are split there into runs, and a run's words are folded in
    order with the state of the segment so far. A run is what is said without such a pause. A null word is an empty one."""
    by = Window.partitionBy("track").orderBy("no")
    own = words.withColumn("word", F.coalesce("word", F.lit(""))).withColumn("gap", F.lead("start").over(by) - F.col("end"))
    own = own.withColumn("new", F.coalesce((F.lag("gap").over(by) >= LONG).cast("long"), F.lit(0)))
    own = own.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = own.groupBy("track", "run").agg(F.array_sort(F.collect_list(F.struct("no", "word", "start", "end", "gap"))).alias("words"))
    numbered = F.transform("words", lambda x, i: F.struct(i.alias("i"), *(x[c].alias(c) for c in ("word", "start", "end", "gap"))))
    none = F.array().cast("array<struct<first:int,last:int,reason:string>>")
    start = F.struct(F.lit(0).alias("first"), F.lit(None).cast("double").alias("began"), F.lit(-1).alias("asked"), none.alias("cuts"))
    cuts = F.aggregate(numbered, start, _after, lambda s: s["cuts"])
    found = runs.select("track", "run", "words", F.inline(cuts))
    said = F.array_join(F.transform(F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + 1), lambda x: x["word"]), " ")
    text = F.regexp_replace(said, r"(?U)^\s+|\s+$", "")
    begin, end = F.get("words", F.col("first"))["start"], F.get("words", F.col("last"))["end"]
    place = F.row_number().over(Window.partitionBy("track").orderBy("run", "first")) - 1
    steps = lambda t: (t / 0.01).cast("long")  # noqa: E731  cut, not rounded
    return found.select("track", place.cast("long").alias("no"), begin.alias("start"), end.alias("end"), text.alias("text"), steps(begin).alias("start_offset"), steps(end).alias("end_offset"), "reason")
