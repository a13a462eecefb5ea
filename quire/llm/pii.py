"""Personal data by regular expressions, then by contexts learnt from what those found.

Base entities come from four patterns (email, ip, card, phone) and are never given up. They are the seeds of a
bootstrap: the word before an entity is a lexical pattern (Unicode letters, then white space or punctuation), the entity
an instance, and so is a token that holds three digits or an @, with brackets and further groups of digits; the graph of patterns and instances is scored in turns. A pattern's confidence is the sum of its instances' scores, each
as often as it stands there, over the number of times that the word occurs at all, whatever follows it, plus one: a word that mostly stands
before something else (stop words do) stays low, however many entities it has met. An instance's score is one minus the chance that all its
patterns err; what is learnt in one turn supports the patterns of the next, until no confidence grows by CHANGE any more. Then tokens that no base entity covers but that stand behind a pattern of MIN_CONFIDENCE
or more, seen before MIN_SEEDS different seeds or more, are added as spans of kind `id`.

Everything runs in SQL functions. Positions are code points: a text is split by a pattern and the lengths of the
pieces and matches are summed. The patterns are written without backtracking between their parts, so that very long
runs stay linear. Edge cases: a null text is an empty one; no match gives 0 counts, the hash of the empty string and
an empty spans; repeated rows are each reported and each counted; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lower_ascii, materialize, table, whole_text

KINDS = ("email", "ip", "card", "phone")
_DOT = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_DOT})|\G){_DOT}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_HINT = {"email": "@", "phone": "+"}
#: Scores only grow from turn to turn; below this growth of all confidences they stand.
CHANGE = 0.005
MIN_CONFIDENCE = 0.8
MIN_SEEDS = 5
#: A word with what stands between it and an entity: white space of any kind, punctuation before and opening signs behind.
_WORD = r"(?<![\p{L}\p{N}])\p{L}{2,}+"
_GROUP = r"(?:[(][A-Za-z0-9]{1,16}[)]|\[[A-Za-z0-9]{1,16}\])(?=[A-Za-z0-9-]| [0-9])"
_GAP = rf"\p{{P}}{{0,3}}+[\s\p{{Z}}]{{1,8}}+(?:(?!{_GROUP})[(\[{{<\x22\x27\p{{Pi}}]){{0,3}}+"
_SEED = rf"({_WORD})(?:{_GAP}|[:=(\[{{<\x22\x27]{{1,3}})$"
#: A token that may be an identifier, with brackets and groups of digits behind single spaces, and the word before it.
_TOKEN = rf"[A-Za-z0-9@#:/_.+-]|{_GROUP}"
_CANDIDATE = rf"{_WORD}{_GAP}(?=[A-Za-z#:/_.+(\[-]*+[0-9@])(?:{_TOKEN})++(?: [(]?[0-9](?:[0-9./-]|[)](?= [0-9]))*+)*+(?=[\s\p{{Z}},;)\]}}>\x22\x27\p{{Pf}}]|$)"
MIN_CHARS = 6


def _scan(text: str, pattern: str, fields: str, item: str, keep: str = "true") -> Column:
    """Array of one struct a match, with `x.hit` the match and `at` its start. Matches gather in blocks of 256, so that
    a text with many of them is not copied over for each."""
    pattern = pattern.replace("\\", "\\\\")
    none = f"cast(array() as array<struct<{fields}>>)"
    return F.expr(
        f"""aggregate(
              transform(arrays_zip(split({text}, '{pattern}', -1), regexp_extract_all({text}, '{pattern}', 0)), z -> named_struct('piece', z.`0`, 'hit', z.`1`)),
              named_struct('next', 0, 'full', cast(array() as array<array<struct<{fields}>>>), 'last', {none}),
              (a, x) -> named_struct(
                'next', a.next + length(x.piece) + coalesce(length(x.hit), 0),
                'full', if(size(a.last) >= 256, array_append(a.full, a.last), a.full),
                'last', if(x.hit is not null and {keep}, array_append(if(size(a.last) >= 256, {none}, a.last), {item.replace("@at", "(a.next + length(x.piece))")}), if(size(a.last) >= 256, {none}, a.last))),
              a -> flatten(array_append(a.full, a.last)))"""
    )


def _found(text: str, kind: str) -> Column:
    """Array of (start, end, value) of all matches of one kind, tests not yet applied."""
    fields = "start:int,end:int,value:string"
    got = _scan(text, PATTERNS[kind], fields, "named_struct('start', @at, 'end', @at + length(x.hit), 'value', x.hit)")
    hint = F.col(text).contains(_HINT[kind]) if kind in _HINT else F.col(text).rlike("[0-9]")
    return F.when(hint, got).otherwise(F.expr(f"cast(array() as array<struct<{fields}>>)"))


_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_LUHN = f"""aggregate(
    transform(split(reverse({_DIGITS}), ''), (d, i) -> cast(d as int) * (1 + i % 2)), 0, (a, v) -> a + if(v > 9, v - 9, v), a -> a % 10 = 0)"""
_TESTS = {
    "email": None,
    "ip": "not exists(split(x.value, '[.]'), p -> not p rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')",
    "card": f"case when length({_DIGITS}) between 14 and 19 then {_LUHN} else false end",
    "phone": f"length({_DIGITS}) between 10 and 15",
}


def base_entities(docs: DataFrame) -> DataFrame:
    """docs (with a text) plus one array of (start, end, value) a kind."""
    docs = docs.withColumn("text", whole_text())
    for kind in KINDS:
        docs = docs.withColumn(kind, _found("text", kind))
    tested = {k: F.expr(f"filter({k}, x -> {_TESTS[k]})") for k in KINDS if _TESTS[k]}
    return docs.withColumns(tested)


def _spans(kind: str, order: int) -> str:
    return f"transform({kind}, x -> named_struct('start', x.start, 'k', {order}, 'said', concat('{kind}:', x.start, ':', x.end), 'end', x.end))"


def _candidates(text: str) -> Column:
    """Array of (start, end, context, value): tokens that may be identifiers, each with the word before it."""
    fields = "start:int,end:int,context:string,value:string"
    gap = rf"^\p{{L}}+{_GAP}".replace("\\", "\\\\")
    value = f"regexp_replace(x.hit, '{gap}', '')"
    item = f"named_struct('start', @at + length(x.hit) - length({value}), 'end', @at + length(x.hit), 'context', regexp_extract(x.hit, '^\\\\p{{L}}+', 0), 'value', {value})"
    got = _scan(text, _CANDIDATE, fields, item, f"x.hit rlike '@|[0-9][^0-9]*[0-9][^0-9]*[0-9]' and length({value}) >= {MIN_CHARS}")
    return F.when(F.col(text).rlike("[0-9@]"), got).otherwise(F.expr(f"cast(array() as array<struct<{fields}>>)"))


def _seeds(text: str) -> Column:
    """Array of (context, value): every base span with the word before it (within 1024 code points), empty where none stands there."""
    seed = _SEED.replace("\\", "\\\\")
    before = f"substring({text}, greatest(1, x.start - 1023), least(1024, x.start))"
    return F.expr(f"transform(concat({', '.join(KINDS)}), x -> named_struct('context', regexp_extract({before}, '{seed}', 1), 'value', x.value))")


def pattern_graph(found: DataFrame) -> DataFrame:
    """(pattern, instance, seed, times): links between contexts and base spans (seeds) or tokens that none covers, and how often each occurs."""
    links = found.select(F.explode("candidates").alias("c"), "base")
    links = links.where(~F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))).select("c.context", "c.value", F.lit(False).alias("seed"))
    seeds = found.select(F.explode("seeds").alias("c")).select("c.context", "c.value", F.lit(True).alias("seed")).where("context <> ''")
    links = links.unionByName(seeds).select(lower_ascii(F.col("context")).alias("pattern"), F.xxhash64("value").alias("instance"), "seed")
    return links.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("times"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(pattern, total): how often each word occurs in all texts; summed before the shuffle."""
    pattern = _WORD.replace("\\", "\\\\")
    words = docs.select(F.explode(F.expr(f"regexp_extract_all(text, '{pattern}', 0)")).alias("word"))
    return words.groupBy(lower_ascii(F.col("word")).alias("pattern")).agg(F.count(F.lit(1)).alias("total"))


def trusted_patterns(graph: DataFrame, totals: DataFrame) -> DataFrame:
    """(pattern, confidence) of the patterns that pass, once the scores stand.

    Only patterns that would pass if all their instances were certain can ever pass; the others are left out of the turns.
    """
    sums = graph.groupBy("pattern").agg(F.count_if("seed").alias("seeds"), F.sum("times").alias("met"))
    possible = sums.where(F.col("seeds") >= MIN_SEEDS).join(totals, "pattern").where(F.col("met") >= MIN_CONFIDENCE * (F.col("total") + 1))
    possible = materialize(possible.select("pattern", "total", F.lit(0.0).alias("confidence")), "possible")
    graph = materialize(graph.join(possible.select("pattern", "total"), "pattern"), "graph")
    scores = graph.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"), F.max("seed").alias("seed"))
    patterns, growth = possible.select("pattern", "confidence"), 1.0
    while growth >= CHANGE:
        scores = materialize(scores, "scores")
        before = patterns.select("pattern", F.col("confidence").alias("before"))
        patterns = graph.join(scores.drop("seed"), "instance").groupBy("pattern").agg((F.sum(F.col("score") * F.col("times")) / (F.first("total") + 1)).alias("confidence"))
        patterns = materialize(patterns, "patterns")
        growth = patterns.join(before, "pattern").agg(F.max(F.col("confidence") - F.col("before")).alias("g")).first().g or 0.0
        wrong = F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))
        learnt = graph.join(patterns, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(wrong))).alias("learnt"))
        scores = scores.join(learnt, "instance").select("instance", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.col("learnt")).alias("score"), "seed")
    return patterns.where(F.col("confidence") >= MIN_CONFIDENCE).select("pattern", "confidence")


def extract(docs: DataFrame) -> DataFrame:
    """docs without text, with email, ip, card, phone (arrays of spans), base (sorted) and ids (sorted spans that contexts add)."""
    found = base_entities(docs)
    base = F.expr("array_sort(concat(" + ", ".join(_spans(k, i) for i, k in enumerate(KINDS)) + "))")
    found = found.withColumns({"base": base, "candidates": _candidates("text"), "seeds": _seeds("text")}).drop("text")
    found = materialize(found.withColumn("_row", F.monotonically_increasing_id()), "found")
    trusted = trusted_patterns(materialize(pattern_graph(found), "graph"), word_counts(docs))
    new = found.select("_row", "base", F.explode("candidates").alias("c")).select("_row", "base", "c", lower_ascii(F.col("c.context")).alias("pattern"))
    new = new.where(~F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))).join(trusted, "pattern", "left_semi")
    said = F.concat(F.lit("id:"), F.col("c.start"), F.lit(":"), F.col("c.end"))
    new = new.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(F.col("c.start").alias("start"), F.lit(len(KINDS)).alias("k"), said.alias("said"), F.col("c.end").alias("end")))).alias("ids"))
    return found.join(new, "_row", "left").drop("_row", "candidates", "seeds")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More columns: n_id, the spans that contexts added."""
    out = extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = "array_join(transform({}, x -> x.said), ',')"
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.expr(said.format("base")), 256).alias("base_sha256"),
        F.expr(said.format("array_sort(concat(base, coalesce(ids, array())))")).alias("spans"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_id"),
    )
