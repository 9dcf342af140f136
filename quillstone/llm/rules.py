"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = (
    "the of and to in a is that it for was on as be with by at this are or from "
    "der die und das ist nicht ein eine zu den mit sich auf für von im "
    "le la de et les des un une du en que qui est dans pour par sur au pas ce "
    "el los las y por con una su al del no se lo es para"
).split()


@dataclass(frozen=True)
class Rule:
    """least <= permille of `part` in `whole` <= most, asked of texts with at least `from_` of `of`."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None
    of: str = "words"
    from_: int = 0


#: The production thresholds. Parts and wholes are measures below; all comparisons are in whole numbers.
RULES = (
    Rule("some_words", "words", "one", least=1000),
    Rule("word_length", "word_chars", "words", least=2000, most=14000),
    Rule("symbols", "symbols", "chars", most=80),
    Rule("capitals", "capitals", "chars", most=450),
    Rule("stop_words", "stop_words", "words", least=50, from_=100),
    Rule("variety", "variety", "words", least=1440, from_=2),  # one word can't repeat another
    Rule("repeated_lines", "distinct_lines", "lines", least=500, of="lines", from_=4),
)
HERE = "__qr_here"  # not deterministic: a filter that needs it stays above the measures, which are then computed once and not at each mention
MEASURES = ("chars", "words", "word_chars", "distinct_words", "stop_words", "capitals", "symbols", "lines", "distinct_lines")


def measures(text: Column) -> dict[str, Column]:
    """What the rules compare, each a whole number."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    words = F.col("__qr_words")
    lines = F.col("__qr_lines")
    return {
        "chars": F.length(whole),
        "words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "distinct_words": F.size(F.array_distinct(words)),
        "stop_words": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))),
        "capitals": F.length(F.regexp_replace(whole, "[^\\p{Lu}]+", "")),
        "symbols": F.length(F.regexp_replace(whole, "[\\p{L}\\p{N} \\t\\r\\n.,!?;:'\"()-]+", "")),
        "lines": F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)),
    }


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row of measures fails, in order, as one expression."""
    count = lambda m: F.col(m).cast("bigint")  # noqa: E731 - before any product: squares and thousands of a long text's measures are beyond 32 bits
    value = lambda m: F.lit(1).cast("bigint") if m == "one" else count("distinct_words") * count("distinct_words") if m == "variety" else count(m)
    failed = []
    for r in rules:
        share, base = value(r.part) * 1000, value(r.whole)
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (share < base * r.least)
        if r.most is not None:
            bad = bad | (share > base * r.most)
        failed.append(F.when((value(r.of) >= r.from_) & bad, F.lit(r.name)))
    return F.array_join(F.array_compact(F.array(*failed)), ",")


def _measured(docs: DataFrame, text_col: str, keep: list[Column], rules: tuple[Rule, ...]) -> DataFrame:
    text = F.col(f"`{text_col}`")
    whole = F.coalesce(text.cast("string"), F.lit(""))
    split = docs.select(
        *keep,
        whole.alias("__qr_text"),
        F.filter(F.split(F.lower(whole), "[^\\p{L}\\p{N}]+"), lambda w: w != "").alias("__qr_words"),
        F.filter(F.split(whole, "\n"), lambda x: x != "").alias("__qr_lines"),
    )
    made = [c.cast("int").alias(m) for m, c in measures(F.col("__qr_text")).items()]
    return split.select(*[c for c in split.columns if not c.startswith("__qr_")], *made, F.spark_partition_id().alias(HERE))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row's id, its measures, the names of the rules it fails (comma-separated) and whether it is kept (fails none).

    Null and empty texts measure 0 and fail `some_words`. Repeated rows are assessed alike; null ids are kept; other columns are ignored. A projection without shuffle or user functions.
    """
    rows = _measured(docs, text_col, [F.col(f"`{id_col}`").alias("__id")], rules)
    out = rows.select("__id", *MEASURES, compiled(rules).alias("failed"))
    return out.select(F.col("__id").alias(id_col), *MEASURES, "failed", (F.col("failed") == "").alias("kept"))


def kept(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that fail no rule, with all their columns, whatever they are called.

    Null, empty and blank texts fail `some_words` and go; repeated rows stay or go together; null ids and nulls elsewhere don't matter; long texts are measured whole; an empty table gives an empty one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = _measured(docs, text_col, [row], rules).where((compiled(rules) == "") & (F.col(HERE) >= 0))
    return rows.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def sql(table: str = "documents") -> str:
    """The same assessment as DuckDB SQL, from the same table of rules."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    value = lambda m: {"one": "1", "variety": "distinct_words::BIGINT * distinct_words"}.get(m, f"{m}::BIGINT")
    cases = []
    for r in RULES:
        bad = []
        if r.least is not None:
            bad.append(f"{value(r.part)} * 1000 < {value(r.whole)} * {r.least}")
        if r.most is not None:
            bad.append(f"{value(r.part)} * 1000 > {value(r.whole)} * {r.most}")
        cases.append(f"CASE WHEN {value(r.of)} >= {r.from_} AND ({' OR '.join(bad)}) THEN '{r.name}' END")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM {table}),
s AS (SELECT doc_id, x, list_filter(string_split_regex(lower(x), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws,
             list_filter(string_split(x, chr(10)), lambda y: y <> '') AS ls FROM t),
m AS (SELECT doc_id, length(x)::INT AS chars, len(ws)::INT AS words, length(array_to_string(ws, ''))::INT AS word_chars,
             len(list_distinct(ws))::INT AS distinct_words, len(list_filter(ws, lambda w: w IN ({stop})))::INT AS stop_words,
             length(regexp_replace(x, '[^\\p{{Lu}}]+', '', 'g'))::INT AS capitals,
             length(regexp_replace(x, '[\\p{{L}}\\p{{N}} \\t\\r\\n.,!?;:''"()-]+', '', 'g'))::INT AS symbols,
             len(ls)::INT AS lines, len(list_distinct(ls))::INT AS distinct_lines FROM s),
f AS (SELECT *, concat_ws(',', {', '.join(cases)}) AS failed FROM m)
SELECT doc_id, {', '.join(MEASURES)}, failed, failed = '' AS kept FROM f"""
