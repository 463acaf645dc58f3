"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_names

STOP_WORDS = sorted(
    set(
        "the of and to in is that it was for on are with as be at by this have from or an a he not which you his but had has their were they we she".split()
        + "der die das und ist nicht den von zu mit sich auf für dem des ein eine im auch als er es an werden aus".split()
        + "le la les de des du et est un une que qui dans pour par sur pas au plus avec en ce il elle ne se".split()
        + "el los las y que en un una por con para es del se no al lo su como más pero sus le".split()
    )
)
SYMBOLS = "#$%&*|<>{}@=+~^_"
#: Metrics are counts; each is one Spark SQL expression over the columns of :data:`PARTS`.
PARTS = {
    "words": "filter(split(lower({text}), '[ \\\\t\\\\n\\\\r\\\\f]+'), x -> x <> '')",
    "lines": "split({text}, '\\n')",
}
METRICS = {
    "n_chars": "length({text})",
    "n_words": "size(words)",
    "n_word_chars": "length(regexp_replace({text}, '[ \\\\t\\\\n\\\\r\\\\f]+', ''))",
    "n_symbols": "length({text}) - length(regexp_replace({text}, '[#$%&*|<>{{}}@=+~^_]+', ''))",
    "n_upper": "length({text}) - length(regexp_replace({text}, '\\\\p{{Lu}}+', ''))",
    "n_digits": "length({text}) - length(regexp_replace({text}, '[0-9]+', ''))",
    "n_stop_words": "size(filter(words, x -> rtrim('.,;:!?', x) in ({stop})))",
    "n_distinct_words": "size(array_distinct(words))",
    "n_lines": "size(lines)",
    "n_distinct_lines": "size(array_distinct(lines))",
    "n_bullets": "size(filter(lines, x -> substring(x, 1, 1) in ('-', '*', '•')))",
    "n_ellipses": "size(filter(lines, x -> substring(x, -3, 3) = '...' or substring(x, -1, 1) = '…'))",
}
#: (rule, left metric, comparison that must hold, factor, right metric or None for the number itself)
RULES = [
    ("few_words", "n_words", ">=", 3, None),
    ("many_words", "n_words", "<=", 200_000, None),
    ("short_words", "n_word_chars", ">=", 2.5, "n_words"),
    ("long_words", "n_word_chars", "<=", 14, "n_words"),
    ("symbols", "n_symbols", "<=", 0.1, "n_chars"),
    ("upper_case", "n_upper", "<=", 0.4, "n_chars"),
    ("digits", "n_digits", "<=", 0.3, "n_chars"),
    ("stop_words", "n_stop_words", ">=", 0.03, "n_words"),
    ("repeated_words", "n_distinct_words", ">=", 0.15, "n_words"),
    ("repeated_lines", "n_distinct_lines", ">=", 0.5, "n_lines"),
    ("bullets", "n_bullets", "<=", 0.9, "n_lines"),
    ("ellipses", "n_ellipses", "<=", 0.3, "n_lines"),
]


def _rule(left: str, op: str, factor: float, right: str | None) -> str:
    """Whole-number arithmetic, so that engines can't differ in rounding."""
    return f"{left} {op} {factor}" if right is None else f"{left} * 1000 {op} {right} * {round(factor * 1000)}"


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list = RULES, stop_words: list = STOP_WORDS) -> DataFrame:
    """(doc_id, the metrics, ``failed``, ``keep``) of every row: counts of characters, words and lines, the rules that don't hold in the order of the table, and whether there are none.

    ``rules`` is the threshold table, ``stop_words`` the words that :data:`RULES` wants some of: those of four languages; give others for other languages.

    A null text has null metrics, fails ``no_text`` only and isn't kept; an empty one has counts of 0 (one line). Long
    texts count whole. Repeated rows come out alike; null doc_ids stay; an empty table gives no rows. Other columns are ignored.
    """
    stop = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in stop_words)
    (text,) = fresh_names(docs.select(id_col), "text")
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias(text))
    out = out.select("*", *(F.expr(e.format(text=text)).alias(n) for n, e in PARTS.items()))
    out = out.select("*", *(F.when(F.col(text).isNotNull(), F.expr(e.format(text=text, stop=stop))).cast("bigint").alias(n) for n, e in METRICS.items()))
    flags = [f"case when not ({_rule(*r[1:])}) then '{r[0]}' end" for r in rules]
    failed = F.when(F.col(text).isNull(), F.lit("no_text")).otherwise(F.expr(f"concat_ws(',', {', '.join(flags)})"))
    return out.select("doc_id", *METRICS, failed.alias("failed")).withColumn("keep", F.col("failed") == "")


def oracle(rules: list = RULES) -> str:
    """The same in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    metrics = {
        "n_chars": "length(text)",
        "n_words": "len(words)",
        "n_word_chars": "length(regexp_replace(text, '[ \\t\\n\\r\\f]+', '', 'g'))",
        "n_symbols": "length(text) - length(regexp_replace(text, '[#$%&*|<>{}@=+~^_]+', '', 'g'))",
        "n_upper": "length(text) - length(regexp_replace(text, '\\p{Lu}+', '', 'g'))",
        "n_digits": "length(text) - length(regexp_replace(text, '[0-9]+', '', 'g'))",
        "n_stop_words": f"len(list_filter(words, lambda x: rtrim(x, '.,;:!?') in ({stop})))",
        "n_distinct_words": "len(list_distinct(words))",
        "n_lines": "len(lines)",
        "n_distinct_lines": "len(list_distinct(lines))",
        "n_bullets": "len(list_filter(lines, lambda x: x[1:1] in ('-', '*', '•')))",
        "n_ellipses": "len(list_filter(lines, lambda x: right(x, 3) = '...' or right(x, 1) = '…'))",
    }
    flags = [f"case when not ({_rule(*r[1:])}) then '{r[0]}' end" for r in rules]
    return f"""
with parts as (select doc_id, text, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') as words, string_split(text, chr(10)) as lines from documents),
counted as (select doc_id, text, {", ".join(f"cast({e} as bigint) as {n}" for n, e in metrics.items())} from parts),
ruled as (select doc_id, {", ".join(metrics)}, case when text is null then 'no_text' else concat_ws(',', {", ".join(flags)}) end as failed from counted)
select *, failed = '' as keep from ruled"""
