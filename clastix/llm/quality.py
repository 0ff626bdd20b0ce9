"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh

STOP_WORDS = (
    "the be to of and that have with is in it for on as by an a this from are was at or not "
    "le la les de des du un une et en que qui dans par pour sur avec au aux est pas ne ou "
    "der die das und ist von zu den mit auf für ein eine nicht als im dem des sich auch es "
    "el los las y una por con para del se su al lo como más o pero sus"
).split()

#: Texts of fewer words may do without stop words: the rule begins here.
STOP_FROM = 50
#: (rule, metric, least, most, words): None is no bound; a text of fewer words than the last has no such rule. A text that breaks a rule has the rule's name in broken.
RULES: tuple[tuple[str, str, float | None, float | None, int], ...] = (
    ("too_short", "n_words", 1, None, 0),
    ("too_long", "n_words", None, 1_000_000, 0),
    ("word_length", "mean_word_length", 2.0, 15.0, 0),
    ("symbols", "symbol_ratio", None, 0.25, 0),
    ("bullet_lines", "bullet_line_ratio", None, 0.9, 0),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.3, 0),
    ("bar_signs", "bar_word_ratio", None, 0.25, 0),
    ("upper_case", "upper_word_ratio", None, 0.5, 0),
    ("letters", "alpha_word_ratio", 0.6, None, 0),
    ("stop_words", "stop_word_ratio", 0.02, None, STOP_FROM),
    ("repeated_lines", "duplicate_line_ratio", None, 0.5, 0),
    ("repeated_words", "distinct_word_ratio", 0.1, None, 0),
)

#: Metrics: (numerator, denominator) of building blocks; a zero denominator makes 0.
RATIOS = {
    "n_words": ("words", None),
    "mean_word_length": ("word_chars", "words"),
    "symbol_ratio": ("symbols", "chars"),
    "bullet_line_ratio": ("bullets", "lines"),
    "ellipsis_line_ratio": ("ellipses", "lines"),
    "bar_word_ratio": ("bars", "words"),
    "upper_word_ratio": ("uppers", "words"),
    "alpha_word_ratio": ("alphas", "words"),
    "stop_word_ratio": ("stops", "words"),
    "duplicate_line_ratio": ("repeats", "lines"),
    "distinct_word_ratio": ("distinct", "words"),
}

#: Building blocks as counts of a pattern that Java and RE2 read alike.
PATTERNS = {
    "words": r"\S+",
    "symbols": r"[#$%&*+/<=>@\\^_`{{|}}~\[\]]".replace("{{", "{").replace("}}", "}"),
    "bullets": r"(?m)^[ \t]*[-*•‣o][ \t]",
    "ellipses": r"(?m)(?:\.\.\.|…)[ \t]*$",
    "bars": r"(?:^|\s)\|",
    "alphas": r"\S*[a-zA-Z\x{80}-\x{10FFFF}]\S*",
    "lines": r"(?m)^.*\S.*$",
}


#: The same counts for Java, which goes back over a run where it need not: a word's first letter, with the rest, for the word.
JAVA = PATTERNS | {"words": r"\S++", "alphas": r"[a-zA-Z\x{80}-\x{10FFFF}]\S*+"}
#: A word of capitals, without a small ASCII letter, between doubled blanks.
UPPER = " [^ a-z]*[A-Z]{2}[^ a-z]* "
JAVA_UPPER = " (?=[^ a-z]++ )[^ ]*?[A-Z]{2}[^ ]*+ "
NO_WORD = r"[^0-9A-Za-z_\x{80}-\x{10FFFF}]+"
#: A stop word between the blanks that NO_WORD is replaced by.
STOPS = " (?:" + "|".join(dict.fromkeys(STOP_WORDS)) + ") "


def _blocks(text: Column) -> dict[str, Column]:
    out = {k: F.regexp_count(text, F.lit(p)) for k, p in JAVA.items()}
    out["chars"] = F.length(text)
    out["word_chars"] = F.length(F.regexp_replace(text, r"\s+", ""))
    out["uppers"] = F.regexp_count(F.concat(F.lit(" "), F.regexp_replace(text, r"\s+", "  "), F.lit(" ")), F.lit(JAVA_UPPER))
    out["stops"] = F.size(F.filter(F.split(F.lower(text), NO_WORD), lambda x: x.isin(*dict.fromkeys(STOP_WORDS))))
    out["distinct"] = F.size(F.array_distinct(F.filter(F.split(text, r"[ \n]"), lambda x: x != "")))
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    out["repeats"] = F.size(lines) - F.size(F.array_distinct(lines))
    return out


def metrics(text: Column) -> dict[str, Column]:
    """Each metric as a column; of a null text they are those of an empty one."""
    b = _blocks(F.coalesce(text, F.lit("")))
    return {k: b[top] if not bottom else F.when(b[bottom] > 0, b[top] / b[bottom]).otherwise(F.lit(0.0)) for k, (top, bottom) in RATIOS.items()}


def _breaks(m: dict[str, Column], metric: str, least: float | None, most: float | None, words: int) -> Column:
    value = m[metric]
    low = value < F.lit(float(least)) if least is not None else F.lit(False)
    out = low | (value > F.lit(float(most))) if most is not None else low
    return out & (m["n_words"] >= words) if words else out


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """(doc_id, the metrics, broken, keep): broken names the rules that the text breaks, joined by commas in their order.

    A null or empty text counts as one without words: the rules decide. Ids may be null or repeat; each
    row has its own. A value equal to a bound satisfies the rule. An empty table gives no rows. Other columns
    are not read. Texts are read whole, however long: each metric takes time in proportion to the text.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    m = raw.select("doc_id", *[c.alias(k) for k, c in metrics(F.col("text")).items()])
    have = {k: F.col(k) for k in RATIOS}
    broken = [F.when(_breaks(have, *rest), F.lit(name)) for name, *rest in rules]
    return m.withColumn("broken", F.concat_ws(",", *broken)).withColumn("keep", F.col("broken") == "")


def kept(docs: DataFrame, text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """The rows of docs that break no rule (see assess()), all their columns under their names.

    A null or empty text is one without words, which too_short drops; ids are not read, repeated rows share their
    fate, and an empty table stays empty.
    """
    (name,) = fresh(docs, "m")
    held = docs.withColumn(name, F.struct(*[c.alias(k) for k, c in metrics(F.col(text_col)).items()]))
    have = {k: F.col(name)[k] for k in RATIOS}
    for _, *rest in rules:
        held = held.where(~_breaks(have, *rest))
    return held.drop(name)


def sql(table: str = "documents", rules: tuple = RULES) -> str:
    """assess() in DuckDB's SQL, rounded to 6 places."""
    count = lambda p, t="text": f"len(regexp_extract_all({t}, '{p.replace(chr(39), chr(39) * 2)}'))"
    blocks = {k: count(p) for k, p in PATTERNS.items()}
    blocks["chars"] = "length(text)"
    blocks["word_chars"] = r"length(regexp_replace(text, '\s+', '', 'g'))"
    blocks["uppers"] = count(UPPER, r"(' ' || regexp_replace(text, '\s+', '  ', 'g') || ' ')")
    blocks["stops"] = count(STOPS, f"(' ' || regexp_replace(lower(text), '{NO_WORD}', '  ', 'g') || ' ')")
    blocks["distinct"] = r"len(list_distinct(list_filter(regexp_split_to_array(text, '[ \n]'), lambda x: x <> '')))"
    lines = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
    blocks["repeats"] = f"len({lines}) - len(list_distinct({lines}))"
    b = ", ".join(f"{v} AS b_{k}" for k, v in blocks.items())
    m = ", ".join(f"b_{t}::INTEGER AS {k}" if not d else f"CASE WHEN b_{d} > 0 THEN b_{t} / b_{d} ELSE 0.0::DOUBLE END AS {k}" for k, (t, d) in RATIOS.items())
    bad = []
    for name, metric, least, most, words in rules:
        tests = [f"{metric} {sign} {float(x)}::DOUBLE" for sign, x in (("<", least), (">", most)) if x is not None]
        bad.append(f"CASE WHEN ({' OR '.join(tests)}) AND n_words >= {words} THEN '{name}' END")
    show = ", ".join(k if not d else f"round({k}, 6) AS {k}" for k, (_, d) in RATIOS.items())
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}), b AS (SELECT doc_id, {b} FROM t), m AS (SELECT doc_id, {m} FROM b),
r AS (SELECT *, concat_ws(',', {", ".join(bad)}) AS broken FROM m)
SELECT doc_id, {show}, broken, broken = '' AS keep FROM r"""
