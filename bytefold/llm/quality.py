"""Quality rules: a threshold table compiled into one projection, without user functions.

A rule is (metric, lowest, highest, from_words): a document fails if the metric lies
outside and the text has at least `from_words` words. Every metric is a built-in
expression over the row's own text, so a report is a scan and a projection: no shuffle
and nothing held beyond one row.

Nulls: a null text counts as empty (no words, hence rejected). Ties, repeated rows and
extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on with be as at by this from or an are not have "
    "la de le et les des un une que est en du pour dans qui au par sur se pas plus avec "
    "el los las y por con su para al del lo es una "
    "der die und den von zu das mit sich ein eine ist im dem nicht als auch auf"
).split()
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5


class Rule(NamedTuple):
    metric: str
    lowest: float | None
    highest: float | None
    from_words: int = 0


RULES = (
    Rule("mean_word", 2.5, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_ratio", 0.06, None, 50),
    Rule("dup_line_ratio", None, 0.4, 20),
    Rule("line_words", 1.5, None, 20),
)


def _sql(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r").replace("\x0b", "\\u000b").replace("\f", "\\u000c")


def _let(name: str, value: str, body: str) -> str:
    """body with `name` bound to value, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


_COUNTS = {
    "n_words": "cast(size(w_) as bigint)",
    "word_chars": f"cast(length(translate(t_, '{_sql(BLANKS)}', '')) as bigint)",
    "n_symbols": f"cast(length(t_) - length(translate(t_, '{SYMBOLS}', '')) as bigint)",
    "n_lines": "cast(size(l_) as bigint)",
    "n_dup_lines": "cast(size(l_) - size(array_distinct(l_)) as bigint)",
    "n_stop": "cast(size(filter(w_, x -> x in ({stops}))) as bigint)".format(stops=", ".join(f"'{w}', '{w.capitalize()}'" for w in dict.fromkeys(STOP_WORDS))),
    "n_repeat_words": f"coalesce(aggregate(transform(p_, (p, k) -> if(k = size(p_) - 1, {WINDOW}, least({WINDOW}, p_[least(k + 1, size(p_) - 1)] - p))), 0L, (a, x) -> a + x), 0L)",
}
_RATIOS = {
    "mean_word": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_ratio": ("n_stop", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "line_words": ("n_words", "n_lines"),
}


def metrics(text: str, body: str | None = None) -> str:
    """SQL for a struct of a text's counts and ratios, or for `body` over that struct, named q_."""
    window = ", ".join(f"h_[i + {k}]" for k in range(WINDOW))
    counts = "struct(" + ", ".join(f"{v} as {k}" for k, v in _COUNTS.items()) + ")"
    whole = "struct(" + ", ".join([*(f"c_.{k} as {k}" for k in _COUNTS), *(f"if(c_.{b} = 0, 0D, cast(c_.{a} as double) / c_.{b}) as {k}" for k, (a, b) in _RATIOS.items())]) + ")"
    out = _let("c_", counts, whole if body is None else _let("q_", whole, body))
    out = _let("l_", f"filter(split(t_, '\\\\n'), x -> length(trim(both '{_sql(BLANKS)}' from x)) > 0)", out)
    out = _let("p_", "sort_array(transform(filter(s_, (x, k) -> (k > 0 and s_[greatest(k - 1, 0)].h = x.h) or (k < size(s_) - 1 and s_[least(k + 1, size(s_) - 1)].h = x.h)), x -> x.i))", out)
    # only a text in which a window occurs again is sorted
    out = _let("s_", "if(size(array_distinct(v_)) = size(v_), null, sort_array(transform(v_, (h, i) -> struct(h as h, i as i))))", out)
    out = _let("v_", f"if(size(h_) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(h_) - {WINDOW}), i -> xxhash64({window})))", out)
    out = _let("h_", "transform(w_, x -> xxhash64(x))", out)
    out = _let("w_", f"filter(split(t_, '{_sql(WORD_GAP)}'), x -> x <> '')", out)
    return _let("t_", f"coalesce({text}, '')", out)


BASE_FAILED = "(q_.n_words < 10 or 100 * q_.n_repeat_words > 20 * q_.n_words)"


def verdict(rules: Sequence[Rule] = RULES) -> str:
    """SQL over q_: true if no rule of the table is broken."""
    broken = []
    for r in rules:
        out = [f"q_.{r.metric} {sign} {float(edge)!r}D" for sign, edge in (("<", r.lowest), (">", r.highest)) if edge is not None]
        if out:
            broken.append(f"(({' or '.join(out)}) and q_.n_words >= {r.from_words})")
    return f"not ({' or '.join(broken) or 'false'})"


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """A row for each document: its counts, ratios, base_failed and kept."""
    names = [*_COUNTS, *_RATIOS]
    whole = "struct(" + ", ".join(f"q_.{n} as {n}" for n in names) + f", {BASE_FAILED} as base_failed, not {BASE_FAILED} and {verdict(rules)} as kept)"
    q = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text")).select("_id", F.expr(metrics("_text", whole)).alias("_q"))
    return q.select(F.col("_id").alias(id_col), "_q.*")


def accepted(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that pass, with all their columns as they came. One filter, evaluated once a row."""
    return docs.where(F.expr(metrics(f"cast(`{text}` as string)", f"not {BASE_FAILED} and {verdict(rules)}")))
