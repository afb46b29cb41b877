"""Text, CSV, INI and JSON operators."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


FENCE = "```"
PAIR = r"(?s)^(.*?)```(.*?)```(.{0,3})(.*)$"
LINK = r"(?s)^([^\[]*)\[([^\]]*)\]\([^)]*\)"


def without_fences(text: str) -> str:
    """SQL: fence marks removed by pairs; the three characters after a pair are not looked at again."""
    step = f"if(s.rest rlike {_q(PAIR)}, struct(concat(s.done, regexp_replace(s.rest, {_q(PAIR)}, '$1$2$3')) as done, regexp_extract(s.rest, {_q(PAIR)}, 4) as rest), s)"
    pairs = f"aggregate(sequence(1, greatest(1, regexp_count({text}, '{FENCE}'))), struct('' as done, {text} as rest), (s, i) -> {step}, s -> concat(s.done, regexp_replace(s.rest, '(?s)^(.*?){FENCE}', '$1')))"
    return f"if(instr({text}, '{FENCE}') > 0, {pairs}, {text})"


def strip_markdown(text: str) -> Column:
    """Markdown marks removed line by line; every line ends with LF. All in built-in expressions."""
    line = f"translate(regexp_replace(l, {_q('^#+ ')}, ''), '*_', '')"
    linked = f"transform(array({line}), l -> if(instr(l, '[') > 0, aggregate(sequence(1, length(l) - length(replace(l, '[', ''))), l, (x, i) -> regexp_replace(x, {_q(LINK)}, '$1$2')), l))[0]"
    listed = f"regexp_replace({linked}, {_q('(?s)^- (.)')}, '$1')"
    body = without_fences(text)
    lines = f"split(regexp_replace({body}, {_q(chr(92) + 'n' + chr(92) + 'z')}, ''), {_q(chr(92) + 'n')}, -1)"
    return F.expr(f"if({text} = '', '', concat(array_join(transform({lines}, l -> {listed}), chr(10)), chr(10)))")


def document(text: str, source: str, target: str) -> Column:
    """A document in another format: only markdown to text changes anything."""
    return strip_markdown(text) if (source, target) == ("md", "txt") else F.col(text)


def csv_field(field: Column, delimiter: str = ",") -> Column:
    risky = field.contains(delimiter) | field.contains('"') | field.contains("\n") | field.contains("\r")
    return F.when(risky, F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(field)


def csv_line(fields: list[Column], delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[csv_field(f, delimiter) for f in fields])


def csv_fields(line: str, delimiter: str = ",") -> Column:
    """A record's fields. Quotes open only at a field's start; what follows a closing quote is kept; an open quote takes the rest."""
    d = "\\" + delimiter if delimiter in ";,|" else delimiter
    quoted = r'\r*"[^"]*+(?:""[^"]*+)*+'
    raw = rf'(?s)(?:{quoted}(?:"[^{d}]*)?|[^{d}]*)(?:{d}|$)'
    inner, rest = rf'(?s)^\r*"([^"]*+(?:""[^"]*+)*+)', rf'(?s)^{quoted}"(.*)$'
    parts = f"regexp_extract_all(concat({line}, {_q(delimiter)}), {_q(raw)}, 0)"
    cut = f"transform(slice({parts}, 1, size({parts}) - 1), x -> left(x, length(x) - 1))"
    value = f"if(x rlike {_q('^' + chr(92) + 'r*' + chr(34))}, concat(replace(regexp_extract(x, {_q(inner)}, 1), '\"\"', '\"'), replace(regexp_extract(x, {_q(rest)}, 1), chr(13), '')), replace(x, chr(13), ''))"
    return F.expr(f"transform({cut}, x -> {value})")


def csv_records(df: DataFrame, content: str, delimiter: str = ",") -> DataFrame:
    """(row_no, fields) of each line of a text column, with df's other columns. Lines split before quotes are looked at."""
    rest = [c for c in df.columns if c != content]
    lines = df.where(F.length(content) > 0).select(*rest, F.posexplode(F.split(F.regexp_replace(content, r"\n\z", ""), "\n")).alias("row_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"\r\z", ""))
    return lines.withColumn("fields", csv_fields("line", delimiter)).drop("line")


def ini_entries(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, section, name, value) of INI texts: the last value of a name wins; the section of globals is empty."""
    trim = lambda c: F.expr(f"trim(both ' \\t\\r\\n' from {c})")
    lines = df.select(key, F.posexplode(F.split(F.col(content), "\n")).alias("no", "l")).withColumn("l", trim("l"))
    lines = lines.where("l <> '' and not l rlike '^[;#]'")
    head = F.when(F.col("l").rlike(r"^\[[^\]]*\]"), F.regexp_extract("l", r"^\[([^\]]*)\]", 1))
    carried = F.last(trim("head"), ignorenulls=True).over(Window.partitionBy(key).orderBy("no"))
    lines = lines.withColumn("head", head).withColumn("section", F.coalesce(carried, F.lit("")))
    pairs = lines.where("not l like '[%' and instr(l, '=') > 0").withColumn("name", trim("substring_index(l, '=', 1)")).withColumn("value", trim("substring(l, instr(l, '=') + 1)"))
    bare = F.when(F.col("value").rlike(r"""(?s)^("(.*)"|'(.*)')$"""), F.expr("substring(value, 2, length(value) - 2)")).otherwise(F.col("value"))
    return pairs.groupBy(key, "section", "name").agg(F.max_by(bare, "no").alias("value"))


def ini_text(entries: DataFrame, key: str) -> DataFrame:
    """(key, content): globals, then sections, names in byte order."""
    parts = entries.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("kv"))
    body = F.expr("concat(if(section = '', '', concat('[', section, ']\\n')), array_join(transform(kv, x -> concat(x.name, ' = ', x.value, '\\n')), ''))")
    blocks = parts.select(key, F.struct("section", body.alias("body")).alias("b"))
    return blocks.groupBy(key).agg(F.expr("array_join(transform(array_sort(collect_list(b)), x -> x.body), '\\n')").alias("content"))


def canonical_json(text: str, pretty: bool = False) -> str | None:
    """Sorted keys, doubles only, whole numbers below 1e15 without a point; null if it does not parse. Text after the value is ignored."""

    def number(v: float) -> str:
        if math.isinf(v):
            raise ValueError("number out of range")
        return str(int(v)) if v == math.floor(v) and abs(v) < 1e15 else f"{v:.15g}"

    def put(v, depth: int) -> str:
        gap, end = ("\n" + "  " * (depth + 1), "\n" + "  " * depth) if pretty else ("", "")
        if v is None or isinstance(v, bool):
            return {None: "null", True: "true", False: "false"}[v]
        if isinstance(v, float):
            return number(v)
        if isinstance(v, str):
            return json.dumps(v, ensure_ascii=False)
        if isinstance(v, list):
            return "[" + ",".join(gap + put(x, depth + 1) for x in v) + (end if v else "") + "]"
        colon = ": " if pretty else ":"
        return "{" + ",".join(gap + json.dumps(k, ensure_ascii=False) + colon + put(v[k], depth + 1) for k in sorted(v, key=lambda k: k.encode("utf-8", "surrogatepass"))) + (end if v else "") + "}"

    def refuse(name: str):
        raise ValueError(name)

    try:
        value, _ = json.JSONDecoder(strict=False, parse_int=float, parse_constant=refuse).raw_decode(text.lstrip(" \t\r\n"))
        return put(value, 0)
    except (ValueError, RecursionError):
        return None


def json_canonical(pretty: bool = False):
    """An Arrow-batched column function."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else canonical_json(x, pretty))

    return run
