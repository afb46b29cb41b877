"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefold.llm import ann, lm, mixing, packing, pii, quality, secrets, sharding, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    count = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    joined = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    return found.select(
        "doc_id",
        *count,
        F.sha2(F.expr(joined.format("filter(spans, s -> s.base)")), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
        F.expr("cast(size(filter(spans, s -> not s.base)) as bigint)").alias("n_added"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.report(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    shown = F.expr("concat_ws(',', transform(findings, c -> concat_ws(':', c.at, coalesce(length(c.value), 0), round(c.score, 3))))")
    return found.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"), shown.alias("findings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(_table(spark, sf_dir, "documents"), capacity=2048)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


#: Domains are languages; the labelled table names documents whose language is known.
MIX_TARGETS = {"de": 0.15, "en": 0.55, "es": 0.12, "fr": 0.18}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = mixing.train(docs, MIX_TARGETS, domain="lang", known=_table(spark, sf_dir, "labels"))
    docs = docs.select("doc_id", "text")
    out = mixing.with_rates(docs, mixing.balance(docs, model, MIX_TARGETS))
    return out.select("row.doc_id", F.col("tokens").alias("n_tokens"), "domain", "rate", "copies")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = lm.held_out("doc_id", 7, 2)
    return lm.score(docs, ~out).select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~lm.held_out("id", 3, 1))
    out = toxicity.scores(docs, model)
    return out.select("doc_id", lm.held_out("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def _quality_sql() -> str:
    stops = ", ".join(f"'{w}', '{w.capitalize()}'" for w in dict.fromkeys(quality.STOP_WORDS))
    out = []
    for r in quality.RULES:
        bad = [f"{r.metric} < {r.lowest}::double"] * (r.lowest is not None) + [f"{r.metric} > {r.highest}::double"] * (r.highest is not None)
        out.append(f"(({' or '.join(bad)}) and n_words >= {r.from_words})")
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
g as (select doc_id, unnest(range(1, len(w) - 3)) as i, w from w where len(w) >= 5),
r as (select doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') as s from g),
again as (select doc_id, i from r qualify count(*) over (partition by doc_id, s) > 1),
cov as (select doc_id, count(distinct i + k) as n from again, range(5) q(k) group by doc_id),
c as (select w.doc_id, len(w)::bigint as n_words,
        length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(l)::bigint as n_lines,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
        len(list_filter(w, lambda x: x in ({stops})))::bigint as n_stop
      from w left join cov on w.doc_id = cov.doc_id),
q as (select *, case when n_words = 0 then 0 else word_chars::double / n_words end as mean_word,
        case when n_words = 0 then 0 else n_symbols::double / n_words end as symbol_ratio,
        case when n_words = 0 then 0 else n_stop::double / n_words end as stop_ratio,
        case when n_lines = 0 then 0 else n_dup_lines::double / n_lines end as dup_line_ratio,
        case when n_lines = 0 then 0 else n_words::double / n_lines end as line_words,
        (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and not ({" or ".join(out)})) as kept from q"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_simhash": op1_simhash, "op2_ann_search": op2_ann_search, "op3_pii_crf": op3_pii_crf, "op4_sharding": op4_sharding, "op5_quality_rules": op5_quality_rules, "op6_secret_scan": op6_secret_scan, "op7_best_fit_packing": op7_best_fit_packing, "op8_mixing": op8_mixing, "op9_lm_scores": op9_lm_scores, "op10_toxicity_pu": op10_toxicity_pu}
ORACLES: dict[str, str] = {"op5_quality_rules": _quality_sql()}
