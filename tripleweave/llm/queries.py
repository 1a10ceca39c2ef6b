"""One query per operator of this package, each over its whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.llm import (
    chat_tree,
    chosen_path,
    decontaminate,
    lexical,
    licenses,
    periods,
    pieces,
    quality,
    simhash,
    suffix_dedup,
    toxicity,
    urls,
    warc,
)
from tripleweave.session import cut, tune


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark, sf_dir):
    pages = _table(tune(spark), sf_dir, "pages").select("page_id", "url", "html")
    records = warc.derive(warc.responses(pages))
    return records.select(*(c for c in records.columns if c != "block"), F.col("block").cast("string").alias("content"))


#: A conversation of control strings that every format must survive.
HOSTILE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op2_chat_prefix_tree(spark, sf_dir, vocabulary=VOCABULARY):
    turns = _table(tune(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(HOSTILE, "conv_id bigint, turn bigint, role string, text string"))
    ranks = chat_tree.vocabulary(spark, vocabulary)
    read = chat_tree.read_back(*chat_tree.forest(turns, ranks), ranks)
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_quality_ledger(spark, sf_dir):
    book = quality.ledger(_table(tune(spark), sf_dir, "documents"))
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.CURRENT).alias("kept"),
        "failed",
    )


def quality_ablations(spark, sf_dir):
    """What each rule of each policy does: documents failing it, failing only it, and kept without it."""
    book = cut(quality.ledger(_table(tune(spark), sf_dir, "documents")).select("failed"))
    found = [quality.ablations(book, policy) for policy in quality.POLICIES]
    return reduce(DataFrame.unionByName, found)


def op4_license_rules(spark, sf_dir):
    """Licences with their first places, and the identifiers in order, as text."""
    found = licenses.recognise(_table(tune(spark), sf_dir, "documents"))
    one = lambda x: F.concat_ws(":", x["license"], x["first_place"], x["n_places"])
    hit = lambda x: F.concat_ws(":", x["place"], x["sentence"])
    return found.select(
        "doc_id",
        "n_sentences",
        F.array_join(F.transform("hits", hit), ",").alias("sentences"),
        F.array_join(F.transform("licenses", one), ",").alias("licenses"),
    )


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.scan(_table(tune(spark), sf_dir, "documents"))


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece(spark, sf_dir, model_path=MODEL):
    encoded = pieces.encode(_table(tune(spark), sf_dir, "documents"), model_path)
    return encoded.withColumn("n_ids", F.size("ids").cast("bigint"))


def op7_simhash(spark, sf_dir):
    found = simhash.near_duplicates(_table(tune(spark), sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op8_decontamination(spark, sf_dir):
    found = decontaminate.scan(_table(tune(spark), sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_url_templates(spark, sf_dir):
    """A page is labelled by the document whose number ends its path, as ``labels`` has it."""
    pages = _table(tune(spark), sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(urls.path_of(F.col("url")), r"([0-9]+)(\.[A-Za-z]+)?/?$", 1)
    numbered = pages.select("page_id", number.try_cast("bigint").alias("doc_id"))
    good = F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")
    marks = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(good)
    labels = numbered.filter("doc_id IS NOT NULL").join(marks, "doc_id").groupBy("page_id").agg(F.min("good").alias("good"))
    return urls.judge(pages, labels)


def op10_toxicity(spark, sf_dir):
    docs = _table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.with_score(docs, labels).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_chosen_path(spark, sf_dir):
    found = chosen_path.near_duplicates(_table(tune(spark), sf_dir, "documents"))
    kept = F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op12_lexical_search(spark, sf_dir):
    found = lexical.index(_table(tune(spark), sf_dir, "documents"))
    return lexical.search(found, _table(spark, sf_dir, "benchmark"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """One document in ten, by a checksum of its id, goes round in a circle from some word on."""
    sum32 = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    own = docs.select("doc_id", "text", sum32.alias("h"), F.when(sum32 % 10 == 0, words).alias("words"))
    own = own.withColumns({"g": F.floor(F.col("h") / 10), "n": F.size("words").cast("bigint")})
    own = own.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    own = own.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    circle = F.expr("concat(slice(words, 1, int(a)), slice(flatten(array_repeat(slice(words, int(a) + 1, int(p)), "
                    "int((n - a) div p + 1))), 1, int(n - a)))")  # fmt: skip
    text = F.when(F.col("a").isNotNull(), F.array_join(circle, " ")).otherwise(F.col("text"))
    return own.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark, sf_dir):
    found = periods.scan(with_planted_periods(_table(tune(spark), sf_dir, "documents")))
    one = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    ranked = F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"]))
    found = found.withColumn("top", F.array_min(ranked))
    length, period = -F.col("top.col1"), F.col("top.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("top.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", one), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries():
    """Every query of the package by name."""
    found = [
        op1_warc_derivatives,
        op2_chat_prefix_tree,
        op3_quality_ledger,
        op4_license_rules,
        op5_suffix_dedup,
        op6_sentencepiece,
        op7_simhash,
        op8_decontamination,
        op9_url_templates,
        op10_toxicity,
        op11_chosen_path,
        op12_lexical_search,
        op13_periodic_runs,
        quality_ablations,
    ]
    return {f.__name__: f for f in found}
