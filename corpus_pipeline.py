"""A training corpus from documents, in stages; each is an operator of leadspark.llm.

Each stage works on all that the one before kept. A text that loses all its lines stays
as an empty document: only the stages that judge documents drop them. The input of a stage
is a written table: a stage begins with the removal of what earlier stages (and nothing
else) have settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C
from leadspark.llm import op3_line_dedup as op3
from leadspark.llm import op4_decontaminate as op4
from leadspark.llm import op5_sentencepiece as op5
from leadspark.llm import op6_ngram_join as op6
from leadspark.llm import op9_quality as op9


def _named(docs: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """(d, th, text, row): the keys of the operators, and the row (without some columns) as one
    column, so that no column of the input meets one of theirs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.struct(*(F.col(f"`{n}`") for n in docs.columns if n not in without))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"), whole.alias("row"))


@C.stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"))
    return op9.judge(rows, ["row"]).where("kept").select("row.*")


@C.stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines the first stays; n_chars is counted anew."""
    out = op3.without_lines(_named(docs, ("text",)), op3.lines_to_drop(C.keyed(docs)))
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*((new[n] if n in new else F.col("row")[n]).alias(n) for n in docs.columns))


@C.stage
def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest (doc_id, text hash) stays."""
    first = C.settle(op6.ngram_classes(C.keyed(docs)).where("d = class and th = class_th").select("d", "th", "n_links"))
    rows = _named(docs)
    linked = first.where("n_links > 0")
    if linked.groupBy("d", "th").count().where("count > 1").limit(1).count():
        # Only repeats with words are copies; texts without words are classes of their own.
        once = rows.join(linked.select("d", "th").distinct(), ["d", "th"], "left_semi").dropDuplicates(["d", "th"])
        out = once.unionByName(rows.join(first.where("n_links = 0").select("d", "th").distinct(), ["d", "th"], "left_semi"))
    else:
        out = rows.join(first.select("d", "th").distinct(), ["d", "th"], "left_semi")
    return out.select("row.*")


@C.stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = op4.contaminated(docs, C.read(spark, sf_dir, "benchmark")).select("d", "th").distinct()
    return _named(docs).join(found, ["d", "th"], "left_anti").select("row.*")


@C.stage
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, exact: the ids, decoded again, give the text."""
    return op5.round_trip(docs, op5.model_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            out = C.settle(out)
            if i:
                C.forget(docs)
        docs = out
    return docs
