"""A training corpus from raw documents, stage by stage.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; all columns that
a stage does not decide on pass through, whatever their names.

1. language_id: documents in which no language is found (null or empty text, no
   letter, or a score below ``LEAST_SCORE``) go. The network learns from the
   labelled rows.
2. line_dedup: three-line windows that occurred before are removed; documents of
   which nothing is left go.
3. near_duplicates: of documents linked by word shingles the one with the
   smallest id stays (null ids last, then the first as stored). Every row is judged by its own
   text, so different texts under one id stay, and copies under a null id go.
4. decontamination: documents with a benchmark window go.
5. mixing: the documents of the mix by source, by the labels' quality, with
   ``size``, ``source_size``, ``target``, ``repeats`` and ``taken``; those the mix
   does not take go.

Texts that change keep their row; a column ``n_chars`` then holds the new length.
Empty tables pass through empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from wardbook.llm.decontaminate import contamination
from wardbook.llm.frames import table
from wardbook.llm.jaccard_join import similar_documents
from wardbook.llm.language_id import fit, identify
from wardbook.llm.line_dedup import dedup_lines
from wardbook.llm.mixing import mix_sources, with_quality, word_count
from wardbook.session import cut_lineage

#: a text that the network finds no more like one of the four languages than like the others
LEAST_SCORE = 0.3


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same columns under names that no result column has, and the name of each."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(df: DataFrame, names: dict[str, str], **replaced: Column) -> DataFrame:
    return df.select(*[replaced.get(c, F.col(n)).alias(c) for c, n in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs)
    rows, names = _numbered(docs)
    found = identify(rows, model, text=names["text"])
    return _named(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _numbered(docs)
    done = dedup_lines(rows, doc_id=names["doc_id"], text=names["text"])
    changed, text = F.col("n_removed") > 0, F.col(names["text"])
    new = {}
    if "n_chars" in names:
        old = F.col(names["n_chars"])
        new["n_chars"] = F.when(changed, F.length(text)).otherwise(old).cast(docs.schema["n_chars"].dataType)
    return _named(done.where(~changed | text.rlike(r"[^\x09-\x0D\x20]")), names, **new)


def _placed(docs: DataFrame) -> DataFrame | None:
    """``docs`` with ``row``, a number that each read sees again: a row's file, in the order of their
    names, and its place in it. None if the rows are not those of stored files, one by one."""
    try:
        place = docs.select("*", docs.metadataColumn("_metadata")["file_path"].alias("__file"), docs.metadataColumn("_metadata")["row_index"].alias("__at"))
    except AnalysisException:
        return None
    files = place.select("__file").distinct().withColumn("__no", F.row_number().over(W.orderBy("__file")) - 1)
    files = F.broadcast(cut_lineage(files))
    # a file has fewer than 2^40 rows
    placed = place.join(files, "__file").select(*[f"`{c}`" for c in docs.columns], (F.shiftleft(F.col("__no").cast("long"), 40) + F.col("__at")).alias("row"))
    once = placed.groupBy("row").count().where("count > 1 OR row IS NULL").isEmpty()
    return placed if once else None


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _numbered(docs)
    # every row is judged by its own text; each read sees the same numbers: places in the files
    # that hold the documents, or, if they are no stored table, numbers that are stored with them
    rows = _placed(rows)
    if rows is None:
        rows = cut_lineage(_numbered(docs)[0].withColumn("row", F.monotonically_increasing_id()))
    found = similar_documents(rows.select("row", F.col(names["text"]).alias("text")), doc_id="row").select(F.col("doc_id").alias("row"), "component_id")
    groups = cut_lineage(found.join(found.where("component_id != row").select("component_id").distinct(), "component_id", "left_semi"))
    key = F.col(names["doc_id"])
    order = F.struct(key.isNull().alias("unknown"), key.alias("id"), "row")
    stays = groups.join(rows.select("row", names["doc_id"]), "row").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    return _named(rows.join(groups.join(stays, "row", "left_anti").select("row"), "row", "left_anti"), names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _numbered(docs)
    found = contamination(rows, table(spark, sf_dir, "benchmark"), text=names["text"])
    return _named(found.where(F.size("spans") == 0), names)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _numbered(docs)
    sized = rows.withColumn("size", word_count(F.col(names["text"])))
    labelled = with_quality(sized, table(spark, sf_dir, "labels"), doc_id=names["doc_id"])
    mixed = mix_sources(labelled, doc_id=names["doc_id"], source=names["source"], quality="__quality", size="size").where("taken > 0")
    own = ["size", "source_size", "target", "repeats", "taken"]
    return mixed.select(*[F.col(n).alias(c) for c, n in names.items() if c.lower() not in own], *own)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: SQL can't express the trained network of the first stage; the tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each leaves is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut_lineage(docs), sf_dir)
    return docs
