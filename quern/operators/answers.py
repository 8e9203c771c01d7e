"""From ranked chunks to answers: context, citations, prompts and a pluggable generator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet, trimmed

#: A source's line in the context, and the reply where nothing was found.
NO_CONTEXT = "抱歉，在已上传的文档中没有找到与您问题相关的内容。"
SYSTEM_PROMPT = "Answer only from the excerpts. Mark each statement with the number of its source, as [1]. Say so if the material does not hold the answer. Use the language of the question."


def reference(rank: Column, filename: Column, page: Column, content: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] (来源: "), filename, F.lit(", 第 "), page.cast("string"), F.lit(" 页)\n"), trimmed(content), F.lit("\n\n"))


def contexts(queries: DataFrame, hits: DataFrame, *, snippet_chars: int = 200) -> DataFrame:
    """One row for each query: qid, text, hits, context (empty without hits), citations in order of rank."""
    text = trimmed(F.col("content"))
    cited = F.struct("rank", F.col("id").alias("chunk_id"), "document_id", "filename", "page", "score", snippet(text, snippet_chars).alias("snippet"))
    built = hits.groupBy("qid").agg(
        F.count("*").alias("hits"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", reference(F.col("rank"), F.col("filename"), F.col("page"), F.col("content")).alias("r")))), lambda x: x["r"]), "").alias("context"),
        F.array_sort(F.collect_list(cited)).alias("citations"),
    )
    return queries.select("qid", "text").join(built, "qid", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "context": F.coalesce("context", F.lit(""))})


def user_prompt(query: Column, context: Column) -> Column:
    return F.concat(F.lit("资料片段:\n\n"), context, F.lit("\n\n问题: "), query)


def extractive(prompt: Column, citations: Column) -> Column:
    """A generator without a model: the best source's snippet, with its number."""
    return F.concat(F.get(citations, F.lit(0))["snippet"], F.lit(" [1]"))


def answer(queries: DataFrame, hits: DataFrame, *, generator: Callable[[Column, Column], Column] = extractive, no_context: str = NO_CONTEXT) -> DataFrame:
    """qid, answer, citations, total_chunks. The generator isn't asked where nothing was found."""
    built = contexts(queries, hits)
    reply = F.trim(generator(user_prompt(F.col("text"), F.col("context")), F.col("citations")))
    return built.select("qid", F.when(F.col("hits") == 0, F.lit(no_context)).otherwise(reply).alias("answer"), "citations", F.col("hits").alias("total_chunks"))
