"""Chunking, retrieval with a score floor, sources, answers and citations."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embed import Embedder, HashedEmbedder, embedded_matrix, with_embedding
from ..functions.text import citation_numbers, packed_chunks
from ..functions.vectors import score
from ..sources.storage import written
from .ids import dense_ids
from .knn import knn

MAX_WORDS, OVERLAP, FLOOR = 180, 40, 0.09
NO_DOCUMENTS = "No documents match this question."
REFUSED = "The model gave no answer."


def chunk_documents(docs: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP, text_col: str = "text") -> DataFrame:
    """``(doc_id, ordinal, n_words, text)``: the chunks of each document, in order."""
    rows = docs.select("doc_id", F.posexplode(packed_chunks(text_col, max_words, overlap)).alias("ordinal", "w"))
    return rows.select("doc_id", "ordinal", F.size("w").alias("n_words"), F.array_join("w", " ").alias("text"))


def numbered_chunks(docs: DataFrame, **options) -> DataFrame:
    """The chunks of each document with a dense ``chunk_id`` by document and ordinal. Documents are dealt by ranges before
    they are chunked: finding the ranges reads rows twice, and that costs less than chunking them twice. Their number is
    stated, as small partitions would be joined to fewer than there are cores."""
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dense_ids(chunk_documents(docs.select("doc_id", "text").repartitionByRange(ranges, "doc_id"), **options), ["doc_id", "ordinal"], "chunk_id", dealt=True)


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = 5, floor: float | None = FLOOR, embedder: Embedder | None = None, metric: str = "cosine", vectors: DataFrame | None = None, search: Callable | None = None) -> DataFrame:
    """``(qid, rank, chunk_id, doc_id, doc_title, ordinal, score, text)``: hits at or above the floor, which comes before rounding.

    ``chunks`` without a ``chunk_id`` get dense ones by document and ordinal, and without a ``doc_title`` the id as title.
    ``vectors`` (chunk_id, embedding) are stored vectors of the chunks, which then aren't embedded again; ``search``
    (questions' vectors, k) may give ``(qid, vec_id, distance, rank)`` from an index in place of the exact search.
    """
    embedder = embedder or HashedEmbedder()
    if "chunk_id" not in chunks.columns:
        chunks = dense_ids(chunks, ["doc_id", "ordinal"], "chunk_id")
    title = F.col("doc_title") if "doc_title" in chunks.columns else F.col("doc_id").cast("string")
    keyed = chunks.select(F.col("chunk_id").alias("vec_id"), "doc_id", title.alias("doc_title"), "ordinal", "text")
    asked = with_embedding(questions.select("qid", "question"), "question", embedder).select("qid", "embedding")
    if search is None:
        if vectors is None:
            texts = keyed.select("vec_id", F.coalesce("text", F.lit("")).alias("text"))
            hits = knn(texts, asked, k, metric, vec_col="text", query_col="embedding", reading=lambda column: embedded_matrix(column, embedder))
        else:
            hits = knn(vectors.select(F.col("chunk_id").alias("vec_id"), "embedding"), asked, k, metric)
    else:
        hits = search(asked, k)
    hits = hits.withColumn("score", score("distance", metric))
    if floor is not None:
        hits = hits.where(F.col("score") >= floor)
    hits = written(hits, "hits")  # k rows a question, so that the chunks' texts need no shuffle to meet them
    return hits.join(keyed, "vec_id").select("qid", "rank", F.col("vec_id").alias("chunk_id"), "doc_id", "doc_title", "ordinal", F.round("score", 4).alias("score"), "text")


def format_sources(hits: DataFrame) -> DataFrame:
    """``(qid, context)``: numbered sources with their titles, blank lines between them."""
    title = F.col("doc_title") if "doc_title" in hits.columns else F.col("doc_id").cast("string")
    one = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (source: "), title, F.lit(")\n"), F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("rank", one.alias("s"))))
    return hits.groupBy("qid").agg(parts.alias("p")).select("qid", F.array_join(F.transform("p", lambda x: x["s"]), "\n\n").alias("context"))


def extractive_answers(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """``(qid, answer, model)``: the best source quoted whole and cited; a fixed text where nothing was found."""
    top = hits.where("rank = 1").select("qid", F.concat(F.lit("Based on the most relevant passage: "), F.col("text"), F.lit(" [1]")).alias("a"))
    return questions.select("qid").join(top, "qid", "left").select("qid", F.coalesce("a", F.lit(NO_DOCUMENTS)).alias("answer"), F.lit("mock").alias("model"))


def generated_answers(generate: Callable[[str, str], str | None], name: str, timeout: float = 30.0) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Answers of ``generate(question, context)`` for ``ask``; questions without sources get the fixed text, an empty
    answer counts as a refusal, and one that takes more than ``timeout`` seconds fails the job: nothing stands in for it."""

    def answers(hits: DataFrame, questions: DataFrame) -> DataFrame:
        rows = questions.select("qid", "question").join(format_sources(hits), "qid", "left")

        def run(batches):
            from concurrent.futures import ThreadPoolExecutor

            for b in batches:
                out = []
                for question, context in zip(b.column("question").to_pylist(), b.column("context").to_pylist()):
                    if context is None:
                        out.append(NO_DOCUMENTS)
                        continue
                    pool = ThreadPoolExecutor(1)
                    try:
                        out.append((pool.submit(generate, question, context).result(timeout) or "").strip() or REFUSED)
                    finally:
                        pool.shutdown(wait=False)
                yield pa.RecordBatch.from_arrays([b.column("qid"), pa.array(out, pa.string()), pa.array([name] * len(out), pa.string())], ["qid", "answer", "model"])

        return rows.select(F.col("qid").cast("long").alias("qid"), "question", "context").mapInArrow(run, "qid long, answer string, model string")

    return answers


def cited_sources(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """``(qid, position, doc_id, ordinal)`` of the sources that answers cite, in the order of first mention."""
    marks = answers.select("qid", F.posexplode(citation_numbers("answer")).alias("pos", "n"))
    found = marks.join(hits.select("qid", F.col("rank").cast("long").alias("n"), "doc_id", "ordinal"), ["qid", "n"])
    w = Window.partitionBy("qid").orderBy("pos")
    return found.select("qid", F.row_number().over(w).alias("position"), "doc_id", "ordinal")


def ask(chunks: DataFrame, questions: DataFrame, k: int = 5, floor: float | None = FLOOR, embedder: Embedder | None = None, generator=None, **options) -> DataFrame:
    """Question, answer, model and nested sources with their ``cited`` flags.

    ``generator(hits, questions)`` may give ``(qid, answer, model)`` in place of the extractive answers.
    """
    hits = written(retrieve(chunks, questions, k, floor, embedder, **options), "sources")  # used four times below
    answers = (generator or extractive_answers)(hits, questions)
    cited = cited_sources(answers, hits).select("qid", "doc_id", "ordinal", F.lit(True).alias("c"))
    src = hits.join(cited, ["qid", "doc_id", "ordinal"], "left")
    src = src.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "doc_title", "ordinal", "score", "text", F.coalesce("c", F.lit(False)).alias("cited")))).alias("sources"))
    return questions.join(answers, "qid").join(src, "qid", "left")
