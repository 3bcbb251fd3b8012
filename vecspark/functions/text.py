"""Text functions: words, paragraphs, chunks, tokens, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_WORDS = "cast(array() as array<string>)"


def check_window(max_words: int, overlap: int) -> None:
    if max_words < 1 or overlap < 0 or overlap >= max_words:
        raise ValueError("max_words must be positive and overlap in [0, max_words)")


def words(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def paragraphs(text) -> Column:
    """Word lists of the parts between blank lines, without empty ones."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)\n\s*\n"), words), lambda w: F.size(w) > 0)


def windows(word_list, max_words: int, overlap: int) -> Column:
    """Overlapping windows of a word list; the last one reaches its end."""
    step, n = max_words - overlap, F.size(word_list)
    last = F.when(n > max_words, F.ceil((n - max_words) / F.lit(step)).cast("int") * step).otherwise(0)
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: F.slice(word_list, s + 1, max_words))


def packed_chunks(text, max_words: int, overlap: int) -> Column:
    """Chunks of at most ``max_words`` words: paragraphs are packed greedily, a flushed chunk hands its tail of at
    most ``overlap`` words to the next, and a paragraph that is too long is cut in overlapping windows."""
    check_window(max_words, overlap)
    none = F.expr(NO_WORDS)
    start = F.struct(none.alias("cur"), F.expr(f"cast(array() as array<array<string>>)").alias("out"))

    def flush(a):
        return F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"])

    def step(a, w):
        long, full = F.size(w) > max_words, (F.size(a["cur"]) > 0) & (F.size(a["cur"]) + F.size(w) > max_words)
        tail = F.least(F.lit(overlap), max_words - F.size(w), F.size(a["cur"]))
        carried = F.when(tail > 0, F.slice(a["cur"], F.size(a["cur"]) - tail + 1, tail)).otherwise(none)
        cur = F.when(long, none).when(full, F.concat(carried, w)).otherwise(F.concat(a["cur"], w))
        out = F.when(long, F.concat(flush(a), windows(w, max_words, overlap))).when(full, flush(a)).otherwise(a["out"])
        return F.struct(cur.alias("cur"), out.alias("out"))

    return F.aggregate(paragraphs(text), start, step, flush)


def tokens(text) -> Column:
    """Lower-case ASCII letter and digit runs."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def citation_numbers(text) -> Column:
    """The numbers in ``[n]`` marks, first mention first, once each."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("long")), lambda x: x.isNotNull()))


def title_of(file_name) -> Column:
    return F.regexp_replace(F.regexp_replace(F.col(file_name), r"\.[^.]*$", ""), "_", " ")


def stripped(text) -> Column:
    """Without white space of any kind at either end."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def document_problems(title, text, max_words="max_words", overlap="overlap", max_title: int = 200, max_text: int = 1_000_000) -> Column:
    """Names of a record's broken limits, comma-separated; an empty string for a valid record. A ``text`` of None isn't judged."""
    t = stripped(title)
    rules = {
        "title": (F.length(t) < 1) | (F.length(t) > max_title),
        "text": F.lit(False) if text is None else (F.length(stripped(text)) < 1) | (F.length(text) > max_text),
        "max_words": ~F.coalesce(F.col(max_words).between(1, 1000), F.lit(False)),
        "overlap": ~F.coalesce(F.col(overlap).between(0, 999) & (F.col(overlap) < F.col(max_words)), F.lit(False)),
    }
    return F.concat_ws(",", *[F.when(bad, name) for name, bad in rules.items()])


def query_problems(question, k="k", ef_search="ef_search", max_question: int = 2000) -> Column:
    n = F.length(stripped(question))
    rules = {"question": (n < 1) | (n > max_question), "k": ~F.coalesce(F.col(k).between(1, 50), F.lit(False)), "ef_search": ~F.coalesce(F.col(ef_search).between(1, 2000), F.lit(False))}
    return F.concat_ws(",", *[F.when(bad, name) for name, bad in rules.items()])
