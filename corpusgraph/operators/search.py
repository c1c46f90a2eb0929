"""Search for many queries at once: by vector, by keyword, and both fused by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.operators.nearest import nearest
from corpusgraph.sources.files import stored

SNIPPET_CHARS = 1000


def _wanted(docs: DataFrame, doc_type: str | None, document_tags: DataFrame | None, tags: list[str] | None) -> DataFrame:
    if doc_type is not None:
        docs = docs.where(F.col("doc_type") == doc_type)
    if tags:
        docs = docs.join(document_tags.where(F.col("tag").isin(*tags)).select(F.col("document_id").alias("id")).distinct(), "id", "left_semi")
    return docs


def vector_search(chunks: DataFrame, docs: DataFrame, queries: DataFrame, k: int, doc_type: str | None = None, document_tags: DataFrame | None = None, tags: list[str] | None = None) -> DataFrame:
    """(query_id, rank, document_id, chunk_index, distance, snippet): the k chunks nearest to each query.

    chunks: document_id, chunk_index, content, embedding; queries: query_id, embedding; docs: id, doc_type. Chunks without
    an embedding come last. Ties go by document, then chunk.
    """
    wanted = _wanted(docs, doc_type, document_tags, tags).select(F.col("id").alias("document_id"))
    own = chunks.join(wanted, "document_id", "left_semi")
    targets = own.select(F.struct("document_id", "chunk_index").alias("id"), F.col("embedding").alias("vector"))
    hits = nearest(queries.select(F.col("query_id").alias("id"), F.col("embedding").alias("vector")), targets, k)
    hits = hits.select(F.col("source").alias("query_id"), "rank", "target.document_id", "target.chunk_index", "distance")
    text = own.select("document_id", "chunk_index", F.substring("content", 1, SNIPPET_CHARS).alias("snippet"))
    return hits.join(text, ["document_id", "chunk_index"]).select("query_id", "rank", "document_id", "chunk_index", "distance", "snippet")


def tokens(c: Column, tokenizer: str = "simple") -> Column:
    """Runs of letters and digits, lower-cased; `cjk_bigram` cuts runs of Han characters into overlapping pairs."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    if tokenizer == "simple":
        return words
    pairs = lambda w: F.when(w.rlike(r"^\p{IsHan}{2,}$"), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))).otherwise(F.array(w))
    spaced = F.regexp_replace(F.lower(c), r"(\p{IsHan}+)", " $1 ")
    return F.flatten(F.transform(F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda t: t != ""), pairs))


def asked_tokens(queries: DataFrame, tokenizer: str = "simple") -> DataFrame:
    """(query_id, token, need): the different tokens of each query (query_id, query), and their number."""
    own = queries.select("query_id", F.array_distinct(tokens(F.col("query"), tokenizer)).alias("t"))
    return own.select("query_id", F.explode("t").alias("token"), F.size("t").alias("need"))


def document_tokens(docs: DataFrame, tokenizer: str = "simple") -> DataFrame:
    """(document_id, tokens): the tokens of title and content in order. docs: id, title, content."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    return docs.select(F.col("id").alias("document_id"), tokens(text, tokenizer).alias("tokens"))


def with_all_tokens(postings: DataFrame, asked: DataFrame, often: DataFrame) -> DataFrame:
    """Postings (document_id, token, ...) of the documents that hold all tokens of a query, for each of its tokens, with
    query_id and need. A query is paired with the documents of its rarest token (often: token, n) alone, and then looks for
    its others in them."""
    # a token that no document has makes its query find nothing
    rarest = asked.join(often, "token", "left").groupBy("query_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("token"))
    pairs = postings.select("document_id", "token").join(rarest, "token").select("query_id", "document_id")
    return pairs.join(asked, "query_id").join(postings, ["document_id", "token"])


def _frequency(tf: Column) -> Column:
    """1 + 1/4 + ... + 1/n^2 for n occurrences."""
    return F.aggregate(F.sequence(F.lit(1), tf.cast("int")), F.lit(0.0), lambda a, j: a + F.lit(1.0) / (j * j))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "document_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_by_frequency(postings: DataFrame, asked: DataFrame, often: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, document_id, score) from postings with tf."""
    scored = with_all_tokens(postings, asked, often).groupBy("query_id", "document_id", "need").agg(F.count("*").alias("n"), F.sum(_frequency(F.col("tf"))).alias("w"))
    return _ranked(scored.where("n = need").select("query_id", "document_id", (F.col("w") / F.col("need")).alias("score")), k).select("query_id", "rank", "document_id", "score")


def _smallest_window(events: Column, need: Column) -> Column:
    """The number of words of the smallest window that holds all of a query's tokens. events: (pos, token's number) by pos."""

    def step(held: Column, e: Column) -> Column:
        last = F.transform(held["last"], lambda x, i: F.when(i == e["t"], e["pos"]).otherwise(x))
        width = F.when(F.array_min(last) >= 0, e["pos"] - F.array_min(last) + 1)
        return F.struct(last.alias("last"), F.least(held["least"], width).alias("least"))

    start = F.struct(F.array_repeat(F.lit(-1), need).alias("last"), F.lit(None).cast("int").alias("least"))
    return F.aggregate(events, start, step, lambda held: held["least"])


def rank_by_proximity(postings: DataFrame, asked: DataFrame, often: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, document_id, score, width) from postings with tf and ascending positions.

    width is the number of words of the smallest window with all the query's tokens; the score is that by frequency times
    need / width, so it falls with the distance of the tokens and is the same as by frequency where they stand side by side.
    """
    found = with_all_tokens(postings, asked, often)
    item = F.struct("token", "positions")
    scored = found.groupBy("query_id", "document_id", "need").agg(F.count("*").alias("n"), F.sum(_frequency(F.col("tf"))).alias("w"), F.array_sort(F.collect_list(item)).alias("of")).where("n = need")
    events = F.array_sort(F.flatten(F.transform("of", lambda o, t: F.transform(o["positions"], lambda p: F.struct(p.alias("pos"), t.alias("t"))))))
    hits = scored.withColumn("width", _smallest_window(events, F.col("need")))
    hits = hits.select("query_id", "document_id", "width", (F.col("w") / F.col("width")).alias("score"))
    return _ranked(hits, k).select("query_id", "rank", "document_id", "score", "width")


def fulltext_search(docs: DataFrame, queries: DataFrame, k: int, doc_type: str | None = None, document_tags: DataFrame | None = None, tags: list[str] | None = None, tokenizer: str = "simple") -> DataFrame:
    """(query_id, rank, document_id, score): documents whose title and content hold all tokens of a query.

    docs: id, title, content, doc_type; queries: query_id, query. Score: the mean over the query's different tokens of
    1 + 1/4 + ... + 1/n^2 for n occurrences; ties by id. A query without tokens finds nothing. Only tokens of queries leave
    the scan of the texts. For many batches of queries on one corpus see operators.textindex.
    """
    asked = asked_tokens(queries, tokenizer)
    own = document_tokens(_wanted(docs, doc_type, document_tags, tags), tokenizer).select("document_id", F.explode("tokens").alias("token"))
    counts = stored(own.join(asked.select("token").distinct(), "token", "left_semi").groupBy("document_id", "token").agg(F.count("*").alias("tf")), "postings")
    return rank_by_frequency(counts, asked, counts.groupBy("token").agg(F.count("*").alias("n")), k)


def rrf_fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int = 60, limit: int = 10) -> DataFrame:
    """(query_id, rank, document_id, score, snippet): reciprocal ranks added up over both lists.

    Every chunk of a document in the vector list counts. The snippet is that of its best chunk, '' if it has none. Ties go by
    first appearance: vector list, then keyword list.
    """
    both = vector_hits.select("query_id", "document_id", "rank", F.lit(0).alias("list"), "snippet").unionByName(text_hits.select("query_id", "document_id", "rank", F.lit(1).alias("list"), F.lit("").alias("snippet")))
    place = F.struct("list", "rank")
    fused = both.groupBy("query_id", "document_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), F.min(place).alias("place"), F.min_by("snippet", place).alias("snippet"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "place")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "document_id", "score", F.coalesce("snippet", F.lit("")).alias("snippet"))


def hybrid_search(chunks: DataFrame, docs: DataFrame, queries: DataFrame, limit: int = 10, doc_type: str | None = None, document_tags: DataFrame | None = None, tags: list[str] | None = None) -> DataFrame:
    """Both searches at twice the limit (1 to 50), fused, with title and doc_type of each hit."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be 1 to 50")
    v = vector_search(chunks, docs, queries, 2 * limit, doc_type, document_tags, tags)
    t = fulltext_search(docs, queries, 2 * limit, doc_type, document_tags, tags)
    named = docs.select(F.col("id").alias("document_id"), "title", "doc_type")
    return rrf_fuse(v, t, limit=limit).join(named, "document_id").select("query_id", "rank", "document_id", "title", "doc_type", "score", "snippet")
