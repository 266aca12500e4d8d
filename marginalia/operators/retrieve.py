"""Passages ranked per document and query: term statistics, BM25, hybrid and boosted ranking, neighbours, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marginalia.functions import tokens as tk
from marginalia.functions import values as v

K1, B = 1.5, 0.75
#: Queries of one ranking, held by the driver.
MOST_QUERIES = 10_000


def idf_sql(n: str, df: str) -> str:
    return f"ln(({n} - {df} + 0.5) / ({df} + 0.5) + 1.0)"


def term_statistics(chunks: DataFrame, doc: str, chunk: str, text: str) -> DataFrame:
    """Document frequency and IDF of each term within each document. Terms are made distinct per chunk before the shuffle."""
    terms = chunks.select(doc, F.explode(F.array_distinct(F.expr(tk.tokens(text)))).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("df"))
    sizes = chunks.groupBy(doc).agg(F.count("*").alias("n_chunks"))
    return terms.join(sizes, doc).withColumn("idf", F.expr(v.round6(idf_sql("n_chunks", "df"))))


def score_passages(chunks: DataFrame, queries: DataFrame, *, doc: str, chunk: str, text: str, query: str, query_text: str) -> DataFrame:
    """BM25 score, and share of the query's distinct terms found, of every (query, chunk) that share a term.

    A term that is repeated in the query weighs as often as it is repeated. Only terms of queries are kept of a
    chunk, before anything is shuffled by term; chunks that share no term score 0 and come back in :func:`ranking`.
    """
    q = queries.select(query, F.explode(F.expr(tk.tokens(query_text))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qtf"))
    q_size = q.groupBy(query).agg(F.count("*").alias("q_terms"))
    toks = chunks.select(doc, chunk, F.expr(tk.tokens(text)).alias("toks")).withColumn("dl", F.greatest(F.size("toks"), F.lit(1)))
    per_doc = toks.groupBy(doc).agg(F.count("*").alias("n_chunks"), F.sum(F.size("toks")).alias("n_tokens"))
    tf = toks.select(doc, chunk, "dl", F.explode("toks").alias("term")).join(q.select("term").distinct(), "term", "left_semi").groupBy(doc, chunk, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(doc, "term").agg(F.count("*").alias("df"))
    weighted = tf.join(df, [doc, "term"]).join(per_doc, doc).selectExpr(
        doc, chunk, "term", f"{idf_sql('n_chunks', 'df')} * (tf * {K1 + 1}D) / (tf + {K1}D * ({1 - B}D + {B}D * dl / (n_tokens / n_chunks))) as w"
    )
    scored = weighted.join(q, "term").groupBy(doc, query, chunk).agg(F.sum(F.col("w") * F.col("qtf")).alias("s"), F.count("*").alias("hits"))
    return scored.join(q_size, query).select(doc, query, chunk, F.expr(v.round6("s")).alias("bm25"), F.expr(v.ratio("hits", "q_terms")).alias("coverage"))


def top_k(scored: DataFrame, doc: str, query: str, score: str, tie: str, k: int) -> DataFrame:
    """The ``k`` best per (document, query); rows beyond are dropped before the shuffle."""
    w = Window.partitionBy(doc, query).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid(scored: DataFrame, doc: str, query: str) -> DataFrame:
    best = scored.groupBy(doc, query).agg(F.max("bm25").alias("best"))
    return scored.join(best, [doc, query]).withColumn("hybrid", F.expr(v.round6("case when best > 0 then bm25 / best else 0 end * 0.7D + coverage * 0.3D"))).drop("best")


# What a query asks for, and what shows it in a passage.
NUMERIC_QUERY = r"(?iU)\b(number|count|max|maximum|highest|best|length|size|unit|efficiency|percent|percentage|rate|temperature|thickness|diameter|dose|concentration|bp|nt|kb|mm|um|nm|cm|fold)\b"
VISUAL_QUERY = r"(?iU)\b(fig(?:ure)?\.?|panel|plot|chart|graph|image|microscopy|visual)\b"
IDENTIFIER_QUERY = r"(?iU)\b(identifier|architecture|system|barcode|sequence|construct|vector|plasmid|name)\b"
NUMBER_SHOWN = r"(?U)\b\d+(?:\.\d+)?\s*(?:%|bp|nt|kb|mm|um|µm|nm|cm|x|fold)?\b"
IDENTIFIER_SHOWN = r"(?U)\b(?:[A-Z]{2,}[A-Za-z0-9-]*|[A-Za-z]+-[A-Za-z0-9-]+|[A-Za-z]*\d[A-Za-z0-9-]*)\b"
# What a passage gains that shows it.
NUMBER_BOOST, TABLE_BOOST, FIGURE_BOOST, IDENTIFIER_BOOST, FRONT_LOSS = 0.12, 0.10, 0.10, 0.05, 0.02


def query_class(queries: DataFrame, text: str) -> DataFrame:
    """``queries`` with ``asks``, an array of whether a number, a figure, an identifier is asked for."""
    return queries.withColumn("asks", F.array(*[F.coalesce(F.col(text).rlike(p), F.lit(False)) for p in (NUMERIC_QUERY, VISUAL_QUERY, IDENTIFIER_QUERY)]))


def passage_signs(chunks: DataFrame, doc: str, chunk: str, kind: str, display: str, text: str) -> DataFrame:
    """What each passage shows: a number, a table, a figure, an identifier, front matter."""
    both = F.concat_ws(" ", display, text)
    of = lambda *kinds: F.coalesce(F.col(kind).isin(*kinds), F.lit(False))
    signs = [both.rlike(NUMBER_SHOWN), of("table_region"), of("caption", "figure"), F.coalesce(F.col(display).rlike(IDENTIFIER_SHOWN), F.lit(False)), of("abstract", "section")]
    return chunks.select(doc, chunk, F.array(*signs).alias("shows"))


def boost(asks: str = "asks", shows: str = "shows"):
    """What a passage gains for what the query asks for and it shows."""
    a, s = (lambda i: F.col(asks)[i]), (lambda i: F.col(shows)[i])
    gain = lambda on, value: F.when(on, value).otherwise(0.0)
    return gain(a(0) & s(0), NUMBER_BOOST) + gain(a(0) & s(1), TABLE_BOOST) + gain(a(1) & s(2), FIGURE_BOOST) + gain(a(2) & s(3), IDENTIFIER_BOOST) - gain(s(4), FRONT_LOSS)


def ranking(scored: DataFrame, signs: DataFrame, queries: DataFrame, *, doc: str, query: str, chunk: str, score: str, k: int, boosted: bool = False) -> DataFrame:
    """The ``k`` best passages of every document for every query, those that share no term (score 0) included: ``doc``,
    ``query``, ``chunk``, ``score``, ``boosted`` (the same without boost), ``rank``.

    Of the passages without a term only the ``k`` of largest boost, first ids first, can be among the best: a passage
    behind them has ``k`` before it whatever their scores. They are ranked once per document and class of query, of
    which there are eight; documents times queries is the size of the result, not of anything before it. Queries are
    the columns of a schema: at most ``MOST_QUERIES``, more raise ``ValueError``. Repeated queries count once.
    """
    classed = query_class(queries, "query_text").select(query, "asks") if boosted else queries.select(query, F.array(*[F.lit(False)] * 3).alias("asks"))
    classed = classed.dropDuplicates([query])
    gain = boost() if boosted else F.lit(0.0)
    classes = signs.select(doc, chunk, "shows", F.explode(F.lit([[bool(i & 1), bool(i & 2), bool(i & 4)] for i in range(8)] if boosted else [[False] * 3])).alias("asks"))
    w = Window.partitionBy(doc, "asks").orderBy(F.desc("gain"), chunk)
    first = classes.withColumn("gain", F.expr(v.round6("0")) + gain).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    asked: dict[tuple, list] = {}
    for r in classed.limit(MOST_QUERIES + 1).collect():
        asked.setdefault(tuple(r["asks"]), []).append(r[query])
    if sum(map(len, asked.values())) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    of_class = F.array().cast(T.ArrayType(queries.schema[query].dataType))
    for asks, ids in asked.items():
        of_class = F.when(F.col("asks") == F.lit(list(asks)), F.lit(ids)).otherwise(of_class)
    pool = first.select(doc, F.explode(of_class).alias(query), chunk, F.lit(0.0).alias("s"))
    both = scored.select(doc, query, chunk, F.col(score).alias("s")).unionByName(pool).groupBy(doc, query, chunk).agg(F.max("s").alias("s"))
    full = both.join(classed, query).join(signs, [doc, chunk]).withColumn("b", F.expr(v.round6("s")) + gain)
    out = top_k(full.withColumn("boosted", F.expr(v.round6("b"))), doc, query, "boosted", chunk, k)
    return out.select(doc, query, chunk, F.col("s").alias(score), "boosted", "rank")


def rank_changes(before: DataFrame, after: DataFrame, doc: str, query: str, chunk: str) -> DataFrame:
    """At how many of the ranks of each (document, query) another passage stands after re-ranking."""
    a, b = (x.select(doc, query, "rank", F.col(chunk).alias(n)) for x, n in ((before, "before_id"), (after, "after_id")))
    return a.join(b, [doc, query, "rank"]).groupBy(doc, query).agg(F.count("*").alias("ranks"), F.count_if(F.col("before_id") != F.col("after_id")).alias("changed"))


def neighbours(chunks: DataFrame, selected: DataFrame, doc: str, chunk: str, order: str) -> DataFrame:
    """Selected chunks and the ones just before and after them in reading order, the latter flagged."""
    marked = chunks.join(selected.select(chunk, F.lit(True).alias("sel")).distinct(), chunk, "left").withColumn("sel", F.coalesce("sel", F.lit(False)))
    w = Window.partitionBy(doc).orderBy(order, chunk)
    near = marked.withColumn("near", F.coalesce(F.lag("sel").over(w), F.lit(False)) | F.coalesce(F.lead("sel").over(w), F.lit(False)))
    return near.where("sel or near").select(doc, chunk, order, (~F.col("sel")).alias("is_neighbour"))


# What tells the kind of a block.
SECTION_HEADING = r"^([0-9]+\.?\s+)?[A-Z][a-zA-Z\s]+$"
CAPTION_START = r"(?i)^(fig(ure)?\.?\s*[0-9]|table\s*[0-9])"


def block_type(x: str):
    """Kind of a text block: an upper-case word of letters, a short line of words, an abstract, the references, a caption."""
    t = F.regexp_replace(F.col(x), r"(?U)^\s+|\s+$", "")
    n = F.char_length(t)
    return (
        F.when((n < 80) & (t == F.upper(t)) & t.rlike(r"^\p{L}+$"), "heading").when((n < 120) & t.rlike(SECTION_HEADING), "section_heading").when(F.lower(t).startswith("abstract"), "abstract")
        .when(F.lower(t).startswith("references") & (n < 30), "heading").when(t.rlike(CAPTION_START), "caption").otherwise("paragraph")
    )


def blocks(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Non-blank lines of each text with their order, kind, and the last heading at or before them."""
    lines = docs.select(doc, F.posexplode(F.split(text, "\\r\\n|\\r|\\n")).alias("reading_order", "block")).where(~F.expr(v.is_empty("block")))
    typed = lines.withColumn("block_type", block_type("block"))
    w = Window.partitionBy(doc).orderBy("reading_order").rowsBetween(Window.unboundedPreceding, 0)
    return typed.withColumn("section", F.last(F.when(F.col("block_type").isin("heading", "section_heading"), F.expr(v.tidy("block"))), ignorenulls=True).over(w))


def attach_captions(items: DataFrame, doc: str, order: str, is_figure, is_caption) -> DataFrame:
    """Each figure with the first caption behind it and before the next figure."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = items.withColumn("figure_no", F.count_if(is_figure).over(w))
    return marked.where("figure_no > 0").groupBy(doc, "figure_no").agg(F.min(F.when(is_figure, F.col(order))).alias("figure_order"), F.min(F.when(is_caption, F.col(order))).alias("caption_order"))


# Kinds of block and the kind of passage each becomes, and the passages an index holds.
PASSAGE_KINDS = {"paragraph": "paragraph", "heading": "section", "section_heading": "section", "caption": "caption", "table_region": "table_region", "abstract": "abstract", "list_item": "list_item", "reference": "paragraph", "unknown": "paragraph"}
ALWAYS_INDEXED = ("paragraph", "section", "abstract", "list_item", "figure")
# What a request is about, the pattern that tells, and the terms that papers use for it.
HINTS = (
    ("count_like", r"(?iU)(^\s*#)|\b(how many|number|count|total|sample size|n\s*=)\b", ("count", "total", "number", "pairs", "pair", "combinations", "constructed", "tested", "included", "coverage")),
    ("variant_or_sequence", r"(?U)\b(variant|variants|sequence|sequences|pair|pairs|barcode|barcodes|construct|constructs|plasmid|plasmids|element|elements)\b", ("sequences", "pairs", "combinations", "plasmids", "barcodes")),
    ("vector_or_backbone", r"(?U)\b(episomal|ori|origin of replication|backbone|vector)\b", ("episomal", "plasmid", "vector", "backbone", "origin", "replication", "polya")),
    ("methods_or_library", r"(?U)\b(clon|library|design|construct|assay format|readout)\b", ("methods", "design", "library", "cloning", "construct")),
)


def expanded_queries(columns: DataFrame, column: str, description: str) -> DataFrame:
    """``columns`` with ``tags`` of what is asked for, ``hint_terms`` in first-seen order, and ``query_text`` with the hints behind it."""
    asked = F.lower(F.concat_ws(" ", F.col(column), F.coalesce(F.col(description), F.lit(""))))
    none = F.array().cast("array<string>")
    tags = F.array_compact(F.array(*[F.when(asked.rlike(p), F.lit(tag)) for tag, p, _ in HINTS]))
    terms = none
    for _, p, words in HINTS:
        terms = F.array_union(terms, F.when(asked.rlike(p), F.array(*map(F.lit, words))).otherwise(none))
    base = F.trim(F.concat(F.col(column), F.lit(": "), F.coalesce(F.col(description), F.lit(""))))
    out = columns.withColumn("tags", tags).withColumn("hint_terms", terms)
    return out.withColumn("query_text", F.when(F.size("hint_terms") > 0, F.concat(base, F.lit("\nRetrieval hints: "), F.array_join("hint_terms", " "))).otherwise(base))


def passages_of_blocks(typed: DataFrame, doc: str, order: str, text: str, kind: str, section: str) -> DataFrame:
    """Passages of typed blocks: ``chunk_type``, ``display_text``, ``retrieval_text`` with its kind and section before it. Blank blocks give none."""
    shown = F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", "")
    to = F.coalesce(F.create_map(*[F.lit(x) for kv in PASSAGE_KINDS.items() for x in kv])[F.col(kind)], F.lit("paragraph"))
    heading = F.col(kind).isin("heading", "section_heading")
    inner = F.when(F.col(section).isNotNull() & ~heading, F.concat(F.lit("[Section: "), F.col(section), F.lit("] "), shown)).otherwise(shown)
    marks = F.concat_ws(" ", F.concat(F.lit("[Chunk type: "), to, F.lit("]")), F.when(F.col(section).isNotNull(), F.concat(F.lit("[Section: "), F.col(section), F.lit("]"))), F.when(to == "table_region", F.lit("[Table]")))
    return typed.where(shown != "").select(doc, order, to.alias("chunk_type"), shown.alias("display_text"), F.trim(F.concat(marks, F.lit(" "), inner)).alias("retrieval_text"), F.col(section).alias("section_context"))


def figure_passages(figures: DataFrame, captions: DataFrame, doc: str) -> DataFrame:
    """A passage for each figure, its caption its own or that of its caption block; figures without caption and id give none.

    ``figures``: doc, figure_id, caption_text, caption_block_id, nearby_text; ``captions``: doc, block_id, text.
    """
    c = captions.groupBy(doc, F.col("block_id").alias("caption_block_id")).agg(F.min("text").alias("__block"))
    joined = figures.join(c, [doc, "caption_block_id"], "left")
    caption = F.coalesce(F.nullif(F.trim("caption_text"), F.lit("")), F.nullif(F.trim("__block"), F.lit("")))
    ref = F.nullif(F.trim("figure_id"), F.lit(""))
    mark = F.concat(F.lit("[Figure: "), ref, F.lit("]"))
    text = F.concat_ws(" ", F.lit("[Chunk type: figure]"), mark, F.coalesce(mark, F.lit("[Figure: ]")), caption, F.nullif(F.trim("nearby_text"), F.lit("")))
    return joined.where(caption.isNotNull() | ref.isNotNull()).select(doc, ref.alias("figure_ref"), F.lit("figure").alias("chunk_type"), F.coalesce(caption, ref).alias("display_text"), text.alias("retrieval_text"), caption.alias("caption_text"))


def fingerprints(passages: DataFrame, doc: str, *parts: str) -> DataFrame:
    """One fingerprint per document over its passages in any order: their number and two sums of hashes, so nothing is gathered."""
    row = F.struct(*parts)
    h = F.conv(F.substring(F.sha2(F.to_json(row), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return passages.groupBy(doc).agg(F.count("*").alias("n"), F.sum(h).alias("s"), F.bit_xor(F.xxhash64(row)).alias("x")).select(doc, F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string")), 256).alias("fingerprint"))


def index_plan(current: DataFrame, indexed: DataFrame, doc: str) -> DataFrame:
    """What an index needs: documents to ``reuse`` (same fingerprint), to ``build`` (new or changed) and to ``drop`` (gone)."""
    old = indexed.select(doc, F.col("fingerprint").alias("__old"))
    joined = current.select(doc, F.col("fingerprint").alias("__new")).join(old, doc, "full_outer")
    return joined.select(doc, F.when(F.col("__new").isNull(), "drop").when(F.col("__new").eqNullSafe(F.col("__old")), "reuse").otherwise("build").alias("action"))


def indexed_passages(chunks: DataFrame, kind: str, *, captions: bool = True, tables: bool = True) -> DataFrame:
    """Passages an index holds; captions and tables may be left out."""
    kinds = [*ALWAYS_INDEXED, *(["caption"] if captions else []), *(["table_region"] if tables else [])]
    return chunks.where(F.coalesce(F.col(kind).isin(*kinds), F.lit(False)))
