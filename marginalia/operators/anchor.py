"""Evidence: where quotes stand, what outcome they have, which is first, and which sets are used twice."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import tokens as tk
from marginalia.functions import values as v


def locate_quotes(quotes: DataFrame, passages: DataFrame, *, keys: Sequence[str], quote_id: str, quote: str, passage_id: str, passage: str) -> DataFrame:
    """(quote, passage) of equal keys where the words of the quote stand together, whole, in the passage.

    A quote meets passages only by its rarest word within the group, so no pairs are made within a group but
    those that share it; a quote with a word no passage of the group has is dropped at once.
    """
    k = list(keys)
    q = quotes.select(*k, quote_id, F.expr(tk.token_text(quote)).alias("__q")).where("length(trim(__q)) > 0").distinct()
    p = passages.select(*k, passage_id, F.expr(tk.token_text(passage)).alias("__p")).distinct()
    words = p.select(*k, passage_id, F.explode(F.array_distinct(F.split(F.trim("__p"), " "))).alias("__word"))
    counts = words.groupBy(*k, "__word").agg(F.count("*").alias("__df"))
    q_words = q.select(*k, quote_id, "__q", F.explode(F.array_distinct(F.split(F.trim("__q"), " "))).alias("__word"))
    rarest = q_words.join(counts, [*k, "__word"], "left").groupBy(*k, quote_id, "__q").agg(F.min(F.struct(F.coalesce("__df", F.lit(0)).alias("df"), "__word")).alias("__r"))
    pairs = rarest.where("__r.df > 0").select(*k, quote_id, "__q", F.col("__r.__word").alias("__word")).join(words, [*k, "__word"])
    return pairs.join(p, [*k, passage_id]).where("contains(__p, __q)").select(*k, quote_id, passage_id)


#: What parts words in any script.
APART = r"[^\p{L}\p{N}\p{M}]+"


#: Groups of at most so many passages are held against each quote of the group as they are.
SMALL = 64


def folded_text(df: DataFrame, text: str) -> DataFrame:
    """White space collapsed and case folded, in any script, in place; on Arrow batches, as Spark has no case folding."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([None if x is None else " ".join(x.split()).casefold() for x in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def plain_words(df: DataFrame, text: str) -> DataFrame:
    """Lower-case ASCII letters and digits parted by single blanks, in place."""
    return df.withColumn(text, F.expr(f"coalesce({v.plain_text(text)}, '')"))


def contained_quotes(quotes: DataFrame, passages: DataFrame, *, keys: Sequence[str], quote_id: str, quote: str, passage_id: str, passage: str, fold: Callable[[DataFrame, str], DataFrame] = folded_text, small: int = SMALL) -> DataFrame:
    """(quote, passage) of equal keys where the folded quote stands in the folded passage, cut words included.

    In groups of more than ``small`` passages a quote meets passages only by the rarest of its inner words, which stand whole
    wherever the quote does, in any script; a quote without an inner word meets all passages of its group. Both ways
    give the same pairs.
    """
    k = list(keys)
    real = r"rlike '(?U)[^\\s\\x1c-\\x1f]'"
    q = quotes.select(*k, F.col(quote_id).alias("__qid"), F.col(quote).alias("__q")).where(f"__q {real}")
    p = passages.select(*k, F.col(passage_id).alias("__pid"), F.col(passage).alias("__p")).where(f"__p {real}")
    sizes = p.groupBy(*k).agg(F.count("*").alias("__n"))
    p = p.join(sizes, k)
    is_small = F.col("__n") <= small
    # A fold may leave nothing of a text that is not blank: an empty quote stands nowhere
    held = "length(__q) > 0 and contains(__p, __q)"
    found = fold(p.where(is_small), "__p").join(fold(q, "__q"), k).where(held).select(*k, "__qid", "__pid")
    large = fold(p.where(~is_small), "__p").drop("__n")
    q = fold(q.join(sizes.where(~is_small), k), "__q").drop("__n").withColumn("__words", F.split("__q", APART))
    q = q.select(*k, "__qid", "__q", F.expr("case when size(__words) > 2 then array_distinct(slice(__words, 2, size(__words) - 2)) else cast(array() as array<string>) end").alias("__words"))
    words = large.select(*k, "__pid", F.explode(F.array_distinct(F.split("__p", APART))).alias("__word")).where("__word <> ''").distinct()
    counts = words.groupBy(*k, "__word").agg(F.count("*").alias("__df"))
    q_words = q.select(*k, "__qid", "__q", F.explode("__words").alias("__word"))
    rarest = q_words.join(counts, [*k, "__word"], "left").groupBy(*k, "__qid", "__q").agg(F.min(F.struct(F.coalesce("__df", F.lit(0)).alias("df"), "__word")).alias("__r"))
    pairs = rarest.where("__r.df > 0").select(*k, "__qid", "__q", F.col("__r.__word").alias("__word")).join(words, [*k, "__word"])
    by_word = pairs.join(large, [*k, "__pid"]).where(held).select(*k, "__qid", "__pid")
    wordless = q.where("size(__words) = 0").join(large, k).where(held).select(*k, "__qid", "__pid")
    return found.unionByName(by_word).unionByName(wordless).distinct().select(*k, F.col("__qid").alias(quote_id), F.col("__pid").alias(passage_id))


def anchor_outcomes(evidence: DataFrame, located: DataFrame, quote_id: str, page: str, quote: str) -> DataFrame:
    """Outcome of each piece of evidence: no page or quote, located, or present but not located; and the first passage."""
    first = located.groupBy(quote_id).agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("n_places"))
    outcome = f"""case when {page} is null or {page} <= 0 then 'anchor_invalid:missing_or_invalid_page' when trim(coalesce({quote}, '')) = '' then 'anchor_invalid:missing_quote_text'
        when chunk_id is not null then 'anchor_valid' else 'evidence_present_but_unvalidated' end"""
    return evidence.join(first, quote_id, "left").withColumn("outcome", F.expr(outcome)).withColumn("n_places", F.coalesce("n_places", F.lit(0)))


#: Decimal digits of all scripts but ASCII.
DIGITS = "".join(chr(i) for i in range(0x80, 0x20000) if unicodedata.category(chr(i)) == "Nd")


def _plain_digits(x: str) -> str:
    """The text with the digits of all scripts as ASCII digits."""
    return f"case when {x} rlike r'[\\p{{Nd}}&&[^0-9]]' then translate({x}, '{DIGITS}', '{''.join(str(unicodedata.decimal(c)) for c in DIGITS)}') else {x} end"


def _searchable(df: DataFrame, text: str) -> DataFrame:
    """The forms of a text in which values are sought: plain text, folded text, and the numbers it holds."""
    numbers = f"transform(regexp_extract_all({_plain_digits(text)}, {v.SPARK.pattern(v.NUMBER)}, 0), x -> try_cast(replace(x, ',', '') as double))"
    return df.where(f"not {v.is_empty(text)}").select("*", F.expr(v.plain_text(text)).alias("__plain"), F.expr(f"lower({v.tidy(text)})").alias("__folded"), F.expr(numbers).alias("__numbers")).drop(text)


def page_texts(passages: DataFrame, keys: Sequence[str], order: Sequence[str], text: str) -> DataFrame:
    """The passages of each page as one text, in their order."""
    parts = passages.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("a"))
    return parts.select(*keys, F.array_join(F.transform("a", lambda x: x[text]), "\n").alias("page_text"))


def support_outcomes(values: DataFrame, evidence: DataFrame, pages: DataFrame, *, proposal: str, field_type: str, value: str, evidence_id: str, quote: str, page: Sequence[str]) -> DataFrame:
    """Whether quotes or cited pages hold the value of a proposal, by its type.

    Numbers by overlap of their bounds with any number of the text, booleans by their terms as whole words, all else
    by containment of the plain text (of the folded text where a value has no ASCII letter or digit). A text counts as support only if its
    evidence has an id. Free text is ``not_applicable``; a value that does not parse, or without texts, ``unvalidated``.
    """
    e = evidence.withColumn("__id", F.expr(f"coalesce({evidence_id}, '') <> ''"))
    quotes = _searchable(e.where(F.col(quote).isNotNull()).groupBy(proposal, quote).agg(F.max("__id").alias("__id")), quote).withColumn("__quote", F.lit(True))
    cited = e.dropna(subset=list(page)).groupBy(proposal, *page).agg(F.max("__id").alias("__id"))
    seen = cited.join(_searchable(pages, "page_text"), list(page)).drop(*page).withColumn("__quote", F.lit(False))
    low, high = v.number_bounds("__digits")
    kind = F.when(F.col(field_type).isin("number", "numeric"), "number").when(F.col(field_type) == "boolean", "boolean").otherwise("text")
    asked = values.withColumn("__digits", F.expr(_plain_digits(value))).select(
        proposal, field_type, kind.alias("__kind"), F.expr(low).alias("__low"), F.expr(high).alias("__high"), F.expr(v.boolean_value(value)).alias("__truth"), F.expr(v.plain_text(value)).alias("__value"), F.expr(f"nullif(lower({v.tidy(value)}), '')").alias("__raw")
    ).withColumn("__parsed", F.expr("case __kind when 'number' then __low is not null when 'boolean' then __truth is not null else __raw is not null end"))
    terms = lambda words: " or ".join(f"contains(concat(' ', __plain, ' '), ' {w} ')" for w in words)
    hit = f"""__parsed and __id and case __kind when 'number' then exists(__numbers, x -> x >= __low and x <= __high)
        when 'boolean' then case when __truth then {terms(v.BOOLEAN_TRUE)} else {terms(v.BOOLEAN_FALSE)} end
        else case when __value <> '' then contains(__plain, __value) else contains(__folded, __raw) end end"""
    joined = asked.join(quotes.unionByName(seen), proposal, "left")
    out = joined.groupBy(proposal, field_type).agg(
        F.count_if("__quote").alias("n_quotes"), F.count_if(F.expr(f"coalesce({hit}, false)")).alias("n_supporting"), F.count_if(~F.col("__quote")).alias("n_pages"), F.max("__parsed").alias("__parsed")
    ).withColumn("supported", F.col("n_supporting") > 0)
    status = f"case when {field_type} in ('boolean', 'categorical', 'number', 'numeric') then case when not __parsed or n_quotes + n_pages = 0 then 'unvalidated' when supported then 'supported' else 'unsupported' end else 'not_applicable' end"
    return out.select(proposal, field_type, "n_quotes", "n_pages", "n_supporting", "supported", F.expr(status).alias("status"))


def rank_evidence(evidence: DataFrame, proposal: str, source: str, prior: str, quote_id: str, authority: Sequence[str]) -> DataFrame:
    """Evidence of each proposal by authority of its source, then prior rank; the first is primary."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(a) for a in authority]), F.col(source)), F.lit(0))
    w = Window.partitionBy(proposal).orderBy(F.when(order > 0, order).otherwise(len(authority) + 1), F.asc_nulls_last(prior), quote_id)
    return evidence.withColumn("new_rank", F.row_number().over(w)).withColumn("is_first", F.col("new_rank") == 1)


def reused_sets(evidence: DataFrame, proposals: DataFrame, proposal: str, signature: str, column: str) -> DataFrame:
    """Sets of evidence that serve proposals of two or more columns, by a hash of the sorted set.

    Hashes of the pieces are summed, not gathered: a set of any size is one number per proposal.
    """
    h = F.xxhash64(signature)
    sets = evidence.select(proposal, signature).where(F.col(signature).isNotNull()).distinct().groupBy(proposal).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.min(signature).alias("first_piece"), F.max(signature).alias("last_piece"))
    used = sets.join(proposals.select(proposal, column).distinct(), proposal)
    return used.groupBy("n", "x", "first_piece", "last_piece").agg(F.count_distinct(column).alias("n_columns"), F.count_distinct(proposal).alias("n_proposals")).where("n_columns > 1").drop("x")
