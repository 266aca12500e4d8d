"""Evidence grounded in passages: anchoring chain, support, evidence status, review bucket, tiers, figures."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import tokens as tk
from marginalia.functions import values as v
from marginalia.operators.anchor import contained_quotes
from marginalia.session import saved

#: Least share of the words of a quote in a passage that only comes near it.
NEAR = 0.3
ANY_PAGE = -1


def token_line(df: DataFrame, text: str) -> DataFrame:
    """The retrieval tokens of a text, parted by single blanks, in place."""
    return df.withColumn(text, F.expr(f"trim({tk.token_text(text)})"))


def anchor_chain(quotes: DataFrame, passages: DataFrame, *, quote_id: str, doc: str, page: str, quote: str, passage_id: str, passage: str, order: str) -> DataFrame:
    """How each quote is anchored: ``source_type``, first or nearest ``passage_id``, ``confidence``.

    ``direct_quote`` (1.0) if the tokens of the quote stand together, cut words included, in a passage of its page
    (of its document where it names no page): the first in reading order. Else ``approximate_highlight`` by the
    passage that holds the largest share of its distinct tokens, 0.3 or more, the first of equal ones. Else
    ``quote_plus_page`` (0.0), as are quotes without a token. Repeated rows count once.

    A quote meets passages by its rarest tokens only, so many that a passage with a share of 0.3 holds one of them.
    """
    # Texts are brought to their tokens once, and read as such from then on
    q = quotes.select(F.col(quote_id).alias("qid"), F.col(doc).alias("doc"), F.when(F.col(page) > 0, F.col(page)).otherwise(ANY_PAGE).cast("long").alias("page"), F.col(quote).alias("quote"))
    q = saved(token_line(q, "quote").distinct(), "chain-quotes")
    own = passages.select(F.col(doc).alias("doc"), F.col(page).cast("long").alias("page"), F.col(passage_id).alias("pid"), F.col(order).alias("ord"), F.col(passage).alias("text"))
    own = saved(token_line(own, "text").distinct(), "chain-passages")
    bag = lambda c: F.expr(f"array_distinct(filter(split({c}, ' '), w -> w <> ''))")
    paged = q.where(F.col("page") == ANY_PAGE).select("doc").distinct()
    p = own.where("page is not null").unionByName(own.join(paged, "doc", "left_semi").withColumn("page", F.lit(ANY_PAGE).cast("long")))
    exact = contained_quotes(q.where("doc is not null"), p, keys=["doc", "page"], quote_id="qid", quote="quote", passage_id="pid", passage="text", fold=lambda df, _: df)
    first = exact.join(p.select("doc", "page", "pid", "ord"), ["doc", "page", "pid"]).groupBy("qid").agg(F.min(F.struct("ord", "pid"))["pid"].alias("exact_id"))
    left = q.join(first, "qid", "left_anti").withColumn("tokens", bag("quote")).where("size(tokens) > 0")
    bags = p.withColumn("bag", bag("text")).select("doc", "page", "pid", "ord", "bag")
    words = bags.select("doc", "page", "pid", F.explode("bag").alias("word"))
    df = words.groupBy("doc", "page", "word").agg(F.count("*").alias("df"))
    asked = left.select("qid", "doc", "page", F.size("tokens").alias("n"), F.explode("tokens").alias("word")).join(df, ["doc", "page", "word"], "left")
    ranked = asked.groupBy("qid", "doc", "page", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("w"))
    kept = ranked.select("qid", "doc", "page", F.explode(F.slice("w", 1, F.col("n") - F.ceil(F.col("n") * NEAR).cast("int") + 1)).alias("x")).where("x.df > 0").select("qid", "doc", "page", F.col("x.word").alias("word"))
    pairs = kept.join(words, ["doc", "page", "word"]).select("qid", "doc", "page", "pid").distinct()
    scored = pairs.join(left.select("qid", "doc", "page", "tokens"), ["qid", "doc", "page"]).join(bags, ["doc", "page", "pid"])
    scored = scored.select("qid", "pid", "ord", (F.size(F.array_intersect("tokens", "bag")) / F.size("tokens")).alias("share")).where(F.col("share") >= NEAR)
    near = scored.groupBy("qid").agg(F.min(F.struct((-F.col("share")).alias("s"), "ord", "pid")).alias("b")).select("qid", F.col("b.pid").alias("near_id"), (-F.col("b.s")).alias("share"))
    out = q.select("qid").distinct().join(first, "qid", "left").join(near, "qid", "left")
    kind = F.when(F.col("exact_id").isNotNull(), "direct_quote").when(F.col("near_id").isNotNull(), "approximate_highlight").otherwise("quote_plus_page")
    confidence = F.when(F.col("exact_id").isNotNull(), 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    out = out.select(F.col("qid").alias(quote_id), kind.alias("source_type"), F.coalesce("exact_id", "near_id").alias(passage_id), confidence.alias("__c"))
    return out.withColumn("confidence", F.expr(v.round6("__c"))).drop("__c")


# ---------------------------------------------------------------------------- support and status

# Names of the reason codes that change a status.
INSUFFICIENT, AMBIGUOUS, CONFLICTING, RETRIEVAL_EMPTY = "insufficient_evidence", "ambiguous_evidence", "conflicting_evidence", "retrieval_empty"
ATTENTION = ("anchor_fallback", "approximate_anchor", INSUFFICIENT, AMBIGUOUS, CONFLICTING)
DIAGNOSTIC = (RETRIEVAL_EMPTY, "pdf_unmatched", "row_unmatched", "duplicate_row_conflict")
#: Least share of the words of a value in a quote that supports it; numbers need all.
WORDING = 0.66


def support_form(x: str) -> str:
    """Lower case, accents as breaks, all but letters, digits, points, percent signs and hyphens as single blanks."""
    return rf"trim(regexp_replace({tk.folded(f'coalesce({x}, {chr(39)}{chr(39)})')}, r'[^a-z0-9.%-]+', ' '))"


def support_tokens(form: str) -> str:
    """Distinct words of a support form without a plural s."""
    return f"array_distinct(transform(filter(split({form}, ' '), w -> w <> ''), w -> case when length(w) > 3 and endswith(w, 's') then left(w, length(w) - 1) else w end))"


def supports_value(quote: str, value: str, numeric: str) -> Column:
    """Whether a quote states the value: contained, or all (numbers) or most of its words."""
    q, x = support_form(quote), support_form(value)
    tokens, asked = support_tokens(q), support_tokens(x)
    share = f"size(array_intersect({tokens}, {asked})) / size({asked})"
    return F.expr(f"coalesce({q} <> '' and {x} <> '' and (contains({q}, {x}) or {share} >= case when {numeric} then 1.0D else {WORDING}D end), false)")


def support_labels(proposals: DataFrame, evidence: DataFrame, *, proposal: str, state: str, value: str, numeric: str, source: str, quote: str, evidence_id: str) -> DataFrame:
    """``support`` of each proposal by its state and evidence, counts of evidence by what weakens it.

    ``direct_evidence`` if a direct quote states the value, ``inferred_from_evidence`` with any other evidence,
    ``weak_evidence`` without, ``blocked`` and ``error`` by the state.
    """
    pairs = evidence.select(proposal, F.col(evidence_id).alias("__e"), F.col(source).alias("__s"), F.col(quote).alias("__q")).distinct().join(proposals.select(proposal, F.col(value).alias("__v"), F.expr(numeric).alias("__n")).distinct(), proposal)
    direct = F.coalesce(F.col("__s") == "direct_quote", F.lit(False)) & supports_value("__q", "__v", "__n")
    facts = pairs.groupBy(proposal).agg(
        F.count("*").alias("n_evidence"), F.count_if(direct).alias("n_direct"), F.count_if(F.col("__s").isin("inferred_reasoning", "calculation")).alias("n_inferred"), F.count_if(F.col("__s").isin("quote_plus_page", "approximate_highlight")).alias("n_loose")
    )
    counts = ["n_evidence", "n_direct", "n_inferred", "n_loose"]
    support = F.when(F.col(state) == "error", "error").when(F.col(state).isin("blocked", "skipped", "unclear"), "blocked").when(F.col("n_direct") > 0, "direct_evidence").when(F.col("n_evidence") > 0, "inferred_from_evidence").otherwise("weak_evidence")
    return proposals.join(facts, proposal, "left").na.fill(0, counts).withColumn("support", support)


def evidence_status(state: str = "state", support: str = "support", reasons: str = "reasons") -> Column:
    """Status of the evidence: not applicable, none, or direct or inferred and strong or weak."""
    s = F.col(state)
    inferred = (F.col(support) == "inferred_from_evidence") | (F.col("n_inferred") > 0)
    weak = (F.col(support) == "weak_evidence") | F.coalesce(F.array_contains(reasons, INSUFFICIENT), F.lit(False)) | (F.col("n_loose") > 0)
    kind = F.concat(F.when(inferred, "inferred").otherwise("direct"), F.when(weak, "_weak").otherwise("_strong"))
    return F.when(s.isin("error", "blocked", "skipped") | (F.col(support) == "error"), "not_applicable").when(F.col("n_evidence") == 0, "no_evidence").otherwise(kind)


def reason_set(x: str) -> Column:
    """Reason codes trimmed, empty ones and repeats gone, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(F.col(x), F.array()), F.trim), lambda r: r.isNotNull() & (r != "")))


def review_bucket(status: str, evidence: str, reasons: str) -> Column:
    """``diagnostic``, ``attention`` or ``review`` of a proposal."""
    has = lambda codes: F.arrays_overlap(F.col(reasons), F.array(*map(F.lit, codes)))
    only_diagnostic = (F.size(reasons) > 0) & (F.size(F.array_except(F.col(reasons), F.array(*map(F.lit, DIAGNOSTIC)))) == 0)
    st, ev = F.col(status), F.col(evidence)
    return (
        F.when(st.isin("error", "not_attempted", "not_applicable"), "diagnostic").when((st == "unresolved") & (ev == "no_evidence") & only_diagnostic, "diagnostic")
        .when(ev.isin("direct_weak", "inferred_weak") | has(ATTENTION) | ((st == "no_data") & (ev == "no_evidence")) | (st == "unresolved"), "attention").otherwise("review")
    )


def illegal_combination(status: str, evidence: str, reasons: str) -> Column:
    """The rule a combination of status, evidence and reasons breaks; null if none."""
    st, ev = F.col(status), F.col(evidence)
    has = lambda *codes: F.arrays_overlap(F.col(reasons), F.array(*map(F.lit, codes)))
    return (
        F.when(st.isin("error", "not_attempted", "not_applicable") & (ev != "not_applicable"), F.concat(st, F.lit(" requires not_applicable")))
        .when(st.isin("value_proposed", "no_data", "unresolved") & (ev == "not_applicable"), F.concat(st, F.lit(" cannot be not_applicable")))
        .when((st == "value_proposed") & (ev == "no_evidence") & ~has(INSUFFICIENT), "value without evidence needs insufficient_evidence")
        .when((st == "unresolved") & ev.isin("direct_strong", "inferred_strong") & ~has(CONFLICTING, AMBIGUOUS), "unresolved with strong evidence needs a conflict")
    )


# ---------------------------------------------------------------------------- figures

# Weights and bands of the figure score.
CAPTION_WEIGHT, REFERENCE_WEIGHT, CONTEXT_WEIGHT, RETRIEVED_WEIGHT = 0.35, 0.25, 0.20, 0.20
HIGH, MEDIUM, CLOSE, PER_REFERENCE = 0.65, 0.35, 0.12, 0.25
FIGURE = r"(?iU)\b(?:fig(?:ure)?\.?\s*)([0-9]+)([a-z])?(?:\s*[-–]\s*([a-z]))?\b"
#: Characters kept before and behind a reference to a figure.
BEFORE, BEHIND = 140, 220


def figure_references(texts: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """Every reference to a figure: ``ordinal`` within the text, ``figure_no``, ``panel``, ``snippet`` around it.

    The text is parted at its references once; the places are sums of the lengths of what was found and what stands
    between, so no text is searched twice.
    """
    found = texts.select(*key, F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = found.withColumn("refs", F.expr(rf"regexp_extract_all(t, r'{FIGURE}', 0)")).where("size(refs) > 0").withColumn("gaps", F.expr(rf"split(t, r'{FIGURE}')"))
    starts = "transform(refs, (x, i) -> cast(aggregate(slice(gaps, 1, i + 1), 0, (a, g) -> a + length(g)) + aggregate(slice(refs, 1, i), 0, (a, r) -> a + length(r)) as int))"
    at = found.withColumn("starts", F.expr(starts)).select(*key, "t", F.posexplode(F.arrays_zip("refs", "starts")).alias("ordinal", "z"))
    ref = F.col("z.refs")
    part = lambda i: F.expr(rf"regexp_extract(z.refs, r'{FIGURE}', {i})")
    begin = F.greatest(F.col("z.starts") - BEFORE, F.lit(0))
    end = F.col("z.starts") + F.length(ref) + BEHIND
    panel = F.when((part(2) != "") & (part(3) != ""), F.concat(part(2), F.lit("-"), part(3))).otherwise(F.nullif(part(2), F.lit("")))
    return at.select(*key, "ordinal", F.expr(rf"try_cast(regexp_extract(z.refs, r'{FIGURE}', 1) as int)").alias("figure_no"), panel.alias("panel"), F.trim(F.substring("t", begin + 1, end - begin)).alias("snippet"))


def _overlap(text: str, asked: str) -> Column:
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(text, asked)) / F.size(asked)).otherwise(0.0)


def score_figures(figures: DataFrame, queries: DataFrame, references: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Score of each (document, figure) for each query: caption, references, text nearby, retrieval; ``band``.

    ``figures``: doc, figure_id, figure_no, caption, nearby. ``queries``: doc, query, query_text. ``references``: doc,
    query (null: of the whole document), figure_no. ``retrieved``: doc, query, figure_no of retrieved figures. References
    are counted before they are joined.
    """
    words = lambda x: F.expr(f"array_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+', 0))")
    base = figures.join(queries, "doc").select("doc", "figure_id", "query", "figure_no", words("caption").alias("c"), words("nearby").alias("near"), words("query_text").alias("asked"))
    whole = references.where("query is null").groupBy("doc", "figure_no").agg(F.count("*").alias("n_all"))
    own = references.where("query is not null").groupBy("doc", "query", "figure_no").agg(F.count("*").alias("n_own"))
    hit = retrieved.select("doc", "query", "figure_no").distinct().withColumn("hit", F.lit(1.0))
    full = base.join(whole, ["doc", "figure_no"], "left").join(own, ["doc", "query", "figure_no"], "left").join(hit, ["doc", "query", "figure_no"], "left")
    n = F.coalesce("n_all", F.lit(0)) + F.coalesce("n_own", F.lit(0))
    total = CAPTION_WEIGHT * _overlap("c", "asked") + REFERENCE_WEIGHT * F.least(F.lit(1.0), PER_REFERENCE * n) + CONTEXT_WEIGHT * _overlap("near", "asked") + RETRIEVED_WEIGHT * F.coalesce("hit", F.lit(0.0))
    scored = full.select("doc", "query", "figure_id", "figure_no", n.alias("n_references"), total.alias("t"))
    scored = scored.withColumn("score", F.expr(v.round6("t"))).drop("t")
    return scored.withColumn("band", F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low"))


def select_figures(scored: DataFrame, most: int = 5) -> DataFrame:
    """The figures looked at for each query: one of high confidence and a second close to it, else the two best."""
    w = Window.partitionBy("doc", "query").orderBy(F.desc("score"), "figure_no", "figure_id")
    two = scored.withColumn("place", F.row_number().over(w)).where("place <= 2")
    best = two.groupBy("doc", "query").agg(F.max(F.when(F.col("place") == 1, F.col("score"))).alias("top"))
    near = (F.col("top") < HIGH) | (F.col("score") >= F.col("top") - CLOSE)
    return two.join(best, ["doc", "query"]).where(((F.col("place") == 1) | near) & (F.col("place") <= most)).select("doc", "query", "place", "figure_id", "score", "band")


# ---------------------------------------------------------------------------- tiers

# Tiers of evidence, the strongest first.
TIERS = ("A", "B", "C", "D")


def strongest_tier(evidence: DataFrame, proposal: str, tier: str, codes: str, order: str) -> DataFrame:
    """Of each proposal the strongest tier and the reason codes of all its evidence, in the order they first appear."""
    per = evidence.groupBy(proposal).agg(F.min(tier).alias("tier"))
    seen = evidence.select(proposal, order, F.posexplode(F.coalesce(F.col(codes), F.array().cast("array<string>"))).alias("__i", "code"))
    first = seen.groupBy(proposal, "code").agg(F.min(F.struct(order, "__i")).alias("at"))
    listed = first.groupBy(proposal).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]).alias("codes"))
    return per.join(listed, proposal, "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def codes_when(conditions: Iterable[tuple[str, str]]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.expr(c), F.lit(name)) for name, c in conditions]))


def evidence_tiers(evidence: DataFrame, *, doc: str, page: str, quote: str, source: str, approximate: str, exact: str = "false", reasoning: str = "''") -> DataFrame:
    """Adds ``tier``, ``tier_status``, ``tier_bucket``, ``tier_codes``: A text on a page, B a region only, C a page with reasoning, D nothing.

    ``approximate`` and ``exact`` tell whether regions are known, ``reasoning`` what was argued; all are SQL expressions.
    """
    some = lambda x: f"trim(coalesce({x}, '')) <> ''"
    at = f"({some(doc)} and coalesce({page}, 0) > 0)"
    tier = f"case when {at} and {some(quote)} then 'A' when {at} and ({exact} or {approximate}) then 'B' when {at} and {some(reasoning)} then 'C' else 'D' end"
    weak = f"({approximate} and not {exact})"
    out = evidence.withColumn("tier", F.expr(tier))
    return out.withColumns({
        "tier_status": F.expr(f"case tier when 'A' then 'direct_strong' when 'B' then case when {weak} then 'direct_weak' else 'direct_strong' end when 'C' then 'inferred_weak' else 'no_evidence' end"),
        "tier_bucket": F.expr(f"case when tier = 'A' or tier = 'B' and not {weak} then 'review' else 'attention' end"),
        "tier_codes": F.expr(f"case tier when 'A' then cast(array() as array<string>) when 'B' then case when {weak} then array('approximate_anchor') else cast(array() as array<string>) end when 'C' then array('page_only_evidence') else array('missing_structured_evidence') end"),
    })


def derivation_overrides(df: DataFrame, *, codes: str, status: str, bucket: str, flags: str) -> DataFrame:
    """Status, bucket and flags after the derivation codes of a value; later rules win over earlier ones."""
    has = lambda c: F.coalesce(F.array_contains(codes, c), F.lit(False))
    weak = has("protocol_inference") | has("absence_inference")
    calculated = F.when(F.col(status) == "direct_strong", "inferred_strong").otherwise("inferred_weak")
    new_status = F.when(weak, "inferred_weak").when(has("figure_estimate"), "direct_weak").when(has("calculation"), calculated).otherwise(F.col(status))
    attention = weak | has("figure_estimate") | (has("calculation") & ~F.coalesce(F.col(status) == "direct_strong", F.lit(False)))
    added = F.array_compact(F.array(*[F.when(has(c), F.lit(c)) for c in ("figure_estimate", "protocol_inference", "absence_inference")]))
    return df.withColumns({"new_status": new_status, "new_bucket": F.when(attention, "attention").otherwise(F.col(bucket)), "new_flags": F.array_union(F.coalesce(F.col(flags), F.array().cast("array<string>")), added)})


# What makes a passage or a request look like one of a figure.
FIGURE_MARK = r"(?iU)\b(fig(?:ure)?\.?\s*[0-9]+|panel\s*[a-z]|chart|plot|graph|image|microscopy)\b"
VISUAL_REQUEST = r"(?iU)\b(figure|fig\.?|panel|plot|chart|graph|schematic|image|microscopy|visual|spatial map|heatmap|umap)\b"
NUMBER_IN_QUOTE = r"(?U)\b[0-9]+(?:\.[0-9]+)?%?\b"
#: Passages looked at for figures.
LOOKED_AT = 8


def retrieval_facts(ranked: DataFrame, passages: DataFrame, *, doc: str, query: str, passage: str, kind: str, text: str) -> DataFrame:
    """Per (document, query): ``n_retrieved``, and whether the first passages show or are figures."""
    top = ranked.select(doc, query, passage, "rank").join(passages.select(passage, kind, text), passage)
    near = F.col("rank") <= LOOKED_AT
    of_figure = F.coalesce(F.col(kind).isin("caption", "figure"), F.lit(False))
    return top.groupBy(doc, query).agg(F.count("*").alias("n_retrieved"), F.coalesce(F.bool_or(near & of_figure), F.lit(False)).alias("has_figure"), F.coalesce(F.bool_or(near & (of_figure | F.coalesce(F.col(text).rlike(FIGURE_MARK), F.lit(False)))), F.lit(False)).alias("promises_figure"))


def numbers_conflict(evidence: DataFrame, proposal: str, quote: str) -> DataFrame:
    """Whether the quotes of a proposal hold two or more different numbers, as written."""
    n = evidence.select(proposal, F.explode(F.expr(f"regexp_extract_all(coalesce({quote}, ''), r'{NUMBER_IN_QUOTE}', 0)")).alias("n"))
    return n.groupBy(proposal).agg((F.count_distinct("n") >= 2).alias("conflict"))


def vision_triggers() -> Column:
    """Why figures should be looked at, in order; over ``state``, ``support``, ``needs_more``, ``conflict``, ``visual``,
    ``has_figure``, ``promises_figure``, ``missing``."""
    weak = "(support = 'weak_evidence' or needs_more)"
    asked = "(visual and promises_figure)"
    return codes_when([
        ("text_unclear", "state = 'unclear'"), ("text_weak", weak), ("text_contradictory", "conflict"), ("visual_request", asked),
        ("direct_figure_context", f"has_figure and (state = 'unclear' or {weak} or conflict or missing or {asked})"), ("figure_rescue_candidate", "missing and has_figure"),
    ])


def rescue_triggers() -> Column:
    """Why a second search should be made, in order; over the columns of :func:`vision_triggers`, ``has_quote`` and ``n_figure``."""
    return codes_when([
        ("unclear_state", "state = 'unclear'"), ("missing_usable_evidence", "needs_more or not has_quote"), ("weak_or_inferred_evidence", "support in ('weak_evidence', 'inferred_from_evidence')"),
        ("figure_relevant_without_figure_evidence", "promises_figure and n_figure = 0"),
    ])


def failure_attribution() -> Column:
    """Where an unresolved cell failed; over ``state``, ``n_evidence``, ``n_retrieved`` (null: nothing was searched), ``has_text``, ``needs_more``, ``missing``."""
    return F.expr("""case when state not in ('unclear', 'error', 'blocked') then null when n_evidence > 0 then 'evidence_ambiguity' when n_retrieved = 0 then 'retrieval_miss'
        when not has_text then 'parser_gap' when needs_more or not missing then 'evidence_ambiguity' else 'extraction_miss' end""")


def retrieval_diagnosis() -> tuple[Column, Column]:
    """(classification, signals) of a cell; over the facts of the functions above, ``parser_signals``, counts of exact,
    approximate and fallback evidence, ``value_seen`` and ``quote_seen``."""
    doubtful = "(state = 'unclear' or needs_more or support = 'weak_evidence')"
    kind = f"""case when state = 'error' then 'provider_failure' when state in ('blocked', 'skipped') then 'blocked_upstream'
        when n_retrieved = 0 then case when size(parser_signals) > 0 then 'parser_source_gap' else 'retrieval_miss' end
        when n_exact = 0 and n_approximate + n_fallback > 0 then 'evidence_anchoring_gap' when {doubtful} and (value_seen or quote_seen) then 'reasoning_gap'
        when {doubtful} then 'retrieval_miss' when size(parser_signals) > 0 and n_exact = 0 then 'parser_source_gap' else 'not_needed' end"""
    more = codes_when([
        ("no_retrieval_chunks", "n_retrieved = 0"), ("approximate_highlight_only", "n_approximate > 0"), ("quote_plus_page_fallback", "n_fallback > 0"),
        ("proposed_value_seen_in_retrieval", "value_seen"), ("quote_seen_in_retrieval", "quote_seen"), ("figure_evidence_present", "n_figure > 0"),
    ])
    return F.expr(kind), F.concat(F.col("parser_signals"), more)
